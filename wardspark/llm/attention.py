"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from how it is
written (letter cases, signs, repetition, lengths); a gated attention layer, learned from document
labels alone, weighs the passages; the document's score is that of the weighted representation.

Training reads at most ``MAX_LABELLED`` labelled documents and ``MAX_PASSAGES`` of their passages
(those of smallest hash of doc_id, so the choice does not depend on partitions); only the encoded
passages of this bounded sample reach the driver. Scoring reads every whole text where it lies.

Null and empty texts have one passage of zeros and are scored like any other; labels that are
null or neither 0 nor 1 are left out, and a document labelled both ways counts as 0; equal
doc_ids are scored one by one; without labels of both kinds every score is the share of label 1
(1 without any); an empty table gives no rows; other columns stay beside the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wardspark.llm.tokens import slices
from wardspark.llm.words import text_bytes, words

PASSAGE = 48
MAX_LABELLED = 6_000
MAX_PASSAGES = 120_000
THRESHOLD = 0.3
HIDDEN = 16
GATE = 8
EPOCHS = 160

_CLASSES = np.zeros((256, 7), np.float32)
for _i, _signs in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~+=<>/\\{}[]_`", b"|", b"!?", b",;:", b".")):
    _CLASSES[list(_signs), _i] = 1
_KIND = np.where(_CLASSES.any(axis=1), _CLASSES.argmax(axis=1), 7).astype(np.int8)
_KIND[128:] = 8
FEATURES = 18


def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(passages x features, first passage of each text and the end): every text has at least one passage."""
    data, offsets = text_bytes(column)
    hashes, firsts = words(column)
    counts = np.diff(firsts)
    passages = np.maximum(1, -(-counts // PASSAGE))
    begins = np.concatenate([[0], np.cumsum(passages)])
    out = np.zeros((int(begins[-1]), FEATURES), np.float32)
    if not len(hashes):
        return out, begins
    text_of = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(hashes)) - firsts[:-1][text_of]
    passage_of = begins[:-1][text_of] + within // PASSAGE
    n_passages = int(begins[-1])

    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] = solid[edges]
    at = np.flatnonzero(start)
    # A passage takes the bytes from its first word to the next passage's first word.
    head = np.concatenate([[True], passage_of[1:] != passage_of[:-1]])
    begin_byte = at[head]
    length = np.diff(np.concatenate([begin_byte, [len(data)]]))
    present = passage_of[head]
    kinds = np.zeros((len(present), 9), np.float32)
    kind = _KIND[data[begin_byte[0] :]].astype(np.int64)
    owner = np.repeat(np.arange(len(present)), length)
    kinds = np.bincount(owner * 9 + kind, minlength=len(present) * 9).reshape(-1, 9).astype(np.float32)
    lines = np.bincount(owner, weights=data[begin_byte[0] :] == 10, minlength=len(present))

    n_words = np.bincount(passage_of, minlength=n_passages).astype(np.float32)[present]
    same1 = np.zeros(len(hashes), bool)
    same1[1:] = (hashes[1:] == hashes[:-1]) & (passage_of[1:] == passage_of[:-1])
    pair = np.unique(passage_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ hashes, return_index=True)[1]
    distinct = np.bincount(passage_of[pair], minlength=n_passages)[present]
    size = np.diff(np.concatenate([at, [len(data)]]))
    short = np.bincount(passage_of, weights=size <= 2, minlength=n_passages)[present]
    repeats = np.bincount(passage_of, weights=same1, minlength=n_passages)[present]
    x = np.zeros((len(present), FEATURES), np.float32)
    x[:, :9] = kinds / np.maximum(1, length)[:, None]
    x[:, 9] = length / n_words / 10
    x[:, 10] = repeats / n_words
    x[:, 11] = distinct / n_words
    x[:, 12] = short / n_words
    x[:, 13] = lines / n_words
    x[:, 14] = np.log1p(n_words) / 4
    x[:, 15] = np.minimum(1, kinds[:, 3] / n_words)
    x[:, 16] = np.minimum(1, kinds[:, 2] / n_words / 3)
    x[:, 17] = 1
    out[present] = x
    return out, begins


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Model:
    """Weights of the encoder, the gated attention and the score; without weights, one score for all."""

    weights: dict[str, np.ndarray]
    prior: float = 1.0

    def _forward(self, x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.weights
        h = np.tanh(((x - w["mean"]) / w["scale"]) @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * s) @ w["a"]
        sizes = np.diff(begins)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begins[:-1]), sizes))
        a = e / np.repeat(np.add.reduceat(e, begins[:-1]), sizes)
        z = np.add.reduceat(a[:, None] * h, begins[:-1], axis=0)
        return h, t, s, a, z, _sigmoid(z @ w["c"] + w["d"])

    def scores(self, x: np.ndarray, begins: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(begins) - 1, self.prior)
        return self._forward(x, begins)[-1] if len(begins) > 1 else np.zeros(0)

    def attention(self, x: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The weight of each passage in its document."""
        return self._forward(x, begins)[3]


def fit(x: np.ndarray, begins: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Gradient descent (Adam) on the cross entropy of document labels; the rarer label weighs as much as the other at most twice over."""
    if not len(y) or y.min() == y.max():
        return Model({}, float(y.mean()) if len(y) else 1.0)
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    w = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3}
    shapes = {"W": (FEATURES, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,)}
    w |= {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
    w |= {"b": np.zeros(HIDDEN), "d": np.zeros(1)}
    learned = [*shapes, "b", "d"]
    m, v = ({k: np.zeros_like(w[k]) for k in learned} for _ in range(2))
    share = y.mean()
    weight = np.where(y == 1, 1.0, min(2.0, share / (1 - share)))
    normal = (x - w["mean"]) / w["scale"]
    sizes = np.diff(begins)
    for step in range(1, epochs + 1):
        h, t, s, a, z, p = Model(w)._forward(x, begins)
        dz = (weight * (p - y) / len(y))
        g = {"c": z.T @ dz, "d": dz.sum(keepdims=True)}
        dzv = np.repeat(dz, sizes)[:, None] * w["c"]
        da = (dzv * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, begins[:-1]), sizes))
        g["a"] = (t * s).T @ de
        dt, ds = de[:, None] * w["a"] * s * (1 - t**2), de[:, None] * w["a"] * t * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ ds
        dh = (a[:, None] * dzv + dt @ w["V"].T + ds @ w["U"].T) * (1 - h**2)
        g["W"], g["b"] = normal.T @ dh, dh.sum(axis=0)
        for k in learned:
            g[k] = g[k] + 1e-5 * w[k]
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            w[k] = w[k] - 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(w, float(share))


def fold_of(doc_id: Column) -> Column:
    """A document's fold from 0 to 4; fold 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            x, begins = encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("label"), pa.array([x[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)], pa.binary()),
            ], names=["doc_id", "label", "passages"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED, most_passages: int = MAX_PASSAGES) -> Model:
    """A model from the labelled documents outside fold 0; both bounds are on what reaches the driver."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # at most ``most`` rows of two numbers
    found = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id").select("doc_id", "label", "text")
    rows = found.mapInArrow(_encoded, "doc_id long, label int, passages binary")
    size = F.length("passages") / (4 * FEATURES)
    rows = rows.where(size <= most_passages // 10).orderBy(F.xxhash64("doc_id"), "doc_id", "passages").limit(most).toArrow()
    parts = [np.frombuffer(p, np.float32).reshape(-1, FEATURES) for p in rows["passages"].to_pylist()]
    begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    n = int(np.searchsorted(begins, most_passages, side="right")) - 1
    y = rows["label"].to_numpy()[:n].astype(np.float64)
    return fit(np.concatenate(parts[:n]) if n else np.zeros((0, FEATURES), np.float32), begins[: n + 1], y)


def score_documents(docs: DataFrame, model: Model, into: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a score from 0 to 1; a column of that name is replaced."""
    rows = docs.drop(into)
    made = rows.withColumn(into, F.lit(0.0)).schema
    schema = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                scores = model.scores(*encode(batch.column(text)))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, pa.array(scores, pa.float64())], schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, made)
