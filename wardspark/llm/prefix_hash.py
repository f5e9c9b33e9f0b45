"""Document fingerprints by prefix polynomial hashes.

A text's prefix arrays hold, modulo two primes, the sum of its code points times powers of a
base. The hash of any span then takes two entries, so spans of any texts are compared in
constant time, and the longest common extension of two places is found by binary search.

A fingerprint is the text's length, its hash as a whole and a sketch: the ``SKETCH`` smallest
marks (of 48 bits, from both primes) of all its spans of ``SPAN`` code points (of the whole text, if it is shorter), in
base64. Likeness is 1 for equal fingerprints, else the sketches' estimate of the share of spans in common.
How far a text and its edited text agree from the start (``same_prefix``) is exact, by binary search.

Null texts are empty; the fingerprint of an empty text is like that of empty texts only; equal
doc_ids follow each other in the order of their texts; the next document of a table's only row is
that row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm import shared
from wardspark.llm.tokens import slices
from wardspark.llm.words import mix

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 48_271_013)
SPAN = 12
SKETCH = 40
#: Bytes of a span's mark in a sketch: unrelated texts of any length share next to none by chance.
MARK = 6


class _Powers:
    """Powers of a base and of its inverse, as far as they have been needed."""

    def __init__(self, base: int, prime: int):
        self.prime = np.uint64(prime)
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.roots = (base, pow(base, -1, prime))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        for i, root in enumerate(self.roots):
            table = self.tables[i]
            while len(table) < n:
                step = np.uint64(pow(root, len(table), int(self.prime)))
                table = np.concatenate([table, table * step % self.prime])
            self.tables[i] = table
        return self.tables[0], self.tables[1]


_POWERS = tuple(_Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class PrefixHash:
    """Prefix arrays of a text, one for each prime."""

    def __init__(self, codes: np.ndarray, prefixes: list[np.ndarray] | None = None, known: int = 0):
        """``prefixes``: arrays of a text with the same first ``known`` code points, which are taken over."""
        self.n = len(codes)
        self.prefix = []
        for i, powers in enumerate(_POWERS):
            up, _ = powers.upto(self.n + 1)
            p = powers.prime
            terms = (codes[known:] + np.uint64(1)) * up[known : self.n] % p
            base = prefixes[i][: known + 1] if prefixes else np.zeros(1, np.uint64)
            self.prefix.append(np.concatenate([base, (base[-1] + np.cumsum(terms)) % p]))

    def edited(self, codes: np.ndarray, known: int) -> PrefixHash:
        return PrefixHash(codes, self.prefix, known)

    def span(self, start: int, length: int) -> tuple[int, ...]:
        """The hash of a span, the same wherever equal spans stand."""
        out = []
        for powers, h in zip(_POWERS, self.prefix, strict=True):
            p = int(powers.prime)
            _, down = powers.upto(self.n + 1)
            out.append((int(h[start + length]) - int(h[start])) % p * int(down[start]) % p)
        return tuple(out)

    def spans(self, length: int, start: int = 0) -> np.ndarray:
        """Hashes, both primes' in one number, of all spans of a length from ``start`` on."""
        stop = self.n - length + 1
        if start >= stop:
            return np.zeros(0, np.uint64)
        out = np.zeros(stop - start, np.uint64)
        for powers, h in zip(_POWERS, self.prefix, strict=True):
            _, down = powers.upto(self.n + 1)
            p = powers.prime
            out = (out << np.uint64(31)) | ((h[start + length : stop + length] + p - h[start:stop]) % p * down[start:stop] % p)
        return out

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        return self.span(start, length) == other.span(other_start, length)

    def extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """The length of the longest common extension of two places."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(start, other, other_start, mid):
                low = mid
            else:
                high = mid - 1
        return low


def _least(values: np.ndarray) -> np.ndarray:
    """The distinct smallest values, ``SKETCH`` at most, in order."""
    if len(values) > 4 * SKETCH:
        few = np.unique(np.partition(values, 4 * SKETCH)[: 4 * SKETCH])
        if len(few) >= SKETCH:
            return few[:SKETCH]
    return np.unique(values)[:SKETCH]


def _marks(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes) >> np.uint64(64 - 8 * MARK)


def _written(h: PrefixHash, sketch: np.ndarray) -> str:
    a, b = h.span(0, h.n)
    marks = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - MARK :].tobytes()
    return f"{h.n:x}-{a:08x}{b:08x}-{base64.b64encode(marks).decode()}"


def _sketch(mark: str) -> np.ndarray:
    data = np.frombuffer(base64.b64decode(mark.rpartition("-")[2]), np.uint8).reshape(-1, MARK)
    return np.pad(data, ((0, 0), (8 - MARK, 0))).view(">u8").ravel().astype(np.int64)


def fingerprint(text: str) -> str:
    h = PrefixHash(code_points(text))
    return _written(h, _least(_marks(h.spans(min(SPAN, h.n) or 1))))


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1."""
    if a == b:
        return 1.0
    x, y = _sketch(a), _sketch(b)
    both = np.union1d(x, y)[:SKETCH]
    return float(np.isin(both, np.intersect1d(x, y)).mean()) if len(both) else 0.0


def edited_text(text: str, following: str) -> str:
    """The last third (rounded down) of the code points replaced by as many of the next text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


class Printed:
    """A text with its arrays and span marks, so that its edited form only adds what is new."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.codes = code_points(text)
        self.hash = PrefixHash(self.codes)
        self.marks = _marks(self.hash.spans(min(SPAN, self.hash.n) or 1))
        self.mark = _written(self.hash, _least(self.marks))

    def row(self, following: Printed) -> tuple:
        new = edited_text(self.text, following.text)
        keep = self.hash.n - self.hash.n // 3
        h = self.hash.edited(np.concatenate([self.codes[:keep], following.codes[: self.hash.n // 3]]), keep)
        span = min(SPAN, h.n) or 1
        old = self.marks[: max(0, keep - span + 1)] if min(SPAN, self.hash.n) == span else np.zeros(0, np.uint64)
        mark = _written(h, _least(np.concatenate([old, _marks(h.spans(span, len(old)))])))
        digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc_id, self.hash.n, digest, self.mark, mark, likeness(self.mark, mark), likeness(self.mark, following.mark), self.hash.extension(0, h, 0)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_prefix long"
ROWS = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("same_prefix", pa.int64()), ("part", pa.int32()), ("end", pa.string()), ("text", pa.string()),
])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of documents in descending order: rows of all but the last, and its first and last texts as they are."""
    part = TaskContext.get().partitionId()
    last = None
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                now = Printed(doc, text or "")
                if last is None:
                    rows.append((doc, *[None] * 7, part, "first", now.text))
                else:
                    rows.append((*last.row(now), part, None, None))
                last = now
            if rows:
                yield _batch(rows)
    if last is not None:
        yield _batch([(last.doc_id, *[None] * 7, part, "last", last.text)])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = [(*Printed(d, t).row(Printed(None, n)), 0, None, None) for d, t, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True)]
            if rows:
                yield _batch(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and how like it is to that and to the next document's.

    Documents are ranged once by doc_id; a range's last document gets its next, the first of the
    range below, in a second step over the ends of ranges.
    """
    made = f"{RESULT}, part int, end string, text string"
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions(F.desc("doc_id"), "text")
    rows = shared.saved(ranged.mapInArrow(_run, made), "prints")
    firsts = rows.where("end = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    lasts = rows.where("end = 'last'").select("doc_id", "text", "part")
    below = Window.orderBy(F.desc("part"))  # a row for each range
    order = lasts.select("part", F.lead("part").over(below).alias("lower"), F.max("part").over(Window.partitionBy()).alias("top"))
    pairs = lasts.join(order.select("part", F.coalesce("lower", "top").alias("next_part")), "part").join(firsts, "next_part")
    ends = pairs.select("doc_id", "text", "next_text").mapInArrow(_ends, made)
    columns = [c.split()[0] for c in RESULT.split(", ")]
    return rows.where("end is null").select(*columns).union(ends.select(*columns))
