"""Removal of passages that repeat from documents with smaller ids, by FM-indexes of shards.

A window is ``WINDOW`` words in a row. Every window is routed by its least gram (``GRAM`` words in a row; grams
that are frequent rank last), so equal windows meet in one shard, wherever they stand. Windows that
follow each other with the same gram form a segment of the text; a segment is kept once, with the
smallest doc_id that has it. Only grams with more than one segment need a comparison: a shard's
segments become an FM-index, each is streamed against it by backward search, and the stretches of at least a
window that a document with a smaller id holds are reported. A segment that the document with the
smallest id has as a whole is covered in all others.

Grams with more than ``HOT`` segments send each window on its own, by its own hash; windows that meet
there are equal, so the smallest doc_id decides. Which way a window takes changes no result, nor does the order of grams,
for which at most ``ORDER_SIZE`` frequent grams are sent to the tasks.

Words are runs of bytes other than space and tab to carriage return, unchanged, and compared by 64-bit
hashes. Null texts have no words. A row without doc_id keeps all words and removes none elsewhere. Rows
with equal doc_ids do not remove each other's words and all stay. Texts shorter than a window
stay whole; a window that repeats within one document only stays. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm import shared
from wardspark.llm.fm_index import FmIndex
from wardspark.llm.tokens import slices
from wardspark.llm.words import mix, words

WINDOW = 50
GRAM = 10
#: Windows of a segment at most; only where a text is cut, not what is compared.
RUN = 128
#: Segments of a gram beyond which its windows are routed one by one.
HOT = 1000
ORDER_SIZE = 400_000
#: Grams counted together for the order, bytes of text hashed at a time, words of an index.
COUNTED = 4_000_000
SLICE = 2_000_000
SHARD = 500_000

_ROOT = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_ROOT), -1, 1 << 64))


def _powers(root: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, root, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Spans:
    """Hashes of any spans of a sequence of word hashes."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.back = _powers(_BACK, n + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * _powers(_ROOT, n), dtype=np.uint64)])

    def __call__(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        return mix((self.prefix[starts + sizes] - self.prefix[starts]) * self.back[starts])


def _inside(firsts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which places begin a stretch of ``width`` words of one text."""
    fits = np.zeros(n + 1, np.int64)
    sizes = np.diff(firsts)
    long = sizes >= width
    np.add.at(fits, firsts[:-1][long], 1)
    np.add.at(fits, firsts[1:][long] - width + 1, -1)
    return np.cumsum(fits)[:n] > 0


GRAMS = pa.schema([("gram", pa.int64()), ("n", pa.int64())])


def _often(gram: int):
    """(gram, count) of those that recur among ``COUNTED`` grams or so."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        kept = counts >= 3
        return pa.RecordBatch.from_arrays([pa.array(values[kept].view(np.int64)), pa.array(counts[kept])], schema=GRAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                hashes, firsts = words(batch.column("text"), fold=False)
                held.append(Spans(hashes)(np.flatnonzero(_inside(firsts, len(hashes), gram)), gram))
                size += len(held[-1])
                if size >= COUNTED:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    return run


SEGMENTS = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("doc_id", pa.int64()), ("text_id", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])
SEGMENTS_DDL = "key long, seg long, doc_id long, text_id long, start int, windows int"


def least_grams(grams: np.ndarray, count: int) -> np.ndarray:
    """The least of each ``count`` grams in a row."""
    out, width = grams, 1
    while 2 * width <= count:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = count - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _segments(order, window: int, gram: int):
    """The segments of each text; ``order``: frequent grams, sorted, and the level of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, level = order.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                hashes, firsts = words(batch.column("text"), fold=False)
                n = len(hashes)
                if n < window:
                    continue
                spans = Spans(hashes)
                starts = np.flatnonzero(_inside(firsts, n, window))
                if not len(starts):
                    continue
                grams = spans(np.arange(n - gram + 1), gram)
                value = grams >> np.uint64(6)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
                    value |= np.where(frequent[at] == grams, level[at], 0).astype(np.uint64) << np.uint64(58)
                least = least_grams(value, window - gram + 1)[starts]
                text = np.searchsorted(firsts, starts, side="right") - 1
                new = np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1) | (text[1:] != text[:-1])])
                place = np.arange(len(starts))
                new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % RUN == 0
                first = np.flatnonzero(new)
                windows = np.diff(np.append(first, len(starts)))
                at = text[first]
                doc, own = (batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("doc_id", "text_id"))
                yield pa.RecordBatch.from_arrays([
                    pa.array(mix(least[first]).view(np.int64)), pa.array(spans(starts[first], windows + window - 1).view(np.int64)), pa.array(doc), pa.array(own),
                    pa.array((starts[first] - firsts[at]).astype(np.int32)), pa.array(windows.astype(np.int32))], schema=SEGMENTS)

    return run


PARTS = pa.schema([("shard", pa.int64()), ("alone", pa.bool_()), ("key", pa.int64()), ("seg", pa.int64()), ("at", pa.int32()), ("first", pa.int64()), ("words", pa.binary())])
PARTS_DDL = "shard long, alone boolean, key long, seg long, at int, first long, words binary"


def _parts(window: int):
    """The words of the segments wanted of each text (``wanted``: key, seg, start, windows, hot); those of hot grams window by window.

    Of repeated rows a task sends the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                hashes, firsts = words(batch.column("text"), fold=False)
                spans = Spans(hashes)
                rows: list[tuple] = []
                for doc, own, base, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_id")), firsts[:-1].tolist(), batch.column("wanted").to_pylist(), strict=True):
                    if (doc, own) in seen:
                        continue
                    seen.add((doc, own))
                    for w in wanted:
                        start = base + w["start"]
                        if w["hot"]:
                            each = start + np.arange(w["windows"])
                            rows += [(h, True, w["key"], w["seg"], k, doc, b"") for k, h in enumerate(mix(spans(each, window) ^ np.uint64(w["key"] & 0xFFFFFFFFFFFFFFFF)).view(np.int64).tolist())]
                        else:
                            rows.append((w["key"], False, w["key"], w["seg"], 0, doc, hashes[start : start + w["windows"] + window - 1].tobytes()))
                for a in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 20_000], strict=True), PARTS, strict=True)], schema=PARTS)

    return run


SPANS = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])
SPANS_DDL = "key long, seg long, start int, size int"


def _shards(window: int):
    """Parts sorted by (shard, alone, first, seg) come in; the stretches that a document with a smaller id holds go out."""

    def indexed(held: list[tuple]) -> pa.RecordBatch:
        keys, segs, firsts, data = zip(*held, strict=True)
        sizes = np.array([len(d) // 8 for d in data])
        _, codes = np.unique(np.frombuffer(b"".join(data), np.uint64), return_inverse=True)
        ends = np.cumsum(sizes)
        sequences = [codes[z - n : z] + 1 for n, z in zip(sizes.tolist(), ends.tolist(), strict=True)]
        which, start = FmIndex(sequences, np.array(firsts)).search(window)
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys)[which]), pa.array(np.array(segs)[which]), pa.array(start.astype(np.int32)), pa.array(np.full(len(which), window, np.int32))], schema=SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, least = [], 0, None, None
        for batch in batches:
            lone: list[tuple] = []
            for shard, alone, key, seg, at, first, data in zip(*(batch.column(c).to_pylist() for c in PARTS.names), strict=True):
                if (shard, alone) != last:
                    if size >= SHARD:
                        yield indexed(held)
                        held, size = [], 0
                    last, least = (shard, alone), first
                if alone:
                    if first > least:
                        lone.append((key, seg, at, window))
                elif not held or held[-1][:2] != (key, seg):  # not the same segment again
                    held.append((key, seg, first, data))
                    size += len(data) // 8
            if lone:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lone, strict=True), SPANS, strict=True)], schema=SPANS)
        if held:
            yield indexed(held)

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
RESULT_DDL = "doc_id long, n_words long, n_removed long, kept string"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the words of its spans."""
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            sizes, removed, kept = [], [], []
            for text, spans in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                parts = (text or b"").split()  # at the white space of ASCII, no other
                sizes.append(len(parts))
                if spans:
                    edge = np.zeros(len(parts) + 1, np.int64)
                    np.add.at(edge, [s["start"] for s in spans], 1)
                    np.add.at(edge, [s["start"] + s["size"] for s in spans], -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    parts = [p for p, s in zip(parts, stay.tolist(), strict=True) if s]
                removed.append(sizes[-1] - len(parts))
                kept.append(b" ".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=RESULT)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_id (hash of the text) and spans (start, size in words) that together are all repeated words of the texts that have any."""
    spark = docs.sparkSession
    gram = min(GRAM, window)
    known = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    often = known.select("text").mapInArrow(_often(gram), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(ORDER_SIZE).toArrow()
    by_gram = np.argsort(often["gram"].to_numpy().view(np.uint64))
    level = np.minimum(63, np.ceil(np.log2(often["n"].to_numpy() + 1))).astype(np.uint8)
    order = spark.sparkContext.broadcast((often["gram"].to_numpy().view(np.uint64)[by_gram], level[by_gram]))
    segments = shared.saved(known.mapInArrow(_segments(order, window, gram), SEGMENTS_DDL), "segments")

    once = segments.groupBy("key", "seg").agg(F.min(F.struct("doc_id", "text_id", "start", "windows")).alias("at"), F.max("doc_id").alias("last"))
    once = shared.saved(once.select("key", "seg", "at.*", "last").withColumnRenamed("doc_id", "first"), "once")
    many = once.groupBy("key").agg(F.count("*").alias("n"), F.min("first").alias("least"), F.max("last").alias("most")).where("n > 1 and least < most").select("key", (F.col("n") > HOT).alias("hot"))
    wanted = once.join(many, "key").groupBy(F.col("first").alias("doc_id"), "text_id").agg(F.collect_list(F.struct("key", "seg", "start", "windows", "hot")).alias("wanted"))
    parts = known.join(wanted, ["doc_id", "text_id"]).select("doc_id", "text_id", "text", "wanted").mapInArrow(_parts(window), PARTS_DDL)
    dealt = parts.repartition("shard").sortWithinPartitions("shard", "alone", "first", "seg")
    spans = shared.saved(dealt.mapInArrow(_shards(window), SPANS_DDL), "spans")

    own = spans.groupBy("key", "seg").agg(F.collect_set(F.struct("start", "size")).alias("own"))
    held = once.join(own, ["key", "seg"], "left").where("own is not null or first < last").select("key", "seg", "first", "own")
    whole = F.array(F.struct(F.lit(0).alias("start"), (F.col("windows") + (window - 1)).alias("size")))
    found = segments.join(held, ["key", "seg"]).select("doc_id", "text_id", F.col("start").alias("from"), F.explode(F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("own"))).alias("span"))
    return found.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct((F.col("from") + F.col("span.start")).alias("start"), F.col("span.size").alias("size"))).alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spans = repeated_spans(docs, window)
    named = docs.withColumn("text_id", F.xxhash64("text"))
    return named.join(spans, ["doc_id", "text_id"], "left").select("doc_id", "text", "spans").mapInArrow(_kept, RESULT_DDL)


def digests(kept: DataFrame) -> DataFrame:
    """The result with the checksum of the words left instead of the words."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))
