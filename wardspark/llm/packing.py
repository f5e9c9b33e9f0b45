"""Mixture-controlled packing of documents into sequences of a fixed length.

Deficit round-robin: in each round (a window of ``window`` ids) every source may give its
target share of the window; the fraction it could not give is its deficit and is carried to
the next round. After j rounds source s has given ``min(total_s, floor(j * window * share_s))``
ids, so what a round holds is known without running the rounds before it: each document finds
its rounds from the ids of its source that precede it, in any partition. Rounds follow each
other without gaps, and sequences are cut from that one stream, so only the last of all
sequences can be padded. An empty queue is skipped, as in the classic scheme.

By default a source's target is its share of all ids, so all queues end together. Sources
without a target take one part in a million of the largest. Null texts are empty documents of
one end id, null sources are one source, equal doc_ids are kept apart by the row they came
from, an empty table gives no pieces, and other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm import shared, tokens

SEQUENCE = 2048
WINDOW = 32 * SEQUENCE
PIECES = pa.schema([
    ("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("window", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()),
])
PIECES_DDL = "doc_id long, source string, start long, length long, doc_tokens long, window long, sequence_id long, offset long, ids_crc32 long, ids binary"


@dataclass(frozen=True)
class Rounds:
    """What each source has given after each round. One entry a source."""

    names: tuple[str | None, ...]
    totals: tuple[int, ...]
    parts: tuple[int, ...]
    window: int

    @cached_property
    def whole(self) -> int:
        return sum(self.parts)

    def given(self, j: int) -> list[int]:
        return [min(t, j * self.window * p // self.whole) for t, p in zip(self.totals, self.parts, strict=True)]

    def round_of(self, s: int, position: int) -> int:
        """The round in which source ``s`` gives its id at ``position``."""
        return -(-(position + 1) * self.whole // (self.window * self.parts[s])) - 1

    @lru_cache(maxsize=4096)
    def layout(self, j: int) -> tuple[list[int], list[int], list[int]]:
        """Of round j, by source: ids given before it and after it, and the place of its first id in the stream."""
        before, after = self.given(j), self.given(j + 1)
        at, places = sum(before), []
        for a, b in zip(before, after, strict=True):
            places.append(at)
            at += b - a
        return before, after, places

    def pieces(self, s: int, begin: int, length: int, sequence: int) -> Iterator[tuple[int, int, int, int]]:
        """(round, offset in the document, place in the stream, length) of a document's pieces."""
        at, end, j = begin, begin + length, self.round_of(s, begin)
        while at < end:
            before, after, places = self.layout(j)
            stop = min(end, after[s])
            while at < stop:
                place = places[s] + at - before[s]
                size = min(stop - at, sequence - place % sequence)
                yield j, at - begin, place, size
                at += size
            j += 1


def _cut(rounds: Rounds, sequence: int, keep_ids: bool):
    names = {n: i for i, n in enumerate(rounds.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, source, n, before, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "n_tokens", "before", "ids")), strict=True):
                # The width of an id follows from the row: the driver needs no tokenizer in memory to know it.
                wide = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes()
                for window, start, place, size in rounds.pieces(names[source], before, n, sequence):
                    piece = wide[4 * start : 4 * (start + size)]
                    rows.append((doc, source, start, size, n, window, place // sequence, place % sequence, zlib.crc32(piece), piece if keep_ids else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    return run


def pack(docs: DataFrame, vocabulary: str, targets: dict[str | None, int] | None = None, sequence: int = SEQUENCE, window: int = WINDOW, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents: where each lies in its document and in its sequence, with the checksum of its ids and, if ``keep_ids``, with these.

    ``targets`` are whole-number weights by source. ids are little-endian unsigned 32-bit integers. Totals by source, one row a source, pass the driver.
    """
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    ids = shared.saved(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
        .mapInArrow(tokens.encode_batches(vocabulary, schema), "row long, doc_id long, source string, n_tokens long, ids binary"), "ids")
    sums = ids.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    most = max((targets or {}).values(), default=0)
    parts = tuple(r["n"] if targets is None else 1_000_000 * targets.get(r["source"], 0) or max(1, most) for r in sums)
    rounds = Rounds(tuple(r["source"] for r in sums), tuple(r["n"] for r in sums), parts, window)
    placed = shared.running_totals(ids.select("row", "doc_id", "source", "n_tokens"), ["source"], ["doc_id", "row"], {"before": "n_tokens"}).select("row", "before")
    return ids.join(placed, "row").select("doc_id", "source", "n_tokens", "before", "ids").mapInArrow(_cut(rounds, sequence, keep_ids), PIECES_DDL)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids only."""
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window")
