"""Vectors as whole numbers, stored by dimension in blocks, and scans of the blocks by batches of queries.

Blocks are written once and stay where they are; queries come to them in batches of bounded size
as a broadcast, so that no vector is shuffled or copied for each query. A task keeps only what it
has found so far for the queries of one batch.

Products of ordinary vectors are 64-bit integers. Vectors whose squared length passes 2^61 are kept
in blocks of their own, as exact integers of any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.llm import shared

#: Rows of a block and queries of a batch: bounds on what a task holds.
CANDIDATES = 16_384
QUERIES = 2_048
_SQUARE = 2.0**61

ROWS = pa.schema([("vec_id", pa.int64()), ("row", pa.int64()), ("label", pa.int64()), ("flag", pa.bool_()), ("wide", pa.bool_()), ("e", pa.binary())])
ROWS_DDL = "vec_id long, row long, label long, flag boolean, wide boolean, e binary"
BLOCKS = pa.schema([("wide", pa.bool_()), ("dims", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()), ("labels", pa.binary()), ("columns", pa.binary())])
BLOCKS_DDL = "wide boolean, dims long, ids binary, rows binary, labels binary, columns binary"


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), also where the product passes a double."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else int(x) * scale


def _scaled(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            with np.errstate(over="ignore"):
                whole = np.floor(values * scale)
                square = np.concatenate([[0.0], np.cumsum(np.where(np.isfinite(whole), np.minimum(np.abs(whole), 1e150) ** 2, 0.0))])
                large = np.concatenate([[0], np.cumsum(~np.isfinite(whole) | (np.abs(whole) > 2.0**30))])
            kept, wide, data = [], [], []
            for i in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[starts])).tolist():
                a, z = starts[i], ends[i]
                exact = bool(large[z] > large[a] and (not np.isfinite(whole[a:z]).all() or (whole[a:z] ** 2).sum() > _SQUARE)) or z - a > 1 << 20
                kept.append(i)
                wide.append(exact)
                data.append(",".join(str(_whole(x, scale)) for x in values[a:z].tolist()).encode() if exact else whole[a:z].astype("<i8").tobytes())
            if kept:
                part = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "row", "label", "flag")), pa.array(wide), pa.array(data, pa.binary())], schema=ROWS)

    return run


def vector_rows(vectors: DataFrame, flag: Column, scale: int, label: str | None = None) -> DataFrame:
    """The vectors that take part, as whole numbers, with a number for each row and a label; written once.

    A vector that is null or holds a null or non-finite component takes no part, nor does one
    without vec_id or, if ``label`` names a column, without label.
    """
    named = F.col(label).cast("long") if label else F.lit(0).cast("long")
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & named.isNotNull()).select(
        F.col("vec_id").cast("long"), F.monotonically_increasing_id().alias("row"), named.alias("label"), F.coalesce(flag, F.lit(False)).alias("flag"), "embedding")
    return shared.saved(rows.mapInArrow(_scaled(scale), ROWS_DDL), "vectors")


def components(data: bytes, wide: bool) -> np.ndarray:
    """The components of a stored vector: 64-bit, or Python integers if it is wide."""
    if wide:
        return np.array([int(x) for x in data.split(b",")] if data else [], object)
    return np.frombuffer(data, "<i8")


def matrix(vectors: list[np.ndarray], dims: int, wide: bool) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(vectors), dims), object if wide else np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _block(rows: list[tuple], wide: bool) -> pa.RecordBatch:
    ids, numbers, labels, data = zip(*rows, strict=True)
    vectors = [components(d, wide) for d in data]
    dims = max(map(len, vectors))
    columns = matrix(vectors, dims, wide).T
    packed = b"\n".join(b",".join(str(v).encode() for v in c) for c in columns) if wide else np.ascontiguousarray(columns).astype("<i8").tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array([v], t.type) for v, t in zip((wide, dims, *(np.array(x, "<i8").tobytes() for x in (ids, numbers, labels)), packed), BLOCKS, strict=True)], schema=BLOCKS)


def _blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {False: [], True: []}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "row", "label", "e", "wide")), strict=True):
                kind = held[row[4]]
                kind.append(row[:4])
                if len(kind) >= most:
                    yield _block(kind, row[4])
                    kind.clear()
        for wide, kind in held.items():
            if kind:
                yield _block(kind, wide)

    return run


def blocks_of(rows: DataFrame, most: int) -> DataFrame:
    """The rows of ``vector_rows`` in blocks of at most ``most``, each stored by dimension; written once."""
    return shared.saved(rows.mapInArrow(_blocks(most), BLOCKS_DDL), "blocks")


@dataclass
class Block:
    """Candidates of one block; ``columns`` holds a row for each dimension."""

    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    columns: np.ndarray
    wide: bool


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for wide, dims, ids, rows, labels, packed in zip(*(batch.column(c).to_pylist() for c in BLOCKS.names), strict=True):
            ids, rows, labels = (np.frombuffer(x, "<i8") for x in (ids, rows, labels))
            if wide:
                columns = np.array([[int(v) for v in c.split(b",")] for c in packed.split(b"\n")] if dims else [], object).reshape(dims, len(ids))
            else:
                columns = np.frombuffer(packed, "<i8").reshape(dims, len(ids))
            yield Block(ids, rows, labels, columns, wide)


def exact_scores(query: np.ndarray, block: Block, at: np.ndarray) -> np.ndarray:
    """Inner products of one query with the candidates at ``at``, as Python integers of any size."""
    dims = min(len(query), len(block.columns))
    total = np.zeros(len(at), object)
    for d in range(dims):
        total = total + int(query[d]) * block.columns[d, at].astype(object)
    return total


def fitted(query: np.ndarray, dims: int) -> np.ndarray:
    """A query with as many dimensions as a block: what one lacks counts as zero."""
    out = np.zeros(dims, query.dtype)
    out[: min(dims, len(query))] = query[:dims]
    return out


def order_key(score: int) -> bytes:
    """Bytes that sort as the integers do, of any size."""
    size = abs(score)
    data = size.to_bytes((size.bit_length() + 7) // 8, "big")
    if score >= 0:  # the longest is 2^16 bytes
        return b"\x01" + len(data).to_bytes(2, "big") + data
    return b"\x00" + (0xFFFF - len(data)).to_bytes(2, "big") + bytes(255 - b for b in data)


def as_long(score: int) -> int:
    """The score, or the nearest 64-bit integer."""
    return max(-(1 << 63), min((1 << 63) - 1, score))


def batches_of(rows: DataFrame, most: int) -> Iterator[pa.Table]:
    """The flagged rows in batches of about ``most``, each small enough to be sent to every task."""
    flagged = rows.where("flag")
    count = max(1, math.ceil(flagged.count() / most))
    for i in range(count):
        batch = flagged.where(F.pmod(F.xxhash64("row"), F.lit(count)) == i).select("vec_id", "row", "label", "wide", "e").toArrow()
        if len(batch):
            yield batch


def for_each_batch(rows: DataFrame, most: int, found: Callable[[pa.Table], DataFrame], ddl: str) -> DataFrame:
    """What ``found`` gives for each batch of flagged rows, written batch by batch."""
    out = None
    for batch in batches_of(rows, most):
        part = shared.saved(found(batch), "found")
        out = part if out is None else out.union(part)
    return rows.sparkSession.createDataFrame([], ddl) if out is None else out
