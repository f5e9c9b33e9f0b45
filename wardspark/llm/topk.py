"""Exact top-k inner products by branch and bound over columns of dimensions.

Components become floor(1024 x). Candidates lie in blocks stored by dimension (``vertical``); a query
adds up its product a few dimensions at a time, and after each step keeps only candidates whose
sum plus the largest product that the remaining mass of both allows can still reach the k-th
best: that of the blocks its task has seen, or of the lower bounds in this one.

Queries come to the blocks in batches, so neither side is copied or shuffled for the other. What the
tasks find, k rows a query at most, is merged by query.

Vectors that are null, or hold a null or non-finite component, take no part, nor do rows without
vec_id; shorter vectors count as filled with zeros; an empty vector scores 0. A row is not its own
candidate, but another row with the same vec_id is. Ties go to the smaller vec_id. Scores beyond 64
bits are compared exactly and returned as the nearest long. An empty table or one without queries
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm import vertical
from wardspark.llm.vertical import Block

STEP = 8
SCALE = 1024

Found = list[tuple[int, int, int]]  # score, vec_id, row of a query's best so far, best first


class _Masses:
    """What is left of each candidate of a block from each step on, in the block's own order of dimensions."""

    def __init__(self, block: Block):
        dims, n = block.columns.shape
        self.steps = range(0, dims, STEP)
        if block.wide:
            return
        square = block.columns.astype(np.float64) ** 2
        self.order = np.argsort(-square.sum(axis=1), kind="stable")
        self.columns = block.columns[self.order]
        by_step = np.add.reduceat(square[self.order], list(self.steps), axis=0) if dims else np.zeros((0, n))
        self.left = np.sqrt(np.cumsum(by_step[::-1], axis=0)[::-1])


def best_of_block(query: np.ndarray, own: int, block: Block, masses: _Masses, held: Found, k: int) -> None:
    """Merge the block's k best for a query, whose row is ``own``, into ``held``."""
    at = np.flatnonzero(block.rows != own)
    if block.wide or query.dtype == object:
        total = vertical.exact_scores(query, block, at)
        first = sorted(range(len(at)), key=lambda i: (-total[i], block.ids[at[i]], block.rows[at[i]]))[:k]
    else:
        dims = len(block.columns)
        query = vertical.fitted(query, dims)[masses.order]
        square = query.astype(np.float64) ** 2
        left = np.sqrt(np.cumsum(square[::-1])[::-1])
        total = np.zeros(len(at), np.int64)
        for s, a in enumerate(masses.steps):
            z = min(dims, a + STEP)
            total = total + query[a:z] @ masses.columns[a:z][:, at]
            if z < dims and len(at) > k:
                slack = left[z] * masses.left[s + 1, at] * (1 + 1e-9) + 1 + 1e-12 * np.abs(total)
                floor = np.partition(total - slack, len(at) - k)[len(at) - k]
                if len(held) >= k:
                    floor = max(floor, held[-1][0])
                stay = total + slack >= floor
                if not stay.all():
                    at, total = at[stay], total[stay]
        first = np.lexsort((block.rows[at], block.ids[at], -total))[:k]
    held += [(int(total[i]), int(block.ids[at[i]]), int(block.rows[at[i]])) for i in first]
    held.sort(key=lambda x: (-x[0], *x[1:]))
    del held[k:]


FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64()), ("order", pa.binary())])
FOUND_DDL = "query_row long, query_id long, vec_id long, row long, score long, order binary"


def _search(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [(row, name, vertical.components(e, wide)) for row, name, wide, e in sent.value]
        best: list[Found] = [[] for _ in queries]
        for block in vertical.read_blocks(batches):
            masses = _Masses(block)
            for (row, _, e), held in zip(queries, best, strict=True):
                best_of_block(e, row, block, masses, held, k)
        rows = [(row, name, i, r, vertical.as_long(s), vertical.order_key(s)) for (row, name, _), held in zip(queries, best, strict=True) for s, i, r in held]
        for a in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 50_000], strict=True), FOUND, strict=True)], schema=FOUND)

    return run


def top_products(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows."""
    rows = vertical.vector_rows(vectors, is_query, SCALE)
    blocks = vertical.blocks_of(rows, vertical.CANDIDATES)

    def of_batch(batch: pa.Table) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast([(r["row"], r["vec_id"], r["wide"], r["e"]) for r in batch.to_pylist()])
        found = blocks.mapInArrow(_search(sent, k), FOUND_DDL)
        by_query = Window.partitionBy("query_row").orderBy(F.desc("order"), "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    return vertical.for_each_batch(rows, vertical.QUERIES, of_batch, "query_id long, rank int, vec_id long, score long")
