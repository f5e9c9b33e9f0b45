"""Hard negatives by vertical scans that shrink a bitmap of candidates.

For each anchor a block's dimensions are read in the descending order of the anchor's magnitudes.
After every few dimensions a candidate's product lies between what it has so far plus the least,
and plus the most, that the remaining dimensions can add, which follows from each dimension's
smallest and largest value in the block. Candidates whose bounds miss every window asked for, or
stay below as many others as are wanted, leave the bitmap; those left at the end have exact products.

The scan runs twice: for an anchor's positives (same label, one open window), then for negatives
(another label, one window a positive). Blocks and batches: see ``vertical``.

Rows whose label, vec_id or vector is null, or whose vector holds a null or non-finite component, take no
part. Shorter vectors count as filled with zeros, an empty vector scores 0. A row is not its own
positive, but another row with the same vec_id is. Higher scores come first, then smaller vec_ids. An
anchor without positives, and a positive whose window is empty (all of negative score), give no
rows; so does an empty table. Scores beyond 64 bits are compared exactly and returned as the nearest
long. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm import shared, vertical
from wardspark.llm.vertical import Block

STEP = 8
#: Lowest and highest score of a negative, in hundredths of its positive's.
LOW, HIGH = 80, 100

Bounds = list[tuple[int | None, int | None]]
Found = list[tuple[int, int, int]]  # score, vec_id, row: the best so far of one window, best first


def narrow(query: np.ndarray, block: Block, bitmap: np.ndarray, windows: Bounds, best: list[Found], k: int) -> None:
    """Add to ``best``, for each window (lowest and highest score or None), what the block's candidates in ``bitmap`` give."""
    at = np.flatnonzero(bitmap)
    if not len(at):
        return
    if block.wide or query.dtype == object:
        total = vertical.exact_scores(query, block, at)
    else:
        at, total = _bounded(vertical.fitted(query, len(block.columns)), block, at, windows, best, k)
    for (low, high), held in zip(windows, best, strict=True):
        inside = np.ones(len(at), bool)
        if low is not None:
            inside &= (total >= low).astype(bool)
        if high is not None:
            inside &= (total <= high).astype(bool)
        score, ids, rows = total[inside], block.ids[at[inside]], block.rows[at[inside]]
        first = sorted(range(len(score)), key=lambda i: (-score[i], ids[i], rows[i]))[:k] if score.dtype == object else np.lexsort((rows, ids, -score))[:k]
        held += [(int(score[i]), int(ids[i]), int(rows[i])) for i in first]
        held.sort(key=lambda x: (-x[0], *x[1:]))
        del held[k:]


def _bounded(query: np.ndarray, block: Block, at: np.ndarray, windows: Bounds, best: list[Found], k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-np.abs(query), kind="stable")
    query, dims = query[order], len(order)
    ends = np.stack([block.columns[order].min(axis=1), block.columns[order].max(axis=1)]) * query if dims else np.zeros((2, 0), np.int64)
    # Sums of products of different candidates may pass 64 bits, so bounds are floating-point with room for their rounding.
    least, most = (np.concatenate([np.cumsum(x[::-1].astype(np.float64))[::-1], [0.0]]) for x in (ends.min(axis=0), ends.max(axis=0)))
    total = np.zeros(len(at), np.int64)
    for a in range(0, dims, STEP):
        z = min(dims, a + STEP)
        total = total + query[a:z] @ block.columns[np.ix_(order[a:z], at)]
        if z == dims:
            break
        slack = 1 + 1e-12 * (np.abs(total).astype(np.float64) + abs(least[z]) + abs(most[z])) + 1e-12 * (abs(least[0]) + abs(most[0]))
        low, high = total + least[z] - slack, total + most[z] + slack
        stay = np.zeros(len(at), bool)
        for (lowest, highest), held in zip(windows, best, strict=True):
            lowest = -np.inf if lowest is None else float(lowest)
            highest = np.inf if highest is None else float(highest)
            room = 1e-12 * max(abs(x) for x in (lowest, highest, 0.0) if np.isfinite(x))
            fits = (high >= lowest - room) & (low <= highest + room)
            sure = low[(low >= lowest + room) & (high <= highest - room)]
            if len(sure) >= k:
                fits &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
            if len(held) >= k:
                fits &= high >= held[-1][0]
            stay |= fits
        if not stay.all():
            at, total = at[stay], total[stay]
            if not len(at):
                break
    return at, total


FOUND = pa.schema([("anchor_row", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64()), ("order", pa.binary()), ("exact", pa.string())])
FOUND_DDL = "anchor_row long, anchor_id long, place int, vec_id long, row long, score long, order binary, exact string"


def _search(sent, same_label: bool, k: int):
    """Of every anchor and window: the best rows of all blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = [(row, name, label, vertical.components(e, wide), windows) for row, name, label, wide, e, windows in sent.value]
        best: list[list[Found]] = [[[] for _ in a[4]] for a in anchors]
        for block in vertical.read_blocks(batches):
            for (row, _, label, e, windows), held in zip(anchors, best, strict=True):
                bitmap = (block.labels == label) & (block.rows != row) if same_label else block.labels != label
                narrow(e, block, bitmap, windows, held, k)
        rows = [(row, name, place, i, r, vertical.as_long(s), vertical.order_key(s), str(s)) for (row, name, *_), held in zip(anchors, best, strict=True) for place, found in enumerate(held) for s, i, r in found]
        for a in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 50_000], strict=True), FOUND, strict=True)], schema=FOUND)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor_row", "place").orderBy(F.desc("order"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


RESULT_DDL = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor and each of its first ``positives`` rows of the same label: the first ``negatives`` rows
    of other labels that score from ``low`` to ``high`` hundredths of the positive.
    """
    spark = vectors.sparkSession
    rows = vertical.vector_rows(vectors, is_anchor, scale, label)
    blocks = vertical.blocks_of(rows, vertical.CANDIDATES)

    def of_batch(batch: pa.Table) -> DataFrame:
        anchors = {r["row"]: r for r in batch.to_pylist()}
        sent = spark.sparkContext.broadcast([(n, r["vec_id"], r["label"], r["wide"], r["e"], [(None, None)]) for n, r in anchors.items()])
        near = shared.saved(_ranked(blocks.mapInArrow(_search(sent, True, positives), FOUND_DDL), positives), "positives")
        windows: dict[int, list[tuple[int, int]]] = {n: [(0, -1)] * positives for n in anchors}
        for p in near.select("anchor_row", "rank", "exact").toLocalIterator():
            score = int(p["exact"])
            windows[p["anchor_row"]][p["rank"] - 1] = (-(-low * score // 100), high * score // 100)
        sent = spark.sparkContext.broadcast([(n, r["vec_id"], r["label"], r["wide"], r["e"], windows[n]) for n, r in anchors.items()])
        far = _ranked(blocks.mapInArrow(_search(sent, False, negatives), FOUND_DDL), negatives)
        known = near.select("anchor_row", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        return far.join(known, ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

    return vertical.for_each_batch(rows, vertical.QUERIES, of_batch, RESULT_DDL)
