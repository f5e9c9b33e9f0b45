"""Vertical scans of vectors: hard negatives and exact top-k against plain loops, odd tables, exact integers of any size."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardspark.llm import bond, shared, topk, vertical

DDL = "vec_id long, embedding array<double>, label int, row string, e string, flag int, wide int, score long, place int"
HUGE = [3e5, 2.0**40, 1e38, -1e300, 1.7e308]


@pytest.fixture
def small_parts(spark, monkeypatch):
    shared.ship(spark)
    monkeypatch.setattr(vertical, "CANDIDATES", 40)
    monkeypatch.setattr(vertical, "QUERIES", 5)
    monkeypatch.setattr(bond, "STEP", 3)


def odd_vectors(seed: int, n: int = 160) -> list[tuple]:
    """Ties, equal rows, nulls, non-finite and very large components, short and empty vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        e = (rng.integers(-3, 4, 8) / 4).tolist()
        if i % 40 == 7:
            e[2] = HUGE[i // 40 % len(HUGE)]
        if i % 50 == 11:
            e[3] = [None, math.nan, math.inf][i // 50]
        if i % 30 == 13:
            e = e[: i % 8]
        rows.append((i if i != 21 else 20, None if i % 61 == 5 else e, None if i % 37 == 3 else int(rng.integers(0, 4))))
    rows += [rows[20], rows[40], (None, [1.0] * 8, 1), (60, [], 2), (80, HUGE, 1), (81, HUGE[::-1], 1)]
    return rows


def scaled(e, scale):
    return [math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in e]


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def usable(e):
    return e is not None and all(x is not None and math.isfinite(x) for x in e)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, label, *["x"] * 2, 1, 1, 1, 1) for i, e, label in rows], DDL).repartition(3)


def plain_negatives(rows):
    kept = [(i, scaled(e, 256), label) for i, e, label in rows if i is not None and label is not None and usable(e)]
    out = []
    for a, (anchor, x, own) in enumerate(kept):
        if anchor % 20:
            continue
        scored = sorted((-product(x, y), i, label) for b, (i, y, label) in enumerate(kept) if b != a)
        for minus, positive, _ in [s for s in scored if s[2] == own][:5]:
            window = [s for s in scored if s[2] != own and 80 * -minus <= 100 * -s[0] <= 100 * -minus][:5]
            out += [(anchor, positive, rank, s[1], vertical.as_long(-minus), vertical.as_long(-s[0])) for rank, s in enumerate(window, 1)]
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_hard_negatives_equal_brute_force(spark, small_parts, seed):
    rows = odd_vectors(seed)
    got = bond.hard_negatives(frame(spark, rows), F.expr("vec_id % 20 = 0"))
    assert sorted(map(tuple, got.collect())) == sorted(plain_negatives(rows))
    assert any(r[4] == (1 << 63) - 1 for r in plain_negatives(rows))  # scores beyond 64 bits do occur


def test_hard_negatives_of_odd_tables(spark, small_parts):
    empty = frame(spark, odd_vectors(0)).where("false")
    assert bond.hard_negatives(empty, F.expr("vec_id % 20 = 0")).count() == 0
    alone = frame(spark, [(0, [1.0], 1), (1, [1.0], 2)])  # no positive
    assert bond.hard_negatives(alone, F.expr("vec_id = 0")).count() == 0
    below = frame(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)])  # a window of negative scores is empty
    assert bond.hard_negatives(below, F.expr("vec_id = 0")).count() == 0
    zero = frame(spark, [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 2)])
    assert [tuple(r) for r in bond.hard_negatives(zero, F.expr("vec_id = 0")).collect()] == [(0, 1, 1, 2, 0, 0)]


def test_the_bitmap_shrinks_before_all_dimensions_are_read(monkeypatch):
    rng = np.random.default_rng(3)
    columns = rng.integers(-5, 6, (64, 2000))
    columns[0] *= 100
    block = vertical.Block(np.arange(2000), np.arange(2000), np.zeros(2000, np.int64), columns, False)
    query = np.array([50, *[1] * 63])
    at, _ = bond._bounded(query, block, np.arange(2000), [(None, None)], [[]], 5)
    assert len(at) < 400
    held: list = [[]]
    bond.narrow(query, block, np.ones(2000, bool), [(None, None)], held, 5)
    total = query @ columns
    assert [h[0] for h in held[0]] == sorted(total.tolist(), reverse=True)[:5]


def plain_top(rows, k=10):
    kept = [(i, scaled(e, 1024)) for i, e, _ in rows if i is not None and usable(e)]
    out = []
    for a, (q, x) in enumerate(kept):
        if q % 20 == 0:
            scored = sorted((-product(x, y), i) for b, (i, y) in enumerate(kept) if b != a)[:k]
            out += [(q, rank, i, vertical.as_long(-s)) for rank, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_top_products_of_any_size_equal_brute_force(spark, small_parts, seed):
    rows = odd_vectors(seed)
    got = topk.top_products(frame(spark, rows), F.expr("vec_id % 20 = 0"))
    assert sorted(map(tuple, got.collect())) == sorted(plain_top(rows))


def test_large_components_take_part(spark, small_parts):
    rows = [(0, [3e5, 1.0], 0), (1, [3e5, 2.0], 0), (2, [1.0, 1.0], 0)]
    got = topk.top_products(frame(spark, rows), F.expr("vec_id = 0")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1024**2 * (90_000_000_000 + 2)), (0, 2, 2, 1024**2 * 300_001)]


@given(st.lists(st.integers() | st.integers(-(1 << 2100), 1 << 2100)))
def test_keys_sort_as_integers(values):
    assert sorted(values) == sorted(values, key=vertical.order_key)
