"""Removal of repeated passages: the FM-index and the whole operator against plain loops."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardspark.llm import shared, substrings
from wardspark.llm.fm_index import FmIndex, WaveletTree, suffix_order

DDL = "doc_id long, text string, text_id string, key int, seg int, spans int, start int, kept int, wanted int"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=200), st.data())
def test_ranks_of_a_wavelet_tree(symbols, data):
    symbols = np.array(symbols)
    tree = WaveletTree(symbols, 8)
    at = np.array(data.draw(st.lists(st.integers(0, len(symbols)), min_size=1, max_size=20)))
    wanted = np.array(data.draw(st.lists(st.integers(0, 7), min_size=len(at), max_size=len(at))))
    assert tree.rank(wanted, at).tolist() == [int((symbols[:a] == s).sum()) for s, a in zip(wanted, at, strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=15), min_size=1, max_size=8))
def test_suffixes_are_in_order(sequences):
    text = np.array([x for s in sequences for x in [*s, 0]])
    ends = np.flatnonzero(text == 0)
    keys = []
    for i in range(len(text)):
        end = int(ends[np.searchsorted(ends, i)])
        keys.append([*(int(x) + len(ends) for x in text[i:end]), int(np.searchsorted(ends, i))])
    assert suffix_order(text, ends).tolist() == sorted(range(len(text)), key=lambda i: keys[i])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=1, max_size=30), st.integers(0, 4)), min_size=1, max_size=8), st.integers(1, 6))
def test_backward_search_covers_what_lower_numbers_hold(rows, width):
    index = FmIndex([np.array(s) for s, _ in rows], np.array([n for _, n in rows]))
    got = [np.zeros(len(s), bool) for s, _ in rows]
    for which, start in zip(*index.search(width), strict=True):
        got[which][start : start + width] = True
    least: dict[tuple, int] = {}
    for s, n in rows:
        for i in range(len(s) - width + 1):
            k = tuple(s[i : i + width])
            least[k] = min(least.get(k, n), n)
    for (s, n), covered in zip(rows, got, strict=True):
        want = np.zeros(len(s), bool)
        for i in range(len(s) - width + 1):
            if least[tuple(s[i : i + width])] < n:
                want[i : i + width] = True
        assert (covered == want).all()


def plain(rows, window):
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least: dict[tuple, int] = {}
    for d, w in texts:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def texts_of(seed: int, window: int) -> list[tuple]:
    """Passages shared at random places, cut and edited; copies; one word over and over; odd white space; nulls and repeated rows."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Wort", "wort", "é x", " ", "a\x1fb"]
    passages = [[vocabulary[i] for i in rng.integers(0, len(vocabulary), rng.integers(window, 4 * window))] for _ in range(6)]
    rows: list[tuple] = []
    for d in range(60):
        words: list[str] = []
        for _ in range(rng.integers(0, 5)):
            p = list(passages[rng.integers(0, 6)])
            a = rng.integers(0, len(p))
            p = p[a:] if rng.random() < 0.4 else p
            if p and rng.random() < 0.4:
                p[rng.integers(0, len(p))] = "edit"
            words += p + [vocabulary[i] for i in rng.integers(0, len(vocabulary), rng.integers(0, 9))]
        rows.append((int(d), "".join(w + [" ", "\n", "\t ", "\x0b", "\r\n"][rng.integers(0, 5)] for w in words)))
    rows += [(70 + i, "same " * n) for i, n in enumerate((3, 200, 350, 201))]
    rows += [rows[5], rows[5], (5, rows[9][1]), (None, rows[3][1]), (None, None), (90, None), (91, ""), (92, " \n "), (93, rows[2][1]), (93, rows[2][1]), (-4, rows[7][1])]
    return rows


@pytest.mark.parametrize(("seed", "hot", "run", "shard"), [(0, 1000, 128, 10**6), (1, 1000, 4, 60), (2, 0, 6, 60), (3, 2, 5, 200)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, hot, run, shard):
    shared.ship(spark)
    for name, value in (("HOT", hot), ("RUN", run), ("SHARD", shard), ("GRAM", 3), ("COUNTED", 500), ("SLICE", 700)):
        monkeypatch.setattr(substrings, name, value)
    rows = texts_of(seed, 8)
    docs = spark.createDataFrame([(d, t, *["x"], *[1] * 6) for d, t in rows], DDL).repartition(4)
    got = substrings.digests(substrings.without_repeats(docs, 8)).collect()
    assert Counter(map(tuple, got)) == Counter(plain(rows, 8))


def test_repeats_of_an_empty_table(spark):
    shared.ship(spark)
    docs = spark.createDataFrame([], DDL)
    assert substrings.without_repeats(docs).count() == 0
    short = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    assert sorted(map(tuple, substrings.without_repeats(short).collect())) == [(1, 2, 0, "a b"), (2, 2, 0, "a b")]


def test_passages_of_just_over_a_window_are_found(spark):
    shared.ship(spark)
    noise = lambda d, n: [f"n{d}x{i}" for i in range(n)]
    passage = [f"p{i}" for i in range(51)]
    rows = [(d, " ".join(noise(d, 30) + passage[: 51 if d % 2 else 49] + noise(-d, 30))) for d in range(1, 40)]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: 51 if d % 2 and d > 1 else 0 for d in range(1, 40)}
