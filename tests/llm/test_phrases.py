"""Collocations against plain counting, with many steps and buckets, hot pairs and a full bitmap."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardspark.llm import phrases, shared

DDL = "doc_id long, text string, lang string, kind int, h1 int, n int, word string, a int, phrase string, bucket int"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 3), st.integers(1, 4)), min_size=1, max_size=120), st.integers(1, 9), st.sampled_from([1, 4, 1000]))
def test_equal_partitions_are_counts(rows, least, small):
    keys = [np.array([r[d] for r in rows], np.uint64) for d in range(3)]
    weights = np.array([r[3] for r in rows])
    before, phrases.SMALL = phrases.SMALL, small
    try:
        at, total, at2, total2 = phrases.partitions(keys, weights, least, 2)
        plain, count, _, _ = phrases.partitions(keys, None, 1)
    finally:
        phrases.SMALL = before
    full, pairs, each = Counter(), Counter(), Counter()
    for a, b, c, w in rows:
        full[a, b, c] += w
        pairs[a, b] += w
        each[a, b, c] += 1
    name = lambda i, n=3: tuple(int(keys[d][i]) for d in range(n))
    assert [(name(i), t) for i, t in zip(at, total, strict=True)] == sorted((k, v) for k, v in full.items() if v >= least)
    assert sorted((name(i, 2), t) for i, t in zip(at2, total2, strict=True)) == sorted((k, v) for k, v in pairs.items() if v >= least)
    assert [(name(i), t) for i, t in zip(plain, count, strict=True)] == sorted(each.items())


def plain(rows, least, limit, cover=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f.update(("und" if lang is None else lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang in {k[0] for k in f}:
        n = sum(v for k, v in f.items() if k[0] == lang and len(k) == 2)
        made = []
        for key, a in f.items():
            w = key[1:]
            if key[0] != lang or len(w) < 2 or a < least:
                continue
            if len(w) == 2 and any(x >= least and 100 * x >= cover * a for k, x in f.items() if k[0] == lang and len(k) == 4 and w in (k[1:3], k[2:4])):
                continue
            cuts = [(1_000_000 * a * a // (f[lang, *w[:j]] * f[lang, *w[j:]]), j) for j in range(1, len(w))]
            score, j = min(cuts)
            made.append((-score, -a, " ".join(w).encode(), f[lang, *w[:j]], f[lang, *w[j:]]))
        out += [(lang, rank, p.decode(), -a, x, y, n, -s) for rank, (s, a, p, x, y) in enumerate(sorted(made)[:limit], 1)]
    return sorted(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "The", "of", "en", "es", "und", "a-b", "é", "É", "x\x1fy", " w", "'t", "1", "日本"]
    rows = []
    for i in range(150):
        words = [vocabulary[min(13, int(rng.zipf(1.6)) - 1)] + ["", "", "", ",", ".", "!", "\n", "\x0b", ";", "?\r\n"][rng.integers(0, 10)] for _ in range(rng.integers(0, 60))]
        rows.append(([None, "en", "es", "und", "", "日本"][i % 6], [" ", "\t", "  "][i % 3].join(words)))
    rows += [("en", None), (None, None), ("en", ""), ("en", " .,. "), ("en", "over and " * 400), *[("de", "same row here")] * 30, ("fr", "rare pair")]
    return rows


@pytest.mark.parametrize(("seed", "least", "limit", "sizes"), [(0, 10, 2000, {}), (1, 10, 6, {"BUCKET": 50, "FAN": 3, "CHUNK": 400, "SLICE": 600, "SMALL": 20}), (2, 1, 40, {"BUCKET": 500, "HOT": 0, "BITMAP": 6})])
def test_collocations_equal_plain_counts(spark, monkeypatch, seed, least, limit, sizes):
    shared.ship(spark)
    for name, value in sizes.items():
        monkeypatch.setattr(phrases, name, value)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, lang, *[1] * 3, "x", 1, "x", 1) for i, (lang, t) in enumerate(rows)], DDL).repartition(4)
    got = phrases.collocations(docs, least, limit=limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == plain(rows, least, limit)


def test_phrases_of_an_empty_table(spark):
    shared.ship(spark)
    assert phrases.collocations(spark.createDataFrame([], DDL)).count() == 0
    few = spark.createDataFrame([(1, "a b c", None)], "doc_id long, text string, lang string")
    assert phrases.collocations(few).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_007, 7_000_000_000_003, 9_000_000_000_001
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases._score("a", "l", "r")).first()[0]
    assert got == 1_000_000 * a * a // (left * right)


@pytest.mark.parametrize("sizes", [{"NAMES": 5, "TOLD": 10, "CHUNK": 400, "SLICE": 600}, {"NAMES": 1, "TOLD": 0}])
def test_words_sent_in_small_lots_give_the_same(spark, monkeypatch, sizes):
    shared.ship(spark)
    rows = [("en" if i % 3 else None, " ".join(f"w{(i * j) % 23}" for j in range(1, 40))) for i in range(60)]
    for name, value in sizes.items():
        monkeypatch.setattr(phrases, name, value)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["score"]) for r in phrases.collocations(docs, 10, 50, 2000).collect()}
    monkeypatch.undo()
    want = {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["score"]) for r in phrases.collocations(docs, 10, 50, 2000).collect()}
    assert got == want and got


def test_words_leave_a_task_before_its_texts_end(monkeypatch):
    monkeypatch.setattr(phrases, "NAMES", 50)

    class Sent:
        value = (np.full(1 << (phrases.BITMAP - 6), ~np.uint64(0)), np.zeros(0, np.uint64))

    taken = []

    def batches():
        for i in range(4):
            taken.append(i)
            yield pa.RecordBatch.from_pydict({"lang": ["en"], "text": [" ".join(f"w{i}x{j}" for j in range(60))]})

    first = next(iter(phrases._read(Sent, 4)(batches())))
    assert first.column("kind")[0].as_py() == phrases._WORDS and taken == [0]
