"""Output in chunks: windows of linear size, hold-back, and the stream against the batch and a plain walk."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspark.streaming import checkpoints as K

TOKEN = "gh" + "p_" + "a1B2" * 9
DDL = "stream_id string, seq bigint, chunk string, final boolean"


def responses(seed: int) -> dict[str, list[str]]:
    rng = np.random.default_rng(seed)
    out = {}
    for r in range(24):
        words = [("word", "see [a](b)", "![x](https://e.example/q)", "<b>bold</b>", "x < y", "[open", "naïve")[rng.integers(0, 7)] for _ in range(rng.integers(0, 120))]
        if r % 3 == 0 and words:
            words[int(rng.integers(0, len(words)))] = ("ransomware payload", TOKEN)[r % 2]
        text = " ".join(words)
        cuts = sorted(rng.integers(0, len(text) + 1, 12).tolist())
        out[f"r{r}"] = [text[a:z] for a, z in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    return out


def plain(chunks: list[str], every: int, hold_back: int, constructs: bool) -> list[tuple]:
    """(checkpoint, released from, released to, broken) of a guard that reads the whole text each time."""
    text, since, k, sent, out, pending = "", 0, 0, 0, [], ""
    for i, c in enumerate(chunks):
        text, since, pending = text + c, since + len(c), pending + c
        final = i == len(chunks) - 1
        if since < every and not (final and pending):
            continue
        since, k, pending = 0, k + 1, ""
        if re.search(r"ransomware payload|\bghp_[A-Za-z0-9]{30,255}\b", text):
            return [*out, (k, sent, sent, True)]
        upto = len(text) - hold_back
        if constructs:
            cut = len(text)
            b = text.rfind("[")
            if b >= 0 and re.fullmatch(r"(?s)\[[^\]]*|\[[^\]]*\]|\[[^\]]*\]\([^)]*", text[b:]):
                cut = b - 1 if b and text[b - 1] == "!" else b
            a = text.rfind("<")
            upto = min(upto, cut, a if a >= 0 and ">" not in text[a:] else cut)
        begin, sent = sent, len(text) if final else max(sent, upto, 0)
        out.append((k, begin, sent, False))
    return out


def frame(spark, data):
    return spark.createDataFrame([(r, i, c, i == len(cs) - 1) for r, cs in data.items() for i, c in enumerate(cs)], DDL)


@pytest.mark.parametrize(("hold_back", "constructs"), [(0, False), (48, True)])
def test_batch_and_stream_equal_a_plain_walk(spark, hold_back, constructs):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    data = responses(7)
    want = {r: plain(cs, 60, hold_back, constructs) for r, cs in data.items()}
    df = frame(spark, data)
    got = {r["stream_id"]: r for r in K.checkpoint_scan(df.drop("final"), every=60, hold_back=hold_back, hold_constructs=constructs, full_scans=("banned_topics",)).collect()}
    for r, w in want.items():
        broken = bool(w) and w[-1][3]
        total = sum(map(len, data[r]))
        assert (got[r]["checkpoints"], got[r]["broken"], got[r]["delivered_chars"], got[r]["chunks"]) == (len(w), broken, w[-1][2] if broken else total, len(data[r])), r
    assert any(w and w[-1][3] for w in want.values()) and any(w and not w[-1][3] for w in want.values())
    if not constructs:
        return
    path = tempfile.mkdtemp(prefix="spark-")
    for part in range(2):  # chunks of all responses in two files, in order
        df.filter((F.col("seq") >= part * 7) & (F.col("seq") < part * 7 + 7)).coalesce(1).write.mode("append").parquet(path)
    live = K.stream_checkpoint_scan(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), every=60, hold_back=hold_back, hold_constructs=constructs, full_scans=("banned_topics",))
    name = f"released_{hold_back}"
    q = live.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    rows = sorted((r["stream_id"], r["checkpoint"], r["released_from"], r["released_to"], r["broken"]) for r in spark.table(name).collect())
    assert rows == sorted((r, *x) for r, w in want.items() for x in w)


def test_windows_grow_with_the_text_only():
    walk = K.Walk(120, 300)
    sizes = [len(made[5]) for _ in range(2000) if (made := walk.feed("some words and " * 2, False, True))]
    assert max(sizes) <= 300 + 150 and len(sizes) == 2000 * 30 // 120


def test_a_token_across_checks_is_found_and_a_cut_makes_no_word(spark):
    long = "x" * 100 + " " + TOKEN[:20]
    rows = [("a", 0, long, False), ("a", 1, TOKEN[20:] + " ", False), ("a", 2, "y " * 80, True), ("b", 0, "Q" * 400, False), ("b", 1, "Q" * 100 + TOKEN + " tail", True), (None, 0, None, False), (None, 1, "null id", True)]
    got = {r["stream_id"]: r["broken"] for r in K.checkpoint_scan(spark.createDataFrame(rows, DDL).drop("final"), every=60, carry=200, full_scans=("banned_topics",)).collect()}
    assert got == {"a": True, "b": False, "": False}
    assert K.checkpoint_scan(spark.createDataFrame([], DDL).drop("final")).count() == 0
