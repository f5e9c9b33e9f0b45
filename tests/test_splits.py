"""Replays whose hot keys are split, and scans that stay linear, against plain loops."""

from __future__ import annotations

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspark.operators import alerts as AL
from wardspark.operators import audit as A
from wardspark.operators import conversation as C

DDL = "rule_id string, cooldown_s int, event_id string, timestamp_ms bigint"


def plain_fires(rows):
    out, last = [], {}
    for rule, cool, event, at in sorted(rows, key=lambda r: (r[0], r[3], r[2])):
        if AL.next_fire(last.get(rule), at, cool):
            last[rule] = at
            out.append((rule, at))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_cooldowns_split_by_time_equal_the_walk(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("hot", 7, f"e{i:05}", int(t)) for i, t in enumerate(rng.integers(0, 400_000, 3000))]
    rows += [("gaps", 5, f"g{i:05}", int(t)) for i, t in enumerate(np.cumsum(rng.integers(0, 9_000, 200)))]
    rows += [("none", 0, f"n{i:05}", int(t)) for i, t in enumerate(rng.integers(0, 50, 80))]
    rows += [("mixed", int(c), f"m{i:05}", int(t)) for i, (t, c) in enumerate(zip(np.sort(rng.choice(90_000, 300, False)), rng.integers(1, 6, 300), strict=True))]
    df = spark.createDataFrame(rows, DDL).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        out = AL.suppress_cooldown(df)
        got = sorted((r["rule_id"], r["timestamp_ms"]) for r in out.collect())
        tasks = out.select(F.spark_partition_id().alias("p")).where("rule_id = 'hot'").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(plain_fires(rows)) and tasks > 3
    assert AL.suppress_cooldown(df.where("false")).count() == 0


def test_markers_of_one_family_take_one_pass(spark, monkeypatch):
    tokens = spark.range(20_000).select(F.format_string("FAMILY-%08d", "id").alias("token"))
    long = " ".join(f"FAMILY-{i:08d}" for i in range(0, 20_000, 7)) + " FAMILY-"
    texts = spark.createDataFrame([(1, long), (2, "FAMILY-00000001FAMILY-00000002 é FAMILY-00000002"), (3, None), (4, "family-00000001")], "id int, text string")
    begin = time.perf_counter()
    got = C.scan_canary(texts, tokens).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {1: len(range(0, 20_000, 7)), 2: 2} and time.perf_counter() - begin < 30
    monkeypatch.setattr(C, "MARKER_BYTES", 400_000)  # several passes
    assert C.scan_canary(texts, tokens).count() == len(range(0, 20_000, 7)) + 2


def test_registered_values_are_found_by_code_point(spark, monkeypatch):
    values = [("a", "pässword-Ω1"), ("b", "swordfish-9"), ("c", "short"), ("twin", "swordfish-9")]
    known = spark.createDataFrame([(k, hashlib.sha256(("s" + v).encode()).hexdigest(), len(v)) for k, v in values], "label string, digest string, length int")
    texts = spark.createDataFrame([(1, "é pässword-Ω1 swordfish-9"), (2, None), (3, ""), (4, "short")], "id int, text string")
    want = [(1, "leaked:a", 2, 13), (1, "leaked:b", 14, 25), (1, "leaked:twin", 14, 25)]
    assert sorted(map(tuple, C.scan_registered_secrets(texts, known, "s").collect())) == want
    monkeypatch.setattr(C, "DIGESTS", 1)
    assert sorted(map(tuple, C.scan_registered_secrets(texts, known, "s").collect())) == want
    assert C.scan_registered_secrets(texts, known.limit(0), "s").count() == 0


def plan_scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_facets_rules_and_histograms_take_one_scan(spark, events, tmp_path):
    events.write.parquet(str(tmp_path / "audit"))
    e = spark.read.parquet(str(tmp_path / "audit"))
    rules = [AL.AlertRule(f"r{i}", "R", "threshold", {"count": 1, "group_by": "principal_id" if i % 2 else None}) for i in range(5)]
    for out in (A.overview(e), A.overview(e, top=2), A.metric_histograms(e), A.metric_counters(e), AL.threshold_alerts(e, rules, 0)):
        assert plan_scans(out) == 1
    assert A.overview(e, top=2).filter("facet = 'application'").count() == 2


def test_threshold_ties_go_to_the_smallest_key(spark):
    e = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, None), (6, None), (7, "c")], "timestamp_ms long, principal_id string")
    rules = [AL.AlertRule("k", "Keyed", "threshold", {"count": 2, "group_by": "principal_id"}), AL.AlertRule("t", "Total", "threshold", {"count": 7}),
             AL.AlertRule("n", "None", "threshold", {"count": 8})]
    assert sorted(map(tuple, AL.threshold_alerts(e, rules, 7).select("rule_id", "title", "group_key", "count").collect())) == [
        ("k", "Keyed: a", "a", 2), ("t", "Total", None, 7)]
    assert AL.threshold_alerts(e.limit(0), rules, 7).count() == 0


def test_long_requests_come_in_numbered_parts(spark, events):
    one = events.withColumn("correlation_id", F.when(F.col("application") == "app1", "hot").otherwise(F.col("correlation_id")))
    parts = A.correlation_summary(one, most=10).filter("correlation_id = 'hot'").orderBy("part").collect()
    want = [r["stage"] for r in one.filter("correlation_id = 'hot'").orderBy("timestamp_ms", "event_id", "stage").collect()]
    assert [s for r in parts for s in r["stages"]] == want and [r["part"] for r in parts] == list(range(1, len(parts) + 1))
    assert all(len(r["stages"]) == 10 for r in parts[:-1]) and {r["events"] for r in parts} == {len(want)}
    lost = A.correlation_summary(one.withColumn("correlation_id", F.lit(None).cast("string"))).collect()
    assert len(lost) == 1 and lost[0]["stages"] is None
    assert A.correlation_summary(one.limit(0)).count() == 0


def test_histogram_labels_and_missing_values(spark, events):
    few = events.limit(20).withColumns({"latency_ms": F.lit(None).cast("double"), "tags": F.create_map(F.lit("model_latency_ms"), F.lit("75"))})
    out = A.metric_histograms(few)
    assert out.filter("metric = 'pipeline_latency_ms'").count() == 0
    seen = {r["le"]: r["n"] for r in out.filter("metric = 'model_latency_ms'").groupBy("le").agg(F.sum("bucket").alias("n")).collect()}
    assert seen["50"] == 0 and seen["100"] == 20 and seen["+Inf"] == 20 and set(seen) == {*map(str, A.MODEL_BOUNDS), "+Inf"}


def test_calls_of_one_moment_do_not_halt_each_other(spark):
    from wardspark.operators.tools import halt_after_block

    rows = [("evt_10", "block"), ("evt_9", "allow"), ("evt_11", "block")]
    calls = spark.createDataFrame([(e, "r", 5, a) for e, a in rows] + [("evt_1", "r", 6, "allow"), ("evt_2", "r", 4, "allow")],
                                  "event_id string, correlation_id string, timestamp_ms long, action string")
    assert [r["event_id"] for r in halt_after_block(calls).filter("halted").collect()] == ["evt_1"]
