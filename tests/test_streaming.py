"""Streams over files give what the batch operators give."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from wardspark.operators import access as AC
from wardspark.operators import alerts as AL
from wardspark.operators import audit as A
from wardspark.operators import tools as TL
from wardspark.streaming import jobs as J


@pytest.fixture(scope="module")
def landed(spark, events):
    """The audit view as files a stream can read, in two parts."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    path = tempfile.mkdtemp(prefix="spark-")
    held = events.withColumn("roles", F.col("principal_roles")).drop("risk", "policy_traces")
    held.repartition(2).write.mode("overwrite").parquet(path)
    return path, held


def run(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option(
        "checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def read(spark, landed, files=1):
    path, held = landed
    return spark.readStream.schema(held.schema).option("maxFilesPerTrigger", files).parquet(path)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_minute_counters_equal_batch(spark, landed):
    out = run(J.stream_minute_counters(read(spark, landed), "60 days"), "complete", "s_minutes")
    assert rows(out, "bucket_ms", "application", "action", "count") == rows(A.minute_counters(landed[1]), "bucket_ms", "application", "action", "count")


def test_dedupe_drops_redelivered_events(spark, landed):
    twice = read(spark, landed).unionByName(read(spark, landed))
    out = run(J.stream_dedupe(twice, "60 days").select("event_id"), "append", "s_dedupe")
    assert out.count() == landed[1].count()


def test_threshold_counts_and_sessions(spark, landed):
    rule = AL.AlertRule("r", "R", "threshold", {"window_s": 86400, "count": 2, "filter": {"action": ["block", "challenge"]}})
    out = run(J.stream_threshold_counts(read(spark, landed), rule, "12 hours", "60 days"), "complete", "s_threshold")
    assert out.filter("count < 2").count() == 0 and out.count() > 0
    held = run(J.stream_sessions(read(spark, landed), "30 minutes", "60 days"), "complete", "s_sessions")
    assert held.agg(F.sum("events")).first()[0] == landed[1].count()


def test_halt_spans_batches(spark, landed):
    out = run(J.stream_halt(read(spark, landed, 10)), "append", "s_halt")
    want = TL.halt_after_block(landed[1])
    assert rows(out, "event_id", "halted") == rows(want, "event_id", "halted")


def test_rate_limits_equal_replay(spark, landed):
    spec = {"*": {"rpm": 1, "burst": 3}, "role:service": {"rpm": 1, "burst": 2}}
    out = run(J.stream_rate_limits(read(spark, landed, 10), spec), "append", "s_limits")
    want = AC.replay_rate_limits(landed[1], spec)
    assert rows(out, "event_id", "allowed", "scope") == rows(want, "event_id", "allowed", "scope")


def test_match_alerts_respect_cooldown(spark, landed):
    rules = [AL.AlertRule("b", "Blocks", "match", {"action": ["block"]}, "high", 86_400)]
    out = run(J.stream_match_alerts(read(spark, landed, 10), rules), "append", "s_alerts")
    hits = AL.rule_hits(landed[1], rules).select("rule_id", "cooldown_s", "event_id", "timestamp_ms")
    assert rows(out, "event_id") == rows(AL.suppress_cooldown(hits), "event_id")
    times = [r[0] for r in out.select("timestamp_ms").orderBy("timestamp_ms").collect()]
    assert all(b - a >= 86_400_000 for a, b in zip(times, times[1:], strict=False))


def test_rug_pulls_across_batches(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    cols = "server string, name string, ts_ms bigint, seq bigint, fingerprint string"
    spark.createDataFrame([("s", "a", 1, 1, "x"), ("s", "b", 1, 2, "y")], cols).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("s", "a", 2, 3, "z"), ("s", "b", 2, 4, "y")], cols).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(cols).parquet(path)
    out = run(J.stream_rug_pulls(stream), "append", "s_rug")
    assert rows(out.filter("rug_pull"), "name", "fingerprint", "pinned") == [("a", "z", "x")]


def test_export_isolates_failing_sinks(spark, landed):
    target, errors = tempfile.mkdtemp(prefix="spark-"), []

    def broken(_):
        raise RuntimeError("down")

    q = J.stream_export(read(spark, landed), {"bad": broken, "files": lambda b: b.select("event_id").write.mode("append").parquet(target)},
                        tempfile.mkdtemp(prefix="spark-"), "high", errors)
    q.awaitTermination(120)
    want = landed[1].filter(F.col("severity").isin("high", "critical")).count()
    assert spark.read.parquet(target).count() == want and errors and "down" in errors[0][1]["bad"]


def test_volume_spike_stream(spark, landed):
    seen, table = [], tempfile.mkdtemp(prefix="spark-")
    counters = J.stream_minute_counters(read(spark, landed, 10), "1 minute")
    J.stream_volume_spike(counters, lambda d: seen.append(d.count()), tempfile.mkdtemp(prefix="spark-"), table).awaitTermination(120)
    assert seen


def test_late_rows_are_kept_aside(landed):
    cut = 1_705_276_800_000
    assert J.late_rows(landed[1], cut).count() == landed[1].filter(F.col("timestamp_ms") < cut).count()


def test_late_rows_of_a_stream_are_kept_once(spark, tmp_path):
    cols = "event_id string, timestamp_ms bigint"
    parts = [[("a", 1_000_000), ("b", 10)], [("c", 399_999), ("d", 400_000), ("e", None), ("f", 2_000_000)], [("g", 1_399_999), ("h", 1_500_000)]]
    for rows_ in parts:
        spark.createDataFrame(rows_, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen: dict[str, int] = {}

    def take(batch):
        for r in batch.collect():
            seen[r["event_id"]] = seen.get(r["event_id"], 0) + 1

    stream = lambda: spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    J.stream_split_late(stream(), take, str(tmp_path / "check"), str(tmp_path / "late"), 600_000).awaitTermination(120)
    late = lambda: sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "late/rows")).collect())
    assert late() == ["c", "g"] and seen == dict.fromkeys("abdefh", 1)
    spark.createDataFrame([("i", 1)], cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    J.stream_split_late(stream(), take, str(tmp_path / "check"), str(tmp_path / "late"), 600_000).awaitTermination(120)
    assert late() == ["c", "g", "i"] and seen == dict.fromkeys("abdefh", 1)


def test_sink_that_fails_twice_gets_every_event_once_in_order(spark, landed, tmp_path):
    taken: list[str] = []
    calls = {"n": 0}

    def flaky(batch):
        calls["n"] += 1
        if calls["n"] <= 2:
            raise RuntimeError("down")
        taken.extend(r["event_id"] for r in batch.collect())

    source = landed[1].withColumn("_part", F.pmod(F.xxhash64("event_id"), F.lit(4)))
    for i in range(4):
        source.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(landed[1].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    errors, dead = [], str(tmp_path / "dead")
    J.stream_export(stream, {"flaky": flaky}, str(tmp_path / "check"), errors=errors, dead_letters=dead).awaitTermination(120)
    want = sorted(r["event_id"] for r in landed[1].select("event_id").collect())
    assert sorted(taken) == want and len(errors) == 2 and J.pending_letters(spark, dead, "flaky") == []


def test_letters_left_at_the_end_can_be_replayed(spark, landed, tmp_path):
    def broken(_):
        raise RuntimeError("down")

    dead, got = str(tmp_path / "dead"), []
    J.stream_export(read(spark, landed, 1), {"bad": broken}, str(tmp_path / "check"), "high", dead_letters=dead).awaitTermination(120)
    left = J.pending_letters(spark, dead, "bad")
    assert len(left) > 1 and left == sorted(left)
    J.replay_dead_letters(spark, lambda b: got.extend(r[0] for r in b.select("event_id").collect()), dead, "bad")
    assert len(got) == len(set(got)) == landed[1].filter(F.col("severity").isin("high", "critical")).count()
    assert J.pending_letters(spark, dead, "bad") == []


def test_known_sessions_outlast_pauses(spark, tmp_path):
    cols = "session_id string, principal_id string, timestamp_ms bigint, action string"
    minute = 60_000
    rows_ = [("s", "p", 0, "block"), ("s", "p", 31 * minute, "allow"), (None, "p", 0, "allow"), (None, "p", 31 * minute, "allow"),
             ("", "q", 0, "allow"), (None, "q", 29 * minute, "challenge"), (None, None, 5, "allow")]
    df = spark.createDataFrame(rows_, cols)
    want = [("gap:anonymous", False, 5, 5, 1, 0), ("gap:p", False, 0, 0, 1, 0), ("gap:p", False, 31 * minute, 31 * minute, 1, 0),
            ("gap:q", False, 0, 29 * minute, 2, 1), ("s", True, 0, 31 * minute, 2, 1)]
    names = ("session", "known", "start_ms", "end_ms", "events", "blocked")
    assert rows(A.session_activity(df), *names) == want
    df.write.parquet(str(tmp_path / "in"))
    out = run(J.stream_sessions(spark.readStream.schema(cols).parquet(str(tmp_path / "in"))), "complete", "s_known")
    assert rows(out, *names) == want
