"""Streaming counterparts of the batch operators.

State is keyed small: counters, buckets, pins and marks per key, with watermarks or TTLs to
bound it. Checkpointed sources replace receive-time bookmarks, so late arrivals are exported
once and never skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardspark.operators.access import charge, charged_scopes, quota_table
from wardspark.operators.alerts import AlertRule, matches, next_fire, rule_hits
from wardspark.operators.anomaly import volume_spike
from wardspark.operators.audit import session_activity
from wardspark.operators.scan import with_scalars
from wardspark.sources.audit_log import fan_out
from wardspark.sources.export import at_least


def event_time(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Add the watermarked ``ts`` column the windows use."""
    return events.withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", delay)


def stream_minute_counters(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(bucket_ms, application, action, count), updated as events arrive."""
    w = event_time(events, delay).groupBy(F.window("ts", "1 minute").alias("w"), "application", "action").agg(F.count("*").alias("count"))
    return w.select(F.unix_millis("w.start").alias("bucket_ms"), "application", "action", "count")


def stream_dedupe(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per event id among re-deliveries within the delay."""
    return event_time(events, delay).dropDuplicatesWithinWatermark(["event_id"])


def stream_threshold_counts(events: DataFrame, rule: AlertRule, slide: str = "30 seconds", delay: str = "10 minutes") -> DataFrame:
    """Sliding counts of one threshold rule; rows reaching the threshold are alerts."""
    spec = rule.spec
    rows = event_time(events, delay).filter(matches(spec.get("filter") or {}))
    by = spec.get("group_by")
    key = (F.col(by) if by else F.lit(None)).cast("string").alias("group_key")
    counted = rows.groupBy(F.window("ts", f"{int(spec.get('window_s', 300))} seconds", slide).alias("w"), key).agg(F.count("*").alias("count"))
    return counted.filter(F.col("count") >= int(spec.get("count", 10))).select(
        F.lit(rule.id).alias("rule_id"), F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "group_key", "count"
    )


def stream_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """Activity per session: a known id is one session until it was silent for ``idle``; others are split by principal and gap."""
    return session_activity(event_time(events, delay), gap, idle)


def late_rows(events: DataFrame, watermark_ms: Column | int) -> DataFrame:
    """Rows behind a watermark: counted and kept aside, not lost."""
    at = watermark_ms if isinstance(watermark_ms, Column) else F.lit(watermark_ms)
    return events.filter(F.col("timestamp_ms") < at)


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def stream_split_late(events: DataFrame, on_time: Callable[[DataFrame], None], checkpoint: str, table: str,
                      delay_ms: int = 10 * 60_000, **trigger: Any):
    """Hand rows on time to ``on_time`` and keep late ones, each once, below ``table``/rows.

    A row is late if it is more than the delay behind the newest event of the batches before its own. The
    newest time is kept in a folder a batch, so a repeated batch decides as it did before and overwrites
    its own late rows. Rows without a time are on time.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema, before = "_newest long", f"{table}/mark/batch={batch_id - 1}"
        mark = spark.read.schema(schema).parquet(before) if _exists(spark, before) else spark.createDataFrame([(None,)], schema)
        held = with_scalars(batch, mark, "_newest").withColumn(
            "_late", F.coalesce(F.col("timestamp_ms") < F.col("_newest") - delay_ms, F.lit(False))).persist()
        try:
            held.filter("_late").select(*batch.columns).write.mode("overwrite").parquet(f"{table}/rows/batch={batch_id}")
            on_time(held.filter("not _late").select(*batch.columns))
            newest = held.agg(F.max("timestamp_ms").alias("_newest")).unionByName(mark).agg(F.max("_newest").cast("long").alias("_newest"))
            newest.write.mode("overwrite").parquet(f"{table}/mark/batch={batch_id}")
        finally:
            held.unpersist()
        _remove(spark, f"{table}/mark/batch={batch_id - 2}")

    return events.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def pending_letters(spark: SparkSession, dead_letters: str, sink: str) -> list[int]:
    """Batches that a sink has not taken yet, oldest first."""
    fs, at = _at(spark, f"{dead_letters}/sink={sink}")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def replay_dead_letters(spark: SparkSession, sink: Callable[[DataFrame], None], dead_letters: str, name: str, before: int | None = None) -> None:
    """Offer a sink what it has missed, oldest first; a batch that it takes leaves the table. Raises what the sink raises."""
    for batch_id in pending_letters(spark, dead_letters, name):
        if before is None or batch_id < before:
            path = f"{dead_letters}/sink={name}/batch={batch_id}"
            sink(spark.read.parquet(path).orderBy("timestamp_ms", "event_id"))
            _remove(spark, path)


def stream_export(events: DataFrame, sinks: Mapping[str, Callable[[DataFrame], None]], checkpoint: str,
                  min_severity: str = "info", errors: list[tuple[int, dict]] | None = None, dead_letters: str | None = None, **trigger: Any):
    """Forward new events to every sink, oldest first within a batch; a failing sink does not hold back the rest.

    With a ``dead_letters`` folder, what a sink did not take is kept by (sink, batch) and offered again,
    in order, before its next batch (or by ``replay_dead_letters``). A sink that takes a batch gets its
    rows once; only a driver that is lost between delivery and the end of the batch repeats it.
    """

    def offered(name: str, sink: Callable[[DataFrame], None], batch_id: int) -> Callable[[DataFrame], None]:
        def deliver(batch: DataFrame) -> None:
            if dead_letters:
                replay_dead_letters(batch.sparkSession, sink, dead_letters, name, batch_id)
            sink(batch)

        return deliver

    def forward(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        results = fan_out(batch.orderBy("timestamp_ms", "event_id"), {k: offered(k, s, batch_id) for k, s in sinks.items()})
        failed = {k: v for k, v in results.items() if v is not None}
        for name in results if dead_letters else ():
            path = f"{dead_letters}/sink={name}/batch={batch_id}"
            if name in failed:
                batch.write.mode("overwrite").parquet(path)
            else:
                _remove(spark, path)  # of an earlier attempt at this batch
        if failed and errors is not None:
            errors.append((batch_id, failed))

    return at_least(events, min_severity).writeStream.foreachBatch(forward).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


def stream_volume_spike(counters: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str, table: str,
                        horizon_ms: int = 15 * 60_000, **trigger: Any):
    """Keep the minute counters of the last horizon (append mode input) and test them after each batch.

    Each batch writes what is within the horizon to a folder of its own, from its rows and the
    folder of the batch before. A repeated batch overwrites the same folder, and no batch reads
    more than one horizon.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept, before = batch, f"{table}/batch={batch_id - 1}"
        if _exists(spark, before):
            kept = kept.unionByName(spark.read.schema(batch.schema).parquet(before))
        kept = kept.dropDuplicates(["bucket_ms", "application", "action"])
        newest = kept.agg(F.max("bucket_ms").alias("_newest"))
        recent = with_scalars(kept, newest, "_newest").filter(F.col("bucket_ms") > F.col("_newest") - horizon_ms)
        recent.select(*batch.columns).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        sink(volume_spike(spark.read.schema(batch.schema).parquet(f"{table}/batch={batch_id}")))
        _remove(spark, f"{table}/batch={batch_id - 2}")

    return counters.writeStream.outputMode("append").foreachBatch(check).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


# --- keyed state ----------------------------------------------------------------------


def _rows(batches: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """One key's rows of this micro-batch in order; the state spans micro-batches."""
    return pd.concat(list(batches)).sort_values(list(order), kind="stable")


class _Cooldown(StatefulProcessor):
    """Remembers when a rule last fired: one number a rule."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        pdf = _rows(rows, "timestamp_ms", "event_id")
        keep = []
        for at, cool in zip(pdf["timestamp_ms"], pdf["cooldown_s"], strict=True):
            fire = next_fire(last, int(at), int(cool))
            last = int(at) if fire else last
            keep.append(fire)
        if last is not None:
            self.last.update((last,))
        yield pdf[keep]

    def close(self) -> None:
        pass


def _thinned(events: DataFrame) -> DataFrame:
    return events.select("rule_id", "title", "rule_severity", "cooldown_s", "event_id", "correlation_id", "timestamp_ms")


def stream_match_alerts(events: DataFrame, rules: Sequence[AlertRule]) -> DataFrame:
    """Matching events, at most one per rule and cooldown across batches."""
    hits = _thinned(rule_hits(events, rules))
    return hits.groupBy("rule_id").transformWithStateInPandas(_Cooldown(), hits.schema, "Append", "None")


class _Pins(StatefulProcessor):
    """Pins never expire: a tool redefined after a long silence must still be reported. One small value a tool."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pin = handle.getValueState("pin", T.StructType([T.StructField("fp", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, "ts_ms", "seq")
        pinned = self.pin.get()[0] if self.pin.exists() else None
        if pinned is None:
            pinned = pdf["fingerprint"].iloc[0]
            self.pin.update((pinned,))
        yield pdf.assign(pinned=pinned, rug_pull=pdf["fingerprint"] != pinned)

    def close(self) -> None:
        pass


def stream_rug_pulls(defs: DataFrame) -> DataFrame:
    """Definitions (server, name, ts_ms, seq, fingerprint) against the first fingerprint seen of each tool."""
    held = defs.select("server", "name", "ts_ms", "seq", "fingerprint")
    schema = T.StructType([*held.schema.fields, T.StructField("pinned", T.StringType()), T.StructField("rug_pull", T.BooleanType())])
    return held.groupBy("server", "name").transformWithStateInPandas(_Pins(), schema, "Append", "None")


class _Halt(StatefulProcessor):
    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.halt = handle.getValueState("halt", T.StructType([T.StructField("ms", T.LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        since = self.halt.get()[0] if self.halt.exists() else None
        pdf = _rows(rows, "timestamp_ms", "event_id")
        flags = []
        for action, at in zip(pdf["action"], pdf["timestamp_ms"], strict=True):
            flags.append(since is not None and at > since)
            if action == "block" and (since is None or at < since):
                since = int(at)
                self.halt.update((since,))
        yield pdf.assign(halted=flags)

    def close(self) -> None:
        pass


def stream_halt(calls: DataFrame, ttl_ms: int = 24 * 3_600_000) -> DataFrame:
    """``halted`` for calls after a blocked one of the same run; marks expire after the TTL."""
    held = calls.select("correlation_id", "timestamp_ms", "event_id", "action")
    schema = T.StructType([*held.schema.fields, T.StructField("halted", T.BooleanType())])
    return held.groupBy("correlation_id").transformWithStateInPandas(_Halt(ttl_ms), schema, "Append", "ProcessingTime")


class _Buckets(StatefulProcessor):
    def __init__(self, quotas: Mapping[str, tuple[float, float]]) -> None:
        self.quotas = dict(quotas)

    def init(self, handle: StatefulProcessorHandle) -> None:
        value = T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("seen", T.DoubleType())])
        self.buckets = handle.getMapState("buckets", T.StructType([T.StructField("scope", T.StringType())]), value)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, "timestamp_ms", "event_id")
        state: dict[str, tuple[float, float]] = {}
        out = []
        for r in pdf.itertuples(index=False):
            scopes = charged_scopes(r.principal_id, r.tenant, list(r.roles) if r.roles is not None else [], r.model, self.quotas)
            for s in scopes:
                if s not in state and self.buckets.containsKey((s,)):
                    state[s] = tuple(self.buckets.getValue((s,)))
            out.append((key[0], r.event_id, *charge(state, scopes, r.timestamp_ms / 1000.0, self.quotas)))
        for scope, (tokens, seen) in state.items():
            self.buckets.updateValue((scope,), (float(tokens), float(seen)))
        yield pd.DataFrame(out, columns=["instance_id", "event_id", "allowed", "scope", "retry_after"])

    def close(self) -> None:
        pass


def stream_rate_limits(requests: DataFrame, spec: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Token buckets per instance over an unbounded request stream."""
    held = requests.select("instance_id", "event_id", "timestamp_ms", "principal_id", "tenant", "roles", "model")
    schema = "instance_id string, event_id string, allowed boolean, scope string, retry_after double"
    return held.groupBy("instance_id").transformWithStateInPandas(_Buckets(quota_table(spec)), schema, "Append", "None")
