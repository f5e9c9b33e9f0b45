"""Reading, ingesting, keeping and erasing audit events."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspark.functions.text import join_nonblank
from wardspark.operators.scan import settle
from wardspark.schema import audit_event_schema

# What a shipped event must carry, and the names it may use.
REQUIRED = ("event_id", "correlation_id", "timestamp_ms", "stage", "action", "severity", "application")
ACTION_NAMES = ("allow", "flag", "redact", "challenge", "block")
SEVERITY_NAMES = ("info", "low", "medium", "high", "critical")


def read_audit_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Newline-delimited JSON audit events."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(audit_event_schema()).json(path)


def ingest(raw: DataFrame, json_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Tolerant parse of JSON events: (accepted, rejected).

    Known fields are typed and defaulted, unknown ones kept in ``_extra`` (a JSON object), and
    rows that do not parse or miss a required field go to ``rejected`` with the reason.
    """
    schema = audit_event_schema().add("_corrupt", T.StringType())
    parsed = raw.withColumn("_e", F.from_json(json_col, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    parsed = settle(parsed, "_e")  # parsed once, however many checks read it
    e = F.col("_e")
    reason = F.when(e.isNull() | e["_corrupt"].isNotNull(), "malformed JSON or wrong field type")
    for name in REQUIRED:
        reason = reason.when(e[name].isNull(), f"missing {name}")
    reason = reason.when(~e["action"].isin(*ACTION_NAMES), "unknown action")
    reason = reason.when(~e["severity"].isin(*SEVERITY_NAMES), "unknown severity")
    judged = settle(parsed.withColumn("_reason", reason), "_reason")
    known = [f.name for f in audit_event_schema()]
    extra = F.to_json(F.map_filter(F.from_json(json_col, "map<string,string>"), lambda k, v: ~k.isin(*known)))
    empty = lambda t: F.array().cast(t)
    defaults: dict[str, Column] = {
        "environment": F.lit("unknown"), "principal_roles": empty("array<string>"), "findings": empty(schema["findings"].dataType),
        "policy_traces": empty(schema["policy_traces"].dataType), "redacted_fields": empty("array<string>"),
        "latency_ms": F.lit(0.0), "tags": F.create_map().cast("map<string,string>"),
    }
    accepted = judged.filter(F.col("_reason").isNull()).select("_e.*", extra.alias("_extra")).drop("_corrupt")
    accepted = accepted.withColumns({k: F.coalesce(F.col(k), d) for k, d in defaults.items()})
    rejected = judged.filter(F.col("_reason").isNotNull()).select(F.col(json_col).alias("record"), F.col("_reason").alias("reason"))
    return accepted, rejected


def normalise_event(events: DataFrame, received_ms: Column | None = None) -> DataFrame:
    """The stored form: lifted detector, category, threat and risk columns and a search text. Narrow."""
    fired = F.filter("findings", lambda f: f["detected"])
    category = lambda f: F.coalesce(f["category"], F.lit("unspecified"))
    own = F.coalesce("threats", F.array().cast("array<string>"))
    derived = F.array_distinct(F.flatten(F.transform(fired, lambda f: F.coalesce(f["threats"], F.array().cast("array<string>")))))
    lifted = events.withColumns({
        "detectors_fired": F.coalesce(F.transform(fired, lambda f: f["detector"]), F.array().cast("array<string>")),
        "categories": F.coalesce(F.array_sort(F.array_distinct(F.transform(fired, category))), F.array().cast("array<string>")),
        "threats": F.coalesce(F.when(F.size(own) > 0, own).otherwise(derived), F.array().cast("array<string>")),
        "risk_score": F.coalesce("risk.score", F.lit(0)),
        "risk_band": F.coalesce("risk.band", F.lit("none")),
        "risk_likelihood": F.coalesce("risk.likelihood", F.lit(0)),
        "risk_impact": F.coalesce("risk.impact", F.lit(0)),
        "received_ms": received_ms if received_ms is not None else F.unix_millis(F.current_timestamp()),
        "latency_ms": F.coalesce("latency_ms", F.lit(0.0)),
    })
    hay = join_nonblank(" ", [
        F.col("prompt"), F.col("response"), F.col("principal_id"), F.col("application"), F.col("model"),
        F.array_join(F.transform("findings", lambda f: F.coalesce(f["summary"], F.lit(""))), " "),
        F.array_join("detectors_fired", " "), F.array_join("threats", " "),
    ])
    return lifted.withColumn("search_text", F.lower(hay))


def idempotent_ingest(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows of ``batch`` to store: one per event id, none already stored. Re-delivery is normal.

    Of several deliveries the first received stays, of those received together the one with the
    smallest digest of the whole row, so that a repeated run stores the same.
    """
    seen = [F.col("received_ms")] if "received_ms" in batch.columns else []
    whole = F.struct(*batch.columns)
    fresh = batch.groupBy("event_id").agg(F.min_by(whole, F.struct(*seen, F.sha2(F.to_json(whole), 256))).alias("_row")).select("_row.*")
    return fresh if stored is None else fresh.join(stored.select("event_id"), "event_id", "left_anti")


def ingest_counts(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(accepted, duplicates) of a batch: only event ids are read."""
    ids = batch.groupBy("event_id").agg(F.count("*").alias("n"))
    if stored is not None:
        known = stored.select("event_id").distinct().withColumn("_seen", F.lit(1))
        ids = ids.join(known, "event_id", "left")
    else:
        ids = ids.withColumn("_seen", F.lit(None).cast("int"))
    new = F.count_if(F.col("_seen").isNull())
    return ids.agg(new.alias("accepted"), (F.coalesce(F.sum("n"), F.lit(0)) - new).alias("duplicates"))


def day_of(timestamp_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(timestamp_ms), "yyyy-MM-dd")


def write_audit_log(events: DataFrame, path: str, max_records_per_file: int = 1_000_000, mode: str = "append") -> None:
    """JSON lines by day, files rolled by record count."""
    (events.withColumn("day", day_of(F.col("timestamp_ms"))).write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("day").json(path))


def write_audit_table(events: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by day, sorted by application within files so its statistics prune."""
    (events.withColumn("day", day_of(F.col("timestamp_ms"))).sortWithinPartitions("day", "application").write.mode(mode)
     .partitionBy("day").parquet(path))


def fan_out(events: DataFrame, sinks: Mapping[str, Callable[[DataFrame], None]]) -> dict[str, str | None]:
    """Write the same events to every sink; one failing does not stop the rest. Returns errors by sink.

    The batch is persisted, so the sinks do not recompute it; it spills to disk and lost
    blocks are recomputed from lineage.
    """
    held = events.persist()
    results: dict[str, str | None] = {}
    try:
        for name, sink in sinks.items():
            try:
                sink(held)
                results[name] = None
            except Exception as exc:  # noqa: BLE001 - isolation between sinks is the point
                results[name] = str(exc)
    finally:
        held.unpersist()
    return results


def align_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows together; columns only one side has become nullable."""
    return old.unionByName(new, allowMissingColumns=True)


def purge_older_than(events: DataFrame, cutoff_ms: int | Column, column: str = "timestamp_ms") -> DataFrame:
    """What retention keeps: events (or counters) at or after the cutoff."""
    at = cutoff_ms if isinstance(cutoff_ms, Column) else F.lit(cutoff_ms)
    return events.filter(F.col(column) >= at)


def erase_subject(events: DataFrame, principals: DataFrame) -> DataFrame:
    """Events of everyone but the subjects (principal_id) to be erased."""
    return events.join(principals.select("principal_id").distinct(), "principal_id", "left_anti").select(*events.columns)
