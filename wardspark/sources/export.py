"""SIEM formats as one string column per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions.ranks import SEVERITIES, lookup

# Severity scales, syslog facility, exported fields in order.
CEF_BY_ACTION = {"allow": 1, "flag": 4, "redact": 4, "challenge": 7, "block": 8}
CEF_BY_SEVERITY = {"info": 1, "low": 3, "medium": 5, "high": 8, "critical": 10}
OTLP_SEVERITY = {"info": 9, "low": 9, "medium": 13, "high": 17, "critical": 21}
SYSLOG_FACILITY = 13
SIEM_FIELDS = (
    "event_id", "correlation_id", "timestamp_ms", "stage", "action", "severity", "application", "environment", "instance_id",
    "principal_id", "tenant", "model", "provider", "trace_id", "policy_version", "detectors_fired", "categories", "findings",
    "latency_ms", "prompt", "response", "tags", "threats", "risk_score", "risk_band",
)
OTLP_ATTRIBUTES = (
    "event_id", "correlation_id", "action", "stage", "application", "environment", "principal_id", "tenant", "model",
    "policy_version",
)


def to_siem_json(events: DataFrame) -> DataFrame:
    """One clean JSON record per event, fields in a fixed order, nulls kept."""
    return events.select("event_id", F.to_json(F.struct(*SIEM_FIELDS), {"ignoreNullFields": "false"}).alias("record"))


def _first_fired(field: str, fallback: Column) -> Column:
    fired = F.filter("findings", lambda f: f["detected"])
    return F.when(F.size(fired) > 0, F.try_element_at(fired, F.lit(1))[field]).otherwise(fallback)


def _headline() -> Column:
    return _first_fired("summary", F.concat("action", F.lit(" at "), "stage"))


def _header(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def _extension(value: Column) -> Column:
    out = value.cast("string")
    for raw, shown in (("\\", "\\\\"), ("=", "\\="), ("\n", "\\n"), ("\r", "")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def cef_record(vendor: str = "Wardspark", product: str = "LLM Traffic Security", version: str = "1.0",
               signature_prefix: str = "audit") -> Column:
    """A CEF:0 record; empty extension values are left out."""
    level = F.greatest(lookup(F.col("action"), CEF_BY_ACTION, 1), lookup(F.col("severity"), CEF_BY_SEVERITY, 1))
    parts = [F.lit("CEF:0"), F.lit(vendor), F.lit(product), F.lit(version),
             F.coalesce(_first_fired("category", F.concat(F.lit(signature_prefix + "."), "stage")), F.lit("None")),
             F.left(F.coalesce(_headline(), F.lit("None")), F.lit(200)), level.cast("string")]
    header = F.concat_ws("|", *[_header(p) for p in parts])
    pairs: list[tuple[str, Column]] = [
        ("rt", F.col("timestamp_ms")), ("externalId", F.col("event_id")),
        ("cs1Label", F.lit("correlationId")), ("cs1", F.col("correlation_id")),
        ("cs2Label", F.lit("detectors")), ("cs2", F.array_join("detectors_fired", ",")),
        ("cs3Label", F.lit("policyVersion")), ("cs3", F.col("policy_version")),
        ("cs4Label", F.lit("traceId")), ("cs4", F.col("trace_id")),
        ("act", F.col("action")), ("outcome", F.when(F.col("action").isin("block", "challenge"), "failure").otherwise("success")),
        ("suser", F.col("principal_id")), ("duser", F.col("tenant")), ("dproc", F.col("model")), ("app", F.col("application")),
        ("deviceProcessName", F.col("stage")), ("cn1Label", F.lit("latencyMs")), ("cn1", F.col("latency_ms")),
        ("cs5Label", F.lit("owaspThreats")), ("cs5", F.array_join("threats", ",")),
        ("cn2Label", F.lit("riskScore")), ("cn2", F.coalesce("risk_score", F.lit(0))),
        ("cs6Label", F.lit("riskBand")), ("cs6", F.coalesce("risk_band", F.lit("none"))),
        ("deviceExternalId", F.col("instance_id")),
    ]
    kept = [F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(k + "="), _extension(c))) for k, c in pairs]
    return F.concat(header, F.lit("|"), F.concat_ws(" ", *kept))


def to_cef(events: DataFrame, **names: str) -> DataFrame:
    return events.select("event_id", cef_record(**names).alias("record"))


def to_syslog(events: DataFrame, app_name: str = "wardspark", **names: str) -> DataFrame:
    """RFC 5424 lines carrying CEF; priority is facility 13 times 8 plus the mapped severity."""
    level = F.greatest(F.lit(0), F.least(F.lit(7), 7 - F.floor(lookup(F.col("severity"), CEF_BY_SEVERITY, 1) / 2)))
    stamp = F.date_format(F.timestamp_seconds(F.expr("coalesce(timestamp_ms, 0) div 1000")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    host = F.coalesce(F.when(F.col("application") != "", F.col("application")), F.lit(app_name))
    line = F.concat(F.lit("<"), (level + SYSLOG_FACILITY * 8).cast("int").cast("string"), F.lit(">1 "), stamp, F.lit(" "), host,
                    F.lit(f" {app_name} - - - "), cef_record(**names))
    return events.select("event_id", line.alias("record"))


def to_otlp_records(events: DataFrame, prefix: str = "audit") -> DataFrame:
    """OpenTelemetry log records as JSON."""
    def kv(key: str, value: Column) -> Column:
        text = F.coalesce(value.cast("string"), F.lit(""))
        return F.struct(F.lit(f"{prefix}.{key}").alias("key"), F.struct(text.alias("stringValue")).alias("value"))

    attrs = [kv(a, F.col(a)) for a in OTLP_ATTRIBUTES]
    attrs += [kv("detectors", F.array_join("detectors_fired", ",")), kv("categories", F.array_join("categories", ",")),
              kv("threats", F.array_join("threats", ",")), kv("risk_score", F.coalesce("risk_score", F.lit(0))),
              kv("risk_band", F.coalesce("risk_band", F.lit("none")))]
    record = F.struct(
        (F.coalesce("timestamp_ms", F.lit(0)) * 1_000_000).cast("bigint").cast("string").alias("timeUnixNano"),
        lookup(F.col("severity"), OTLP_SEVERITY, 9).alias("severityNumber"),
        F.upper(F.coalesce("severity", F.lit("info"))).alias("severityText"),
        F.struct(F.coalesce(_headline(), F.lit("None")).alias("stringValue")).alias("body"),
        F.array(*attrs).alias("attributes"),
        F.when(F.col("trace_id") != "", F.col("trace_id")).alias("traceId"),
        F.when(F.col("span_id") != "", F.col("span_id")).alias("spanId"),
    )
    return events.select("event_id", F.to_json(record).alias("record"))


def at_least(events: DataFrame, min_severity: str = "info") -> DataFrame:
    at = SEVERITIES.index(min_severity) if min_severity in SEVERITIES else 0
    return events.filter(F.col("severity").isin(*SEVERITIES[at:]))
