"""From findings and traces to one decision per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions.ranks import SEVERITIES, action_rank, worst
from wardspark.operators.policy import combined_action
from wardspark.operators.scan import settle
from wardspark.operators.taxonomy import first_seen_threats
from wardspark.schema import FINDING_DDL


def short_circuit(findings: Column) -> Column:
    """Findings up to the first certain block: what a request path would have reported."""
    certain = F.transform(findings, lambda f: f["detected"] & (f["action"] == "block") & (f["score"] >= 0.99))
    at = F.array_position(certain, F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(findings, F.lit(1), at)).otherwise(findings)


def error_finding(detector: str, error: Column, fail_mode: str) -> Column:
    """What stands in for a scan that failed on a row."""
    closed = fail_mode == "closed"
    return F.struct(
        F.lit(detector).alias("detector"), F.lit(closed).alias("detected"),
        F.lit(1.0 if closed else 0.0).alias("score"), F.lit("high" if closed else "low").alias("severity"),
        F.lit("block" if closed else "flag").alias("action"),
        F.lit(f"{detector} failed; fail-{fail_mode}").alias("summary"),
        F.lit("firewall_internal").alias("category"), F.array().alias("spans"),
        F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("double").alias("elapsed_ms"),
        error.alias("error"), F.array().alias("threats"),
    ).cast(FINDING_DDL)


def with_error_policy(finding: Column, error: Column, detector: str, fail_mode: str) -> Column:
    """``finding``, or the error finding where ``error`` is set."""
    return F.when(error.isNotNull(), error_finding(detector, error, fail_mode)).otherwise(finding)


def reasons(findings: Column) -> Column:
    """Fired findings, most severe action first, then highest score."""
    keyed = F.transform(
        F.filter(findings, lambda f: f["detected"]),
        lambda f, i: F.struct((-action_rank(f["action"])).alias("a"), (-f["score"]).alias("s"), i.alias("i"), f.alias("f")),
    )
    return F.transform(F.sort_array(keyed), lambda k: k["f"])


def decision_fields(df: DataFrame, findings: str = "findings", traces: str = "policy_traces") -> DataFrame:
    """Add action, severity, threats, reasons (detector names), allowed and blocked."""
    f = F.col(findings)
    out = (
        df.withColumn("action", combined_action(f, F.col(traces)))
        .withColumn("severity", worst(F.transform(F.filter(f, lambda x: x["detected"]), lambda x: x["severity"]), SEVERITIES, "info"))
        .withColumn("threats", first_seen_threats(f))
        .withColumn("reasons", F.transform(reasons(f), lambda x: x["detector"]))
        .withColumn("allowed", F.col("action").isin("allow", "flag", "redact"))
        .withColumn("blocked", F.col("action") == "block")
    )
    return settle(out, "action", "severity", "threats", "reasons", "allowed", "blocked")


def fail_closed(df: DataFrame, fail_mode: Column) -> DataFrame:
    """A closed failure never ends as a plain allow: it blocks and says why."""
    engaged = (fail_mode == "closed") & (F.col("action") == "allow")
    why = F.struct(
        F.lit("pipeline").alias("detector"), F.lit(True).alias("detected"), F.lit(1.0).alias("score"),
        F.lit("high").alias("severity"), F.lit("block").alias("action"),
        F.lit("evaluation incomplete; stage fails closed").alias("summary"),
        F.lit("firewall_internal").alias("category"), F.array().alias("spans"),
        F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("double").alias("elapsed_ms"),
        F.lit(None).cast("string").alias("error"), F.array().alias("threats"),
    ).cast(FINDING_DDL)
    return df.withColumn("_closed", F.coalesce(engaged, F.lit(False))).withColumns({
        "findings": F.when(F.col("_closed"), F.concat("findings", F.array(why))).otherwise(F.col("findings")),
        "action": F.when(F.col("_closed"), "block").otherwise(F.col("action")),
        "severity": F.when(F.col("_closed"), "high").otherwise(F.col("severity")),
    }).drop("_closed")


def monitor_only(df: DataFrame) -> DataFrame:
    """Observe without enforcing: block and challenge become flag, findings are marked."""
    softened = F.col("action").isin("block", "challenge")
    mark = lambda f: f.withField(
        "evidence",
        F.when(f["detected"], F.concat(F.lit('{"monitor_only":true'), F.when(
            f["evidence"].isNull() | (f["evidence"] == "{}"), F.lit("}")
        ).otherwise(F.concat(F.lit(","), F.substring(f["evidence"], F.lit(2), F.length(f["evidence"])))))).otherwise(f["evidence"]),
    )
    return df.withColumns({
        "findings": F.when(softened, F.transform("findings", mark)).otherwise(F.col("findings")),
        "action": F.when(softened, "flag").otherwise(F.col("action")),
    })


def block_message(traces: Column, correlation_id: Column) -> Column:
    """The first blocking rule's own words, else a generic line with the reference."""
    noted = F.filter(traces, lambda t: t["matched"] & (t["action"] == "block") & (F.coalesce(t["note"], F.lit("")) != ""))
    return F.coalesce(
        F.try_element_at(noted, F.lit(1))["note"],
        F.concat(F.lit("This request was blocked by the AI firewall. Reference: "), correlation_id),
    )


def resolve_challenges(df: DataFrame, confirmations: DataFrame, key: str = "correlation_id") -> DataFrame:
    """Challenged rows become allow where approved, block otherwise; no answer means block."""
    answers = confirmations.groupBy(key).agg(F.bool_and("approved").alias("_approved"))
    settled = F.when(F.col("action") != "challenge", F.col("action")).when(F.col("_approved"), "allow").otherwise("block")
    return df.join(answers, key, "left").withColumn("action", settled).drop("_approved")
