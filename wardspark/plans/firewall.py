"""Scan, decide, redact, audit: the request path as one narrow plan over a table."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions.text import digest
from wardspark.operators.bundles import bundled
from wardspark.operators.decision import decision_fields, monitor_only as soften
from wardspark.operators.policy import Policy, policy_facts, policy_traces, with_facts
from wardspark.operators.redact import audit_payload, redacted_payload
from wardspark.operators.risk import assess_risk, risk_trace
from wardspark.operators.scan import ScanInput, settle
from wardspark.operators.taxonomy import annotate_threats
from wardspark.plans.stages import scan_all

PROMPT_STAGES = ("input", "retrieval", "tool_call", "tool_result", "memory_write", "tool_definition")


def decide(
    df: DataFrame,
    *,
    stage: str | Column,
    policy: Policy | None = None,
    text: Column | None = None,
    trust: Column | None = None,
    tool: Column | None = None,
    tool_risk: Column | None = None,
    context: Mapping[str, Column] | None = None,
    dry_run: bool = False,
) -> DataFrame:
    """Findings to decision: threats, risk, traces, action and its derived fields; ``stage`` may be a column."""
    policy = policy or bundled("default")
    ctx = dict(context or {})
    df = df.withColumn("findings", annotate_threats(F.col("findings"), F.lit(stage)))
    df = assess_risk(df, policy.risk, application=ctx.get("application"), tier=tool_risk)
    facts = policy_facts(
        F.col("findings"), stage=F.lit(stage), risk=F.col("risk"), payload=text,
        **({"trust": trust} if trust is not None else {}), **({"tool": tool} if tool is not None else {}), **ctx,
    )
    # Facts are materialised once: rules read plain columns, not the finding array again.
    df, names = with_facts(df, facts)
    by_risk = F.array(risk_trace(F.col("risk"), policy.id, policy.version, policy.risk, dry_run))
    df = df.withColumn(
        "policy_traces", F.concat(policy_traces(names, policy, dry_run), F.filter(by_risk, lambda t: t.isNotNull()))
    ).drop(*names.values())
    return settle(decision_fields(df), "findings", "risk", "policy_traces")


def screen(
    df: DataFrame,
    text_col: str = "text",
    *,
    stage: str = "input",
    policy: Policy | None = None,
    trust: Column | None = None,
    tool: Column | None = None,
    tool_risk: Column | None = None,
    context: Mapping[str, Column] | None = None,
    options: Mapping[str, Mapping[str, Any]] | None = None,
    monitor_only: bool = False,
    dry_run: bool = False,
    **scan_columns: Column,
) -> DataFrame:
    """Screen every row of ``df``: adds findings, risk, policy_traces, the decision and ``payload``."""
    policy = policy or bundled("default")
    ctx = dict(context or {})
    data = ScanInput(
        F.col(text_col), stage=stage, trust=trust, tool=tool, tool_risk=tool_risk,
        roles=ctx.get("roles"), authenticated=ctx.get("authenticated"), **scan_columns,
    )
    df = scan_all(df, data, policy=policy, options=options)
    df = decide(df, stage=stage, policy=policy, text=F.col(text_col), trust=data.trust_col, tool=tool,
                tool_risk=tool_risk, context=ctx, dry_run=dry_run)
    df = df.withColumn(
        "payload",
        F.when(F.col("action") == "redact", redacted_payload(F.col(text_col), F.col("findings"))).otherwise(F.col(text_col)),
    )
    if not monitor_only:
        return df
    held_back = F.col("action").isin("block", "challenge")
    return soften(df.withColumn("payload", F.when(held_back, F.col(text_col)).otherwise(F.col("payload"))))


def screen_documents(df: DataFrame, text_col: str = "text", trust: Column | None = None, **kw: Any) -> DataFrame:
    """Retrieval screening per document: ``kept`` is false for rejected ones, ``payload`` is what may enter context."""
    out = screen(df, text_col, stage="retrieval", trust=trust if trust is not None else F.lit("retrieved"), **kw)
    return out.withColumn("kept", F.col("action") != "block")


def build_audit_event(
    df: DataFrame,
    *,
    stage: str,
    text_col: str = "text",
    context: Mapping[str, Column],
    policy: Policy | None = None,
    mode: str = "redacted",
    salt: str = "",
    timestamp_ms: Column | None = None,
    extra_tags: Column | None = None,
) -> DataFrame:
    """Decided rows as audit events. The event id is a hash of (correlation, stage, seq), so re-runs agree."""
    policy = policy or bundled("default")
    null = F.lit(None).cast("string")
    text = F.col(text_col)
    is_prompt = stage in PROMPT_STAGES
    shown, labels = audit_payload(text, F.col("findings"), mode=mode, salt=salt)
    hashes = F.create_map(F.lit("prompt_sha256" if is_prompt else "response_sha256"), digest(text, salt))
    tags = [context["tags"]] if "tags" in context else []
    tags += [extra_tags] if extra_tags is not None else []
    merged = F.map_from_entries(F.array_distinct(F.concat(*[F.map_entries(t) for t in [*tags, hashes]])))
    seq = context.get("seq", F.lit(0))
    pick = lambda name: context.get(name, null)
    return df.select(
        F.concat(F.lit("evt_"), F.left(F.sha2(F.concat_ws("|", pick("correlation_id"), F.lit(stage), seq), 256), F.lit(32))).alias("event_id"),
        pick("correlation_id").alias("correlation_id"),
        (timestamp_ms if timestamp_ms is not None else F.unix_millis(F.current_timestamp())).alias("timestamp_ms"),
        F.lit(stage).alias("stage"), "action", "severity",
        *[pick(n).alias(n) for n in ("application", "environment", "instance_id", "session_id", "principal_id")],
        context.get("roles", F.array().cast("array<string>")).alias("principal_roles"),
        *[pick(n).alias(n) for n in ("tenant", "model", "provider", "trace_id", "span_id")],
        F.lit(policy.ref).alias("policy_version"), "findings", "policy_traces",
        (shown if is_prompt else null).alias("prompt"), (null if is_prompt else shown).alias("response"),
        labels.alias("redacted_fields"), F.lit(0.0).alias("latency_ms"),
        F.lit(None).cast("int").alias("tokens_in"), F.lit(None).cast("int").alias("tokens_out"), null.alias("error"),
        merged.alias("tags"), "threats", "risk",
    )
