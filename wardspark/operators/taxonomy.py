"""Threat catalogue and the naming of findings in its terms."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.functions import sqltext


class Threat(NamedTuple):
    id: str
    framework: str
    title: str
    base_impact: int
    atlas: tuple[str, ...] = ()
    detectors: tuple[str, ...] = ()
    controls: tuple[str, ...] = ()
    coverage: str = "covered"


LLM, ASI, MCP = "OWASP LLM Top 10 (2025)", "OWASP Agentic Top 10 (2026)", "OWASP MCP Top 10 (2025)"

# The published lists, impacts and technique ids, in catalogue order.
CATALOG = (
    Threat("LLM01", LLM, "Prompt Injection", 4, ("AML.T0051", "AML.T0054"), ("prompt_injection", "llm_classifier", "trajectory", "authority_claim")),
    Threat("LLM02", LLM, "Sensitive Information Disclosure", 4, ("AML.T0057", "AML.T0024"), ("pii", "secrets", "secret_leakage"), ("redaction",)),
    Threat("LLM03", LLM, "Supply Chain", 4, ("AML.T0010",), ("tool_poisoning",), ("model_allowlist",), "partial"),
    Threat("LLM04", LLM, "Data and Model Poisoning", 4, ("AML.T0020", "AML.T0070"), ("prompt_injection",), (), "partial"),
    Threat("LLM05", LLM, "Improper Output Handling", 4, ("AML.T0024",), ("unsafe_output",)),
    Threat("LLM06", LLM, "Excessive Agency", 4, ("AML.T0053",), ("token_flow",), ("tool_rbac", "tool_risk_tiers", "human_confirmation")),
    Threat("LLM07", LLM, "System Prompt Leakage", 3, ("AML.T0056",), ("system_prompt_leakage", "prompt_injection")),
    Threat("LLM08", LLM, "Vector and Embedding Weaknesses", 3, ("AML.T0070",), ("prompt_injection", "pii", "secrets"), (), "partial"),
    Threat("LLM09", LLM, "Misinformation", 2, (), ("groundedness",), (), "partial"),
    Threat("LLM10", LLM, "Unbounded Consumption", 3, ("AML.T0029", "AML.T0034"), ("resource_abuse",), ("rate_limits", "token_budgets")),
    Threat("ASI01", ASI, "Agent Goal Hijack", 4, ("AML.T0051.001",), ("prompt_injection", "trajectory", "token_flow")),
    Threat("ASI02", ASI, "Tool Misuse & Exploitation", 4, ("AML.T0053",), ("token_flow", "code_execution"), ("tool_rbac", "tool_risk_tiers")),
    Threat("ASI03", ASI, "Identity & Privilege Abuse", 4, (), ("authority_claim",), ("authentication", "rbac", "tool_rbac")),
    Threat("ASI04", ASI, "Agentic Supply Chain Vulnerabilities", 4, ("AML.T0010",), ("tool_poisoning",), ("tool_definition_pinning",), "partial"),
    Threat("ASI05", ASI, "Unexpected Code Execution (RCE)", 5, (), ("code_execution", "unsafe_output")),
    Threat("ASI06", ASI, "Memory & Context Poisoning", 4, ("AML.T0080", "AML.T0070"), ("prompt_injection", "token_flow"), ("memory_provenance",)),
    Threat("ASI07", ASI, "Insecure Inter-Agent Communication", 3, (), ("prompt_injection", "authority_claim"), ("trust_levels",), "partial"),
    Threat("ASI08", ASI, "Cascading Failures", 3, (), (), ("kill_switch", "fail_modes"), "partial"),
    Threat("ASI09", ASI, "Human-Agent Trust Exploitation", 3, (), ("authority_claim", "groundedness"), ("human_confirmation",), "partial"),
    Threat("ASI10", ASI, "Rogue Agents", 4, (), ("trajectory", "token_flow"), ("kill_switch", "anomaly_detection"), "partial"),
    Threat("MCP01", MCP, "Token Mismanagement & Secret Exposure", 5, ("AML.T0057",), ("secrets", "secret_leakage"), ("redaction",)),
    Threat("MCP02", MCP, "Privilege Escalation via Scope Creep", 4, (), ("token_flow",), ("tool_rbac", "tool_risk_tiers")),
    Threat("MCP03", MCP, "Tool Poisoning", 4, ("AML.T0051.001",), ("tool_poisoning",), ("tool_definition_pinning",)),
    Threat("MCP04", MCP, "Software Supply Chain Attacks & Dependency Tampering", 4, ("AML.T0010",), (), ("tool_definition_pinning",), "partial"),
    Threat("MCP05", MCP, "Command Injection & Execution", 5, (), ("code_execution",)),
    Threat("MCP06", MCP, "Prompt Injection via Contextual Payloads", 4, ("AML.T0051.001",), ("prompt_injection",)),
    Threat("MCP07", MCP, "Insufficient Authentication & Authorization", 4, (), (), ("authentication", "rbac", "tool_rbac"), "partial"),
    Threat("MCP08", MCP, "Lack of Audit and Telemetry", 3, (), (), ("audit_events", "metrics", "tracing", "siem_export")),
    Threat("MCP09", MCP, "Shadow MCP Servers", 3, (), (), ("tool_registry", "fleet_inventory"), "observed"),
    Threat("MCP10", MCP, "Context Injection & Over-Sharing", 3, (), ("pii", "secrets"), ("redaction",)),
)
BY_ID = {t.id: t for t in CATALOG}

# Finding category to threats, additions by stage, replacements by stage.
CATEGORY_THREATS = {
    "prompt_injection": ("LLM01", "ASI01"),
    "authority_manipulation": ("LLM01", "ASI03", "ASI09"),
    "multi_turn_attack": ("LLM01", "ASI01"),
    "credential_exposure": ("LLM02", "MCP01"),
    "data_leakage": ("LLM02", "MCP01"),
    "sensitive_data": ("LLM02", "MCP10"),
    "hallucination": ("LLM09",),
    "unsafe_flow": ("LLM06", "ASI02", "ASI01"),
    "excessive_agency": ("LLM06", "ASI02", "MCP02"),
    "memory_provenance_laundering": ("ASI06",),
    "access_control": ("ASI03", "MCP07"),
    "rate_limit": ("LLM10",),
    "system_prompt_leakage": ("LLM07",),
    "improper_output": ("LLM05",),
    "code_execution": ("ASI05", "MCP05"),
    "tool_poisoning": ("MCP03", "ASI04", "LLM03"),
    "unbounded_consumption": ("LLM10",),
}
STAGE_THREATS = {
    ("prompt_injection", "retrieval"): ("LLM08", "LLM04"),
    ("prompt_injection", "tool_result"): ("MCP06",),
    ("prompt_injection", "memory_write"): ("ASI06",),
    ("prompt_injection", "memory_read"): ("ASI06",),
    ("prompt_injection", "output"): ("LLM05",),
    ("prompt_injection", "tool_definition"): ("MCP03", "ASI04"),
    ("sensitive_data", "retrieval"): ("LLM08",),
    ("credential_exposure", "tool_call"): ("ASI02",),
    ("authority_manipulation", "tool_result"): ("ASI07",),
}
STAGE_OVERRIDES = {
    ("unsafe_flow", "memory_write"): ("ASI06",),
    ("unsafe_flow", "memory_read"): ("ASI06",),
}
INTERNAL_CATEGORIES = ("firewall_internal", "policy", "unspecified")

_NONE = "array<string>"


def threat_catalog(spark: SparkSession) -> DataFrame:
    """The 30 threats as a dimension table."""
    rows = [
        (i, t.id, t.framework, t.title, t.base_impact, list(t.atlas), list(t.detectors), list(t.controls), t.coverage)
        for i, t in enumerate(CATALOG)
    ]
    return spark.createDataFrame(
        rows,
        "position int, id string, framework string, title string, base_impact int, atlas array<string>, "
        "detectors array<string>, controls array<string>, coverage string",
    )


def _map(table: dict) -> Column:
    return F.expr(sqltext.mapping({"|".join(k) if isinstance(k, tuple) else k: list(v) for k, v in table.items()}))


def threats_for(category: Column, stage: Column, explicit: Column | None = None) -> Column:
    """Threat ids of a fired finding, in stable order; unknown ids are dropped."""
    none = F.array().cast(_NONE)
    key = F.concat(category, F.lit("|"), stage)
    mapped = F.coalesce(
        F.element_at(_map(STAGE_OVERRIDES), key),
        F.concat(
            F.coalesce(F.element_at(_map(CATEGORY_THREATS), category), none),
            F.coalesce(F.element_at(_map(STAGE_THREATS), key), none),
        ),
    )
    named = mapped if explicit is None else F.concat(mapped, F.coalesce(explicit, none))
    known = F.array_intersect(F.array_distinct(named), sqltext.strings(BY_ID))
    return F.when(category.isin(*INTERNAL_CATEGORIES), none).otherwise(known)


def annotate_threats(findings: Column, stage: Column) -> Column:
    """Findings with ``threats`` filled; what a scan named itself is kept in addition."""

    def one(f: Column) -> Column:
        ids = F.when(f["detected"], threats_for(f["category"], stage, f["threats"])).otherwise(F.array().cast(_NONE))
        return f.withField("threats", ids)

    return F.transform(findings, one)


def threat_ids(findings: Column) -> Column:
    """Union over fired findings, in catalogue order."""
    seen = F.flatten(F.transform(F.filter(findings, lambda f: f["detected"]), lambda f: f["threats"]))
    return F.array_intersect(sqltext.strings(BY_ID), seen)


def first_seen_threats(findings: Column) -> Column:
    """Union over fired findings, in order of appearance."""
    return F.array_distinct(F.flatten(F.transform(F.filter(findings, lambda f: f["detected"]), lambda f: f["threats"])))


def atlas_for(threats: Column) -> Column:
    table = _map({t.id: t.atlas for t in CATALOG if t.atlas})
    return F.array_distinct(
        F.flatten(F.transform(threats, lambda t: F.coalesce(F.element_at(table, t), F.array().cast(_NONE))))
    )


def coverage_report(
    spark: SparkSession,
    enabled: Sequence[str] | None = None,
    hits: DataFrame | None = None,
    frameworks: Sequence[str] = (LLM, ASI, MCP),
) -> DataFrame:
    """What a deployment covers given the scans switched on; ``hits`` is (threat, events)."""
    cat = threat_catalog(spark).filter(F.col("framework").isin(*frameworks))
    on = F.col("detectors") if enabled is None else F.array_intersect("detectors", F.lit(list(enabled)).cast(_NONE))
    missing = F.array_except("detectors", "active_detectors")
    out = cat.withColumn("active_detectors", on).withColumn("missing_detectors", missing)
    gone = (F.size("detectors") > 0) & (F.size("active_detectors") == 0)
    status = (
        F.when(gone & (F.size("controls") > 0), "observed").when(gone, "disabled")
        .when((F.size("missing_detectors") > 0) & (F.col("coverage") == "covered"), "partial")
        .otherwise(F.col("coverage"))
    )
    out = out.withColumn("status", status)
    if hits is None:
        return out.withColumn("hits", F.lit(0).cast("bigint"))
    counts = hits.select(F.col("threat").alias("id"), F.col("events").cast("bigint").alias("hits"))
    # At most one row per catalogue entry survives the semi join's key set.
    return out.join(counts, "id", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint")))
