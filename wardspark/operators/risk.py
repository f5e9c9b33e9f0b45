"""Likelihood-by-impact risk, row-local: no explode, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions.ranks import ACTIONS, BANDS, TIERS, band_of, lookup
from wardspark.operators.scan import settle
from wardspark.operators.taxonomy import BY_ID
from wardspark.schema import CELL_DDL, RISK_DDL, TRACE_DDL

# Default matrix settings.
LIKELIHOOD_CUTS = (0.35, 0.5, 0.65, 0.85)
BAND_ACTIONS = {"none": "allow", "low": "allow", "medium": "flag", "high": "block", "critical": "block"}
TOOL_IMPACT = {"low": 2, "medium": 3, "high": 4, "critical": 5}
UNKNOWN_IMPACT = 3


@dataclass(frozen=True)
class RiskConfig:
    enforce: bool = True
    actions: Mapping[str, str] = field(default_factory=lambda: dict(BAND_ACTIONS))
    impact: Mapping[str, int] = field(default_factory=dict)
    tool_impact: Mapping[str, int] = field(default_factory=lambda: dict(TOOL_IMPACT))
    cuts: tuple[float, ...] = LIKELIHOOD_CUTS
    application_impact: Mapping[str, int] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, doc: Mapping[str, Any] | None) -> RiskConfig:
        """A policy document's ``risk`` section; anything out of range is refused."""
        doc = dict(doc or {})
        known = {"enforce", "actions", "impact", "tool_impact", "likelihood_cuts", "application_impact"}
        if set(doc) - known:
            raise ValueError(f"unknown risk keys: {sorted(set(doc) - known)}")
        actions = {**BAND_ACTIONS, **(doc.get("actions") or {})}
        tools = {**TOOL_IMPACT, **(doc.get("tool_impact") or {})}
        impact = dict(doc.get("impact") or {})
        apps = dict(doc.get("application_impact") or {})
        cuts = tuple(float(c) for c in doc.get("likelihood_cuts") or LIKELIHOOD_CUTS)
        if set(actions) - set(BANDS) or set(actions.values()) - set(ACTIONS) or set(tools) - set(TIERS):
            raise ValueError("risk: unknown band, action or tier")
        if set(impact) - set(BY_ID):
            raise ValueError(f"risk.impact: unknown threats {sorted(set(impact) - set(BY_ID))}")
        if not all(1 <= int(v) <= 5 for v in (*tools.values(), *impact.values(), *apps.values())):
            raise ValueError("risk: impacts run from 1 to 5")
        if len(cuts) != 4 or list(cuts) != sorted(cuts) or not all(0 < c <= 1 for c in cuts):
            raise ValueError("risk.likelihood_cuts must be four ascending values in (0, 1]")
        return cls(bool(doc.get("enforce", True)), actions, impact, tools, cuts, apps)


def likelihood(score: Column, cuts: tuple[float, ...] = LIKELIHOOD_CUTS) -> Column:
    level = F.lit(1)
    for cut in cuts:
        level = level + (score >= cut).cast("int")
    return level


def impact(
    threat: Column, config: RiskConfig | None = None, application: Column | None = None, tier: Column | None = None
) -> Column:
    """Base or overridden impact, raised by the application's floor and the tool's tier."""
    config = config or RiskConfig()
    base = lookup(threat, {**{k: t.base_impact for k, t in BY_ID.items()}, **config.impact}, UNKNOWN_IMPACT)
    floors = [base]
    if application is not None and config.application_impact:
        floors.append(lookup(application, config.application_impact))
    if tier is not None:
        floors.append(lookup(tier, config.tool_impact))
    raised = F.greatest(*floors) if len(floors) > 1 else base
    return F.greatest(F.lit(1), F.least(F.lit(5), raised)).cast("int")


def threat_cells(
    findings: Column, config: RiskConfig | None = None, application: Column | None = None, tier: Column | None = None
) -> Column:
    """One matrix cell per threat of the row, worst residual first."""
    config = config or RiskConfig()
    fired = F.filter(findings, lambda f: f["detected"])
    names = F.array_distinct(F.flatten(F.transform(fired, lambda f: f["threats"])))

    def cell(t: Column, pos: Column) -> Column:
        group = F.filter(fired, lambda f: F.array_contains(f["threats"], t))

        def of(fs: Column) -> Column:
            who = F.array_distinct(F.transform(fs, lambda f: f["detector"]))
            top = F.array_max(F.transform(fs, lambda f: f["score"]))
            level = F.least(F.lit(5), likelihood(top, config.cuts) + (F.size(who) >= 2).cast("int"))
            all_redacted = F.forall(fs, lambda f: f["action"] == "redact")
            return F.struct(level.alias("lik"), all_redacted.alias("mit"), who.alias("who"))

        def build(x: Column) -> Column:
            imp = impact(t, config, application, tier)
            rest = F.when(x["mit"], F.lit(1)).otherwise(x["lik"])
            return F.struct(
                (-rest * imp).alias("k1"), (-x["lik"] * imp).alias("k2"), pos.alias("k3"),
                F.struct(
                    t.alias("threat"), x["lik"].alias("likelihood"), imp.alias("impact"), (x["lik"] * imp).alias("score"),
                    band_of(x["lik"] * imp).alias("band"), rest.alias("residual_likelihood"),
                    (rest * imp).alias("residual_score"), band_of(rest * imp).alias("residual_band"),
                    x["mit"].alias("mitigated"), x["who"].alias("detectors"),
                ).cast(CELL_DDL).alias("cell"),
            )

        return F.transform(F.transform(F.array(group), of), build)[0]

    return F.transform(F.sort_array(F.transform(names, cell)), lambda c: c["cell"])


def assessment(cells: Column, config: RiskConfig | None = None) -> Column:
    """Row-level risk: the worst residual cell, plus the worst inherent score."""
    config = config or RiskConfig()
    worst = F.try_element_at(cells, F.lit(1))
    inherent = F.coalesce(F.array_max(F.transform(cells, lambda c: c["score"])), F.lit(0))
    band = F.coalesce(worst["residual_band"], F.lit("none"))
    acted = F.when(F.size(cells) == 0, F.lit("allow")).otherwise(lookup(band, config.actions, "allow"))
    return F.struct(
        F.coalesce(worst["residual_likelihood"], F.lit(0)).alias("likelihood"),
        F.coalesce(worst["impact"], F.lit(0)).alias("impact"),
        F.coalesce(worst["residual_score"], F.lit(0)).alias("score"),
        band.alias("band"), inherent.alias("inherent_score"), band_of(inherent).alias("inherent_band"),
        worst["threat"].alias("primary"), acted.alias("action"), cells.alias("threats"),
    ).cast(RISK_DDL)


def explain_risk(risk: Column) -> Column:
    title = lookup(risk["primary"], {k: t.title for k, t in BY_ID.items()}, "")
    text = F.format_string(
        "risk %d/25 (%s): likelihood %d x impact %d on %s %s",
        risk["score"], risk["band"], risk["likelihood"], risk["impact"], risk["primary"], title,
    )
    return F.when(risk["primary"].isNull(), "no threats identified").otherwise(F.rtrim(text))


def risk_trace(
    risk: Column, policy_id: str, policy_version: str, config: RiskConfig | None = None, dry_run: bool = False
) -> Column:
    """The band's action as a policy trace; null where it changes nothing."""
    config = config or RiskConfig()
    note = explain_risk(risk)
    if dry_run:
        note = F.concat(F.lit("[dry-run: would "), risk["action"], F.lit("] "), note)
    trace = F.struct(
        F.lit(policy_id).alias("policy_id"), F.lit(policy_version).alias("policy_version"),
        F.concat(F.lit("risk-matrix/"), risk["band"]).alias("rule_id"), F.lit(True).alias("matched"),
        (F.lit("allow") if dry_run else risk["action"]).alias("action"),
        F.lit(None).cast("double").alias("elapsed_ms"), note.alias("note"),
    ).cast(TRACE_DDL)
    return F.when(F.lit(config.enforce) & (risk["action"] != "allow"), trace)


def assess_risk(
    df: DataFrame, config: RiskConfig | None = None, findings: str = "findings",
    application: Column | None = None, tier: Column | None = None,
) -> DataFrame:
    """Add ``risk`` computed from the annotated ``findings`` column."""
    out = (
        df.withColumn("_cells", threat_cells(F.col(findings), config, application, tier))
        .withColumn("risk", assessment(F.col("_cells"), config))
        .drop("_cells")
    )
    return settle(out, "risk")


def risk_matrix(events: DataFrame, likelihood_col: str = "risk_likelihood", impact_col: str = "risk_impact") -> DataFrame:
    """The 5x5 heat map: one row per likelihood, columns ``impact_1`` to ``impact_5``."""
    valid = events.filter(F.col(likelihood_col).between(1, 5) & F.col(impact_col).between(1, 5))
    spread = valid.groupBy(F.col(likelihood_col).alias("likelihood")).agg(
        *[F.count_if(F.col(impact_col) == i).alias(f"impact_{i}") for i in range(1, 6)]
    )
    rows = events.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("likelihood"))
    filled = [F.coalesce(F.col(f"impact_{i}"), F.lit(0).cast("bigint")).alias(f"impact_{i}") for i in range(1, 6)]
    return rows.join(spread, "likelihood", "left").select("likelihood", *filled)
