"""Alert rules over events and anomalies."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions.ranks import SEVERITIES, severity_rank
from wardspark.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class AlertRule:
    id: str
    name: str
    kind: str
    spec: Mapping[str, Any] = field(default_factory=dict)
    severity: str = "medium"
    cooldown_s: int = 300
    enabled: bool = True


# The rules a fresh deployment starts with.
DEFAULT_RULES = (
    AlertRule("rule_credential_leak", "Credential material blocked", "match",
              {"detector": ["secrets", "secret_leakage"], "action": ["block"]}, "critical", 300),
    AlertRule("rule_indirect_injection", "Indirect prompt injection blocked", "match",
              {"category": ["prompt_injection"], "stage": ["retrieval", "tool_result", "memory_write"]}, "high", 600),
    AlertRule("rule_unsafe_tool_flow", "Unauthorised tool execution blocked", "match",
              {"category": ["unsafe_flow", "excessive_agency", "memory_provenance_laundering"], "action": ["block"]}, "critical", 300),
    AlertRule("rule_injection_burst", "Repeated injection attempts from one principal", "threshold",
              {"window_s": 300, "count": 10, "group_by": "principal_id",
               "filter": {"action": ["block", "challenge"], "category": ["prompt_injection", "multi_turn_attack"]}}, "high", 900),
    AlertRule("rule_anomalies", "Cross-application anomaly", "anomaly", {"min_severity": "high"}, "high", 900),
)
_SKIPPED = ("window_s", "count", "group_by", "filter", "kinds", "min_severity")


def matches(spec: Mapping[str, Any]) -> Column:
    """A rule's filter over event columns: every key must hold, a list means any of."""
    tests: list[Column] = []
    for key, expected in spec.items():
        if key in _SKIPPED:
            continue
        wanted = list(expected) if isinstance(expected, (list, tuple, set)) else [expected]
        if key in ("category", "detector"):
            column = "categories" if key == "category" else "detectors_fired"
            tests.append(F.arrays_overlap(column, F.lit(wanted)))
        else:
            tests.append(F.col(key).isin(*wanted))
    if spec.get("min_severity") in SEVERITIES:
        tests.append(severity_rank(F.col("severity")) >= SEVERITIES.index(spec["min_severity"]))
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def _of_kind(rules: Sequence[AlertRule], kind: str) -> list[AlertRule]:
    return [r for r in rules if r.enabled and r.kind == kind]


def rule_hits(events: DataFrame, rules: Sequence[AlertRule]) -> DataFrame:
    """(rule columns, event columns): each event once per ``match`` rule it satisfies, one pass."""
    chosen = _of_kind(rules, "match")
    tags = F.array(*[
        F.when(matches(r.spec), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("title"), F.lit(r.severity).alias("rule_severity"),
                                         F.lit(r.cooldown_s).alias("cooldown_s")))
        for r in chosen
    ]) if chosen else F.array().cast("array<struct<rule_id:string,title:string,rule_severity:string,cooldown_s:int>>")
    tagged = events.withColumn("_rules", F.filter(tags, lambda r: r.isNotNull()))
    return tagged.select(F.inline("_rules"), *events.columns)


def match_alerts(events: DataFrame, rules: Sequence[AlertRule] = DEFAULT_RULES) -> DataFrame:
    """The first matching event of each rule in this batch: a combined minimum per rule."""
    at = F.struct("timestamp_ms", "event_id")
    cols = ("event_id", "correlation_id", "timestamp_ms", "action", "stage", "application", "principal_id")
    first = rule_hits(events, rules).groupBy("rule_id", "title", "rule_severity", "cooldown_s").agg(
        F.min_by(F.struct(*cols), at).alias("e")
    )
    return first.select(
        "rule_id", "title", F.col("rule_severity").alias("severity"), "cooldown_s",
        F.concat("e.action", F.lit(" at "), "e.stage", F.lit(" in "), "e.application").alias("description"),
        "e.event_id", "e.correlation_id", "e.timestamp_ms",
    )


def threshold_alerts(events: DataFrame, rules: Sequence[AlertRule], now_ms: int | Column) -> DataFrame:
    """Rules whose count over the last window reaches its threshold; the largest group, then key, speaks for a rule.

    All rules are counted on one pass: an event unfolds into the rules that take it, and a rule's
    groups meet only once they are counted.
    """
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    chosen = _of_kind(rules, "threshold")
    if not chosen:
        raise ValueError("no threshold rule given")
    taken = []
    for r in chosen:
        window_s, by = int(r.spec.get("window_s", 300)), r.spec.get("group_by")
        key = (F.col(by) if by else F.lit(None)).cast("string")
        test = (F.col("timestamp_ms") >= now - window_s * 1000) & matches(r.spec.get("filter") or {})
        taken.append(F.when(test, F.struct(
            F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("_name"), F.lit(r.severity).alias("severity"), F.lit(bool(by)).alias("_keyed"),
            F.lit(window_s).alias("window_s"), F.lit(r.cooldown_s).alias("cooldown_s"),
            F.lit(int(r.spec.get("count", 10))).alias("_need"), key.alias("group_key"))))
    rule = ("rule_id", "_name", "severity", "_keyed", "window_s", "cooldown_s", "_need")
    groups = events.select(F.inline(F.filter(F.array(*taken), lambda t: t.isNotNull()))).groupBy(*rule, "group_key").agg(F.count("*").alias("count"))
    order = F.struct((-F.col("count")).alias("n"), F.col("group_key").isNull().alias("keyless"), F.col("group_key").alias("group_key"))
    best = groups.filter(F.col("count") >= F.col("_need")).groupBy(*rule).agg(F.min(order).alias("_best"))
    key = F.col("_best.group_key")
    return best.select(
        "rule_id", F.when(F.col("_keyed"), F.concat("_name", F.lit(": "), key)).otherwise(F.col("_name")).alias("title"), "severity",
        key.alias("group_key"), (-F.col("_best.n")).alias("count"), "window_s", "cooldown_s",
    )


def anomaly_alerts(anomalies: DataFrame, rules: Sequence[AlertRule] = DEFAULT_RULES) -> DataFrame:
    """Each anomaly under the first rule that takes its kind and severity."""
    ladder: Column | None = None
    for r in _of_kind(rules, "anomaly"):
        at_least = severity_rank(F.col("severity")) >= SEVERITIES.index(r.spec.get("min_severity", "medium"))
        kinds = r.spec.get("kinds")
        test = at_least & F.col("kind").isin(*kinds) if kinds else at_least
        hit = F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.cooldown_s).alias("cooldown_s"))
        ladder = F.when(test, hit) if ladder is None else ladder.when(test, hit)
    if ladder is None:
        raise ValueError("no anomaly rule given")
    return anomalies.withColumn("_r", ladder).filter(F.col("_r").isNotNull()).select(
        F.col("_r.rule_id").alias("rule_id"), "kind", "title", "severity", "score", "dedupe_key", F.col("_r.cooldown_s").alias("cooldown_s")
    )


def next_fire(last_ms: int | None, at_ms: int, cooldown_s: int) -> bool:
    """Whether a rule may fire: never before, or its cooldown since the last firing is over."""
    return last_ms is None or at_ms - last_ms >= cooldown_s * 1000


def firing_chain(at: np.ndarray, cooldown_s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of alerts in order: how late the last firing may be for each (or one before it) to fire, and which fires next after each.

    An alert fires if the last firing is not after ``at - cooldown``. The running maximum of that is sorted, and
    its first place not below a last firing is the alert that fires.
    """
    latest = at - cooldown_s.astype(np.int64) * 1000
    reach = np.maximum.accumulate(latest)
    n = len(at)
    after = np.maximum(np.searchsorted(reach, at), np.arange(n) + 1)
    for i in np.flatnonzero(cooldown_s < 1).tolist():  # without a cooldown the next alert may be of the same instant
        while after[i] < n and latest[after[i]] < at[i]:
            after[i] += 1
    return reach, after


def suppress_cooldown(alerts: DataFrame, key: str = "rule_id", ts: str = "timestamp_ms", tie: str = "event_id") -> DataFrame:
    """Alerts that really fire: at most one per rule and cooldown since the last *fired* one.

    Each firing depends on the one before. Alerts are ranged by (rule, time), so that a hot rule covers many
    slices. A slice is a function from the last firing before it to the last firing within it, which takes
    as many values as alerts can be first to fire there; these functions are applied one after the other, a row
    a slice, and then each slice fires from its own start. Of rows at one instant only the first can
    fire, so the rest are dropped beforehand by a combined minimum.
    """
    ensure_checkpoint_dir(alerts.sparkSession)
    alone = F.when(F.col("cooldown_s") < 1, F.col(tie)).alias("_alone")
    first = alerts.groupBy(key, ts, alone).agg(F.min_by(F.struct(*alerts.columns), F.col(tie)).alias("_row")).select("_row.*")
    # Written once: a range computed anew may be cut elsewhere.
    sliced = first.repartitionByRange(key, ts, tie).sortWithinPartitions(key, ts, tie).withColumn("_slice", F.spark_partition_id()).checkpoint()
    kind, columns = dict(alerts.dtypes)[key], alerts.columns

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Any, int, pd.DataFrame]]:
        """The alerts of each rule of a slice; a slice is one range, so it fits a task."""
        held: list[pd.DataFrame] = []
        for pdf in batches:
            for _, part in pdf.groupby(key, sort=False, dropna=False):
                if held and held[-1][key].iloc[-1] != part[key].iloc[0]:
                    whole = pd.concat(held, ignore_index=True)
                    yield whole[key].iloc[0], int(whole["_slice"].iloc[0]), whole
                    held = []
                held.append(part)
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield whole[key].iloc[0], int(whole["_slice"].iloc[0]), whole

    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rule, number, pdf in runs(batches):
            at, cool = pdf[ts].to_numpy(np.int64), pdf["cooldown_s"].to_numpy(np.int64)
            reach, after = firing_chain(at, cool)
            exits = at.copy()
            for i in range(len(at) - 1, -1, -1):
                if after[i] < len(at):
                    exits[i] = exits[after[i]]
            # No firing before the slice is later than its first alert: alerts beyond the first that always fires are never first.
            most = min(len(at), int(np.searchsorted(reach, at[0])) + 1)
            steps = np.flatnonzero(np.concatenate([np.diff(exits[:most]) != 0, [True]]))
            yield pd.DataFrame({key: [rule], "_slice": [number], "_reach": [reach[steps].tolist()], "_exit": [exits[steps].tolist()]})

    def enter(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The last firing before each slice of a rule."""
        last, before = None, []
        pdf = pdf.sort_values("_slice")
        for reach, exits in zip(pdf["_reach"], pdf["_exit"], strict=True):
            before.append(last)
            place = 0 if last is None else int(np.searchsorted(reach, last))
            last = int(exits[place]) if place < len(exits) else last
        return pd.DataFrame({key: pdf[key], "_slice": pdf["_slice"], "_last": pd.array(before, "Int64")})

    def fire(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, pdf in runs(batches):
            reach, after = firing_chain(pdf[ts].to_numpy(np.int64), pdf["cooldown_s"].to_numpy(np.int64))
            last, fired = pdf["_last"].iloc[0], []
            i = 0 if pd.isna(last) else int(np.searchsorted(reach, int(last)))
            while i < len(pdf):
                fired.append(i)
                i = int(after[i])
            yield pdf.iloc[fired][columns]

    shapes = sliced.select(key, ts, "cooldown_s", "_slice").mapInPandas(shape, f"{key} {kind}, _slice int, _reach array<bigint>, _exit array<bigint>")
    entries = shapes.groupBy(key).applyInPandas(enter, f"{key} {kind}, _slice int, _last bigint")
    begun = sliced.join(entries, [key, "_slice"]).repartition(key, "_slice").sortWithinPartitions(key, "_slice", ts, tie)

    def by_slice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task may hold several slices of a rule; each starts from its own last firing."""
        held: list[pd.DataFrame] = []
        for pdf in batches:
            for _, part in pdf.groupby([key, "_slice"], sort=False, dropna=False):
                if held and (held[-1][key].iloc[-1], held[-1]["_slice"].iloc[-1]) != (part[key].iloc[0], part["_slice"].iloc[0]):
                    yield from fire(iter([pd.concat(held, ignore_index=True)]))
                    held = []
                held.append(part)
        if held:
            yield from fire(iter([pd.concat(held, ignore_index=True)]))

    return begun.mapInPandas(by_slice, alerts.schema)


def alert_list(alerts: DataFrame, acks: DataFrame | None = None, unacknowledged_only: bool = False, limit: int | None = None) -> DataFrame:
    """Newest alerts with their first acknowledgement (alert_id, acknowledged_ms, acknowledged_by)."""
    if acks is None:
        out = alerts.withColumns({"acknowledged_ms": F.lit(None).cast("bigint"), "acknowledged_by": F.lit(None).cast("string")})
    else:
        first = acks.groupBy("alert_id").agg(F.min(F.struct("acknowledged_ms", "acknowledged_by")).alias("_a"))
        out = alerts.join(first, "alert_id", "left").select(*alerts.columns, "_a.acknowledged_ms", "_a.acknowledged_by")
    if unacknowledged_only:
        out = out.filter(F.col("acknowledged_ms").isNull())
    return out if limit is None else out.orderBy(F.desc("created_ms"), "alert_id").limit(limit)
