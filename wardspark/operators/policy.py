"""Rule policies compiled on the driver into column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions import sqltext
from wardspark.functions.ranks import ACTIONS, BANDS, SEVERITIES, worst
from wardspark.operators.risk import RiskConfig
from wardspark.schema import TRACE_DDL

Facts = Mapping[str, Column]
FactNames = Mapping[str, str]
_STR = "array<string>"


class PolicyError(ValueError):
    """A policy document that cannot be accepted."""


def _list(value: Any) -> list[Any]:
    if value is None:
        return []
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def policy_facts(
    findings: Column,
    *,
    stage: Column,
    risk: Column | None = None,
    payload: Column | None = None,
    fired_only_score: bool = True,
    **context: Column,
) -> dict[str, Column]:
    """What conditions read, flattened from findings and row context.

    Context keys: environment, application, model, provider, tenant, principal_id, roles,
    authenticated, trust, tool, tags. Those left out are null and never match.
    """
    fired = F.filter(findings, lambda f: f["detected"])
    scored = fired if fired_only_score else findings
    facts = {
        "stage": stage,
        "detectors_fired": F.transform(fired, lambda f: f["detector"]),
        "categories": F.array_sort(F.array_distinct(F.transform(fired, lambda f: f["category"]))),
        "labels": F.array_sort(
            F.array_distinct(F.flatten(F.transform(fired, lambda f: F.transform(f["spans"], lambda s: s["label"]))))
        ),
        "severity": worst(F.transform(fired, lambda f: f["severity"]), SEVERITIES, "info"),
        "max_score": F.coalesce(F.array_max(F.transform(scored, lambda f: f["score"])), F.lit(0.0)),
        "threats": F.array_sort(F.array_distinct(F.flatten(F.transform(fired, lambda f: f["threats"])))),
        "risk_score": F.lit(0) if risk is None else risk["score"],
        "risk_band": F.lit("none") if risk is None else risk["band"],
        "payload": F.lit(None).cast("string") if payload is None else payload,
    }
    for name in ("environment", "application", "model", "provider", "tenant", "principal_id", "tool"):
        facts[name] = context.get(name, F.lit(None).cast("string"))
    facts["trust"] = context.get("trust", F.lit("user"))
    facts["roles"] = context.get("roles", F.array().cast(_STR))
    facts["authenticated"] = F.coalesce(context.get("authenticated", F.lit(False)), F.lit(False))
    facts["tags"] = context.get("tags", F.lit(None).cast("map<string,string>"))
    return facts


def _text(v: Any) -> str:
    return {True: "true", False: "false"}.get(v, str(v)) if isinstance(v, bool) else str(v)


_SINGLE = {
    "stage": "stage", "environment": "environment", "application": "application", "model": "model",
    "provider": "provider", "tenant": "tenant", "principal": "principal_id", "trust": "trust", "tool": "tool",
}
_ANY = {"role": "roles", "detector_fired": "detectors_fired", "category": "categories", "label": "labels", "threat": "threats"}
_NONE_OF = {"not_role": "roles", "detector_not_fired": "detectors_fired"}
LEAVES = (
    *_SINGLE, *_ANY, *_NONE_OF, "authenticated", "severity_at_least", "score_at_least", "risk_at_least",
    "risk_score_at_least", "tag", "content_matches", "always",
)


def _leaf(key: str, value: Any, facts: FactNames) -> str:
    if key in _SINGLE:
        return sqltext.glob(facts[_SINGLE[key]], _list(value))
    if key in _ANY:
        return sqltext.glob_any(facts[_ANY[key]], _list(value))
    if key in _NONE_OF:
        return f"NOT {sqltext.glob_any(facts[_NONE_OF[key]], _list(value))}"
    if key == "authenticated":
        return f"{facts['authenticated']} = {sqltext.literal(bool(value))}"
    if key == "severity_at_least":
        if value not in SEVERITIES:
            raise PolicyError(f"unknown severity {value!r}")
        return f"array_position({sqltext.array(SEVERITIES)}, {facts['severity']}) > {SEVERITIES.index(value)}"
    if key == "score_at_least":
        return f"coalesce({facts['max_score']}, 0.0D) >= {float(value)!r}D"
    if key == "risk_at_least":
        if value not in BANDS:
            raise PolicyError(f"unknown risk band {value!r}")
        return f"array_position({sqltext.array(BANDS)}, coalesce({facts['risk_band']}, 'none')) > {BANDS.index(value)}"
    if key == "risk_score_at_least":
        return f"coalesce({facts['risk_score']}, 0) >= {int(value)}"
    if key == "tag":
        if not isinstance(value, Mapping):
            raise PolicyError("'tag' takes a mapping of tag to expected values")
        tests = [sqltext.glob(f"{facts['tags']}[{sqltext.text(str(k))}]", [_text(x) for x in _list(v)]) for k, v in value.items()]
        return " AND ".join(tests) or "true"
    if key == "content_matches":
        return " OR ".join(sqltext.rlike(f"coalesce({facts['payload']}, '')", p, True) for p in _list(value)) or "false"
    return sqltext.literal(bool(value))


def condition_sql(spec: Any, facts: FactNames) -> str:
    """A ``when`` tree as one boolean SQL expression that is never null."""
    if spec is None:
        return "true"
    if isinstance(spec, bool):
        return sqltext.literal(spec)
    if isinstance(spec, (list, tuple)):
        return " AND ".join(f"({condition_sql(s, facts)})" for s in spec) or "true"
    if not isinstance(spec, Mapping):
        raise PolicyError(f"a condition is a mapping or a list, not {type(spec).__name__}")
    parts = []
    for key, value in spec.items():
        if key == "all":
            parts.append(condition_sql(_list(value), facts))
        elif key == "any":
            parts.append(" OR ".join(f"({condition_sql(s, facts)})" for s in _list(value)) or "false")
        elif key in ("not", "none"):
            parts.append(f"NOT ({condition_sql(value, facts)})")
        elif key in LEAVES:
            parts.append(f"coalesce({_leaf(key, value, facts)}, false)")
        else:
            raise PolicyError(f"unknown condition {key!r}")
    return " AND ".join(f"({p})" for p in parts) or "true"


PREFIX = "_fact_"


def with_facts(df: DataFrame, facts: Facts) -> tuple[DataFrame, FactNames]:
    """Facts as columns of ``df``, computed once however many rules read them, and their names."""
    return df.withColumns({PREFIX + k: v for k, v in facts.items()}), {k: PREFIX + k for k in facts}


def matching(df: DataFrame, spec: Any, facts: Facts, out: str = "matched") -> DataFrame:
    """Add whether one condition holds."""
    df, names = with_facts(df, facts)
    return df.withColumn(out, F.expr(condition_sql(spec, names))).drop(*names.values())


@dataclass(frozen=True)
class Rule:
    id: str
    action: str
    when: Any = None
    stop: bool = True
    message: str = ""
    severity: str | None = None


@dataclass(frozen=True)
class Policy:
    id: str = "default"
    version: str = "0"
    rules: tuple[Rule, ...] = ()
    default_action: str = "allow"
    detectors: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    rate_limits: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    model_access: Mapping[str, Sequence[str]] = field(default_factory=dict)
    tool_access: Mapping[str, Sequence[str]] = field(default_factory=dict)
    risk: RiskConfig = field(default_factory=RiskConfig)

    @property
    def ref(self) -> str:
        return f"{self.id}@{self.version}"

    @classmethod
    def from_dict(cls, doc: Mapping[str, Any]) -> Policy:
        """Read a policy document; unknown keys, actions and duplicate rules are refused."""
        known = {"id", "version", "description", "rules", "detectors", "defaults", "rate_limits", "model_access",
                 "tool_access", "metadata", "risk"}
        if set(doc) - known:
            raise PolicyError(f"unknown policy keys: {sorted(set(doc) - known)}")
        rules = []
        for r in doc.get("rules") or ():
            if "id" not in r or r.get("action") not in ACTIONS:
                raise PolicyError(f"rule {r.get('id')!r}: needs an id and a known action")
            if any(x.id == r["id"] for x in rules):
                raise PolicyError(f"duplicate rule id {r['id']!r}")
            rules.append(Rule(r["id"], r["action"], r.get("when"), bool(r.get("stop", True)), r.get("message", ""),
                              r.get("severity")))
        default = (doc.get("defaults") or {}).get("action", "allow")
        if default not in ACTIONS:
            raise PolicyError(f"unknown default action {default!r}")
        return cls(
            str(doc.get("id", "default")), str(doc.get("version", "0")), tuple(rules), default,
            dict(doc.get("detectors") or {}), dict(doc.get("rate_limits") or {}), dict(doc.get("model_access") or {}),
            dict(doc.get("tool_access") or {}), RiskConfig.from_dict(doc.get("risk")),
        )


def policy_traces(facts: FactNames, policy: Policy, dry_run: bool = False) -> Column:
    """Matched rules in order, up to the first that stops; the default action if none matches."""

    def trace(rule: Rule | None) -> str:
        action = policy.default_action if rule is None else ("allow" if dry_run else rule.action)
        matched = rule is not None or policy.default_action != "allow"
        note = "no rule matched; policy default applied" if rule is None else rule.message
        if rule is not None and dry_run:
            note = f"[dry-run: would {rule.action}] {note}"
        fields = [policy.id, policy.version, rule.id if rule else None, matched, action, None, note]
        return f"cast(struct({', '.join(sqltext.literal(v) for v in fields)}) as {TRACE_DDL})"

    if not policy.rules:
        return F.expr(f"array({trace(None)})")
    matches = sqltext.chosen([
        (condition_sql(r.when, facts), f"named_struct('stop', {sqltext.literal(r.stop and not dry_run)}, 'trace', {trace(r)})")
        for r in policy.rules
    ])

    def cut(ms: Column) -> Column:
        first_stop = F.array_position(F.transform(ms, lambda m: m["stop"]), F.lit(True)).cast("int")
        kept = F.when(first_stop > 0, F.slice(ms, F.lit(1), first_stop)).otherwise(ms)
        return F.when(F.size(ms) == 0, F.expr(f"array({trace(None)})")).otherwise(F.transform(kept, lambda m: m["trace"]))

    # Bound once by the outer lambda, so the rule conditions are evaluated a single time.
    return F.transform(F.array(matches), cut)[0]


def combined_action(findings: Column, traces: Column) -> Column:
    """The most severe action over fired findings and matched traces."""
    proposed = F.concat(
        F.transform(F.filter(findings, lambda f: f["detected"]), lambda f: f["action"]),
        F.transform(F.filter(traces, lambda t: t["matched"]), lambda t: t["action"]),
    )
    return worst(proposed, ACTIONS, "allow")


def apply_policy(df: DataFrame, policy: Policy, facts: Facts, dry_run: bool = False, out: str = "policy_traces") -> DataFrame:
    df, names = with_facts(df, facts)
    return df.withColumn(out, policy_traces(names, policy, dry_run)).drop(*names.values())
