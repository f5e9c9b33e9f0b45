"""Threat naming, risk, policies, decisions and replay over the audit view."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.functions.ranks import ACTIONS
from wardspark.operators import audit as A
from wardspark.operators import decision as D
from wardspark.operators import risk as R
from wardspark.operators import taxonomy as T
from wardspark.operators.bundles import BUNDLES, bundled
from wardspark.operators.policy import Policy, apply_policy, policy_facts
from wardspark.queries.base import audit, audit_sql, query, quoted
from wardspark.plans.firewall import decide

_CAT = "cat AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{t.id}', {quoted(t.framework)}, {quoted(t.title)}, {t.base_impact}, '{','.join(t.atlas)}', '{','.join(t.detectors)}', {len(t.controls)}, '{t.coverage}')"
    for i, t in enumerate(T.CATALOG)
) + ") AS t(position, id, framework, title, base_impact, atlas, detectors, n_controls, coverage))"
_BAND = ("CASE WHEN {x} <= 0 THEN 'none' WHEN {x} <= 4 THEN 'low' WHEN {x} <= 9 THEN 'medium' WHEN {x} <= 16 THEN 'high' ELSE 'critical' END")
_LIK = "(1 + (s >= 0.35)::INT + (s >= 0.5)::INT + (s >= 0.65)::INT + (s >= 0.85)::INT)"

# Cells of every event, as the reference for the risk queries.
_CELLS = (
    _CAT + ", g AS (SELECT event_id, threat, max(score) AS s, count(DISTINCT detector) AS nd, bool_and(action = 'redact') AS mitigated, min(pos * 100 + n) AS ord FROM ft GROUP BY ALL), "
    f"l AS (SELECT *, least(5, {_LIK} + CASE WHEN nd >= 2 THEN 1 ELSE 0 END) AS lik FROM g), "
    "cells AS (SELECT l.*, cat.base_impact AS impact, lik * cat.base_impact AS inherent, CASE WHEN mitigated THEN 1 ELSE lik END AS rlik, "
    "(CASE WHEN mitigated THEN 1 ELSE lik END) * cat.base_impact AS residual FROM l JOIN cat ON cat.id = l.threat), "
    "best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY residual DESC, inherent DESC, ord) AS rn FROM cells), "
    "risk AS (SELECT a.event_id, a.application, a.stage, coalesce(b.rlik, 0) AS likelihood, coalesce(b.impact, 0) AS impact, coalesce(b.residual, 0) AS score, b.threat AS prim, "
    "coalesce(m.inh, 0) AS inherent_score FROM a LEFT JOIN (SELECT * FROM best WHERE rn = 1) b USING (event_id) LEFT JOIN (SELECT event_id, max(inherent) AS inh FROM cells GROUP BY 1) m USING (event_id))"
)


def _risky(spark, sf):
    return R.assess_risk(audit(spark, sf).drop("risk"), application=F.col("application"))


@query("threat_catalog", f"WITH {_CAT} SELECT cat.id, framework, title, base_impact, atlas, detectors, coverage, count(ft.threat) AS findings FROM cat LEFT JOIN (SELECT * FROM ({audit_sql('SELECT threat FROM ft')})) ft ON ft.threat = cat.id GROUP BY ALL")
def _catalog(spark, sf):
    """The catalogue with how many recorded findings name each threat."""
    named = audit(spark, sf).select(F.explode("findings").alias("f")).select(F.explode("f.threats").alias("id")).groupBy("id").agg(F.count("*").alias("findings"))
    cat = T.threat_catalog(spark).select("id", "framework", "title", "base_impact", F.array_join("atlas", ",").alias("atlas"),
                                         F.array_join("detectors", ",").alias("detectors"), "coverage")
    return cat.join(named, "id", "left").withColumn("findings", F.coalesce("findings", F.lit(0).cast("bigint")))


@query("annotate_threats", audit_sql(
    "SELECT detector, stage, threats, count(*) AS findings FROM (SELECT event_id, pos, detector, stage, string_agg(threat, ',' ORDER BY n) AS threats FROM ft GROUP BY ALL) GROUP BY ALL"))
def _annotate(spark, sf):
    f = audit(spark, sf).select("stage", F.explode("findings").alias("f")).filter("f.detected").select("stage", "f.detector", F.array_join("f.threats", ",").alias("threats"))
    return f.groupBy("detector", "stage", "threats").agg(F.count("*").alias("findings"))


_TSTR = f"SELECT event_id, string_agg(threat, ',' ORDER BY position) AS threats FROM th JOIN cat ON cat.id = th.threat GROUP BY 1"


@query("threat_ids", audit_sql(f"SELECT threats, count(*) AS events FROM ({_TSTR}) GROUP BY 1", _CAT))
def _ids(spark, sf):
    """Threats of each event in catalogue order."""
    e = audit(spark, sf).select(F.array_join(T.threat_ids(F.col("findings")), ",").alias("threats")).filter("threats <> ''")
    return e.groupBy("threats").agg(F.count("*").alias("events"))


@query("atlas_for", audit_sql(
    "SELECT technique, count(DISTINCT event_id) AS events FROM (SELECT event_id, unnest(string_split(atlas, ',')) AS technique FROM th JOIN cat ON cat.id = th.threat WHERE atlas <> '') GROUP BY 1", _CAT))
def _atlas(spark, sf):
    e = audit(spark, sf).select("event_id", F.explode(T.atlas_for(F.col("threats"))).alias("technique"))
    return e.groupBy("technique").agg(F.count_distinct("event_id").alias("events"))


_ON = ("prompt_injection", "pii", "token_flow")


@query("coverage_report", audit_sql(
    "SELECT id, array_to_string(act, ',') AS active, array_to_string(mis, ',') AS missing, CASE WHEN detectors <> '' AND len(act) = 0 THEN CASE WHEN n_controls > 0 THEN 'observed' ELSE 'disabled' END "
    "WHEN len(mis) > 0 AND coverage = 'covered' THEN 'partial' ELSE coverage END AS status, coalesce(h.n, 0) AS hits "
    f"FROM (SELECT *, list_filter(string_split(detectors, ','), lambda d: d IN {_ON}) AS act, list_filter(string_split(detectors, ','), lambda d: d <> '' AND d NOT IN {_ON}) AS mis FROM cat) c "
    "LEFT JOIN (SELECT threat, count(*) AS n FROM th JOIN a USING (event_id) WHERE risk_score > 0 GROUP BY 1) h ON h.threat = c.id", _CAT))
def _coverage(spark, sf):
    r = A.threat_hits(audit(spark, sf), enabled=_ON)
    return r.select("id", F.array_join("active_detectors", ",").alias("active"), F.array_join("missing_detectors", ",").alias("missing"), "status", "hits")


@query("likelihood", audit_sql(f"SELECT {_LIK} AS likelihood, count(*) AS findings, min(s) AS low, max(s) AS high FROM (SELECT CAST(score AS DOUBLE) AS s FROM f) GROUP BY 1"))
def _likelihood(spark, sf):
    f = audit(spark, sf).select(F.explode("findings.score").alias("s"))
    return f.groupBy(R.likelihood(F.col("s")).alias("likelihood")).agg(F.count("*").alias("findings"), F.min("s").alias("low"), F.max("s").alias("high"))


_CFG = R.RiskConfig(impact={"LLM05": 2}, application_impact={"app1": 5})


@query("impact", audit_sql(
    "SELECT application, tool, threat, greatest(CASE WHEN threat = 'LLM05' THEN 2 ELSE base_impact END, CASE WHEN application = 'app1' THEN 5 ELSE 1 END, "
    "CASE tool WHEN 'payment.charge' THEN 5 WHEN 'shell.exec' THEN 5 WHEN 'email.send' THEN 4 WHEN 'crm.lookup' THEN 2 ELSE 1 END) AS impact, count(*) AS n "
    "FROM th JOIN a USING (event_id) JOIN cat ON cat.id = th.threat GROUP BY ALL", _CAT))
def _impact(spark, sf):
    from wardspark.operators.detectors import sink_tier

    e = audit(spark, sf).select("application", F.col("tags")["tool"].alias("tool"), F.explode("threats").alias("threat"))
    tier = F.when(F.col("tool").isNotNull(), sink_tier(F.col("tool")))
    imp = R.impact(F.col("threat"), _CFG, F.col("application"), tier)
    return e.select("application", "tool", "threat", imp.alias("impact")).groupBy("application", "tool", "threat", "impact").agg(F.count("*").alias("n"))


@query("threat_cells", audit_sql("SELECT threat, lik AS likelihood, impact, inherent AS score, residual AS residual_score, mitigated, nd AS detectors, count(*) AS n FROM cells GROUP BY ALL", _CELLS))
def _cells(spark, sf):
    """Matrix cells of every event's threats, by array functions, counted."""
    e = _risky(spark, sf).select(F.explode("risk.threats").alias("c")).select("c.*")
    return e.groupBy("threat", "likelihood", "impact", "score", "residual_score", "mitigated", F.size("detectors").cast("bigint").alias("detectors")).agg(F.count("*").alias("n"))


@query("assess_risk", audit_sql(f"SELECT application, prim AS primary_threat, likelihood, impact, score, {_BAND.format(x='score')} AS band, inherent_score, count(*) AS n FROM risk GROUP BY ALL", _CELLS))
def _assess(spark, sf):
    e = _risky(spark, sf).select("application", "risk.*")
    return e.groupBy("application", F.col("primary").alias("primary_threat"), "likelihood", "impact", "score", "band", "inherent_score").agg(F.count("*").alias("n"))


@query("risk_trace", audit_sql(
    f"SELECT 'risk-matrix/' || {_BAND.format(x='score')} AS rule_id, CASE WHEN score > 9 THEN 'block' ELSE 'flag' END AS action, count(*) AS n FROM risk WHERE score > 4 GROUP BY ALL", _CELLS))
def _trace(spark, sf):
    t = R.risk_trace(F.col("risk"), "default", "1")
    e = _risky(spark, sf).select(t.alias("t")).filter("t is not null").select("t.rule_id", "t.action")
    return e.groupBy("rule_id", "action").agg(F.count("*").alias("n"))


@query("risk_matrix", audit_sql(
    "SELECT l.likelihood, " + ", ".join(f"count(*) FILTER (WHERE a.risk_impact = {i}) AS impact_{i}" for i in range(1, 6)) +
    " FROM (SELECT CAST(unnest(range(1, 6)) AS INT) AS likelihood) l LEFT JOIN a ON a.risk_likelihood = l.likelihood GROUP BY 1"))
def _matrix(spark, sf):
    return R.risk_matrix(audit(spark, sf))


@query("explain_risk", audit_sql(
    f"SELECT CASE WHEN prim IS NULL THEN 'no threats identified' ELSE 'risk ' || score || '/25 (' || {_BAND.format(x='score')} || '): likelihood ' || likelihood || ' x impact ' || impact || ' on ' || prim || ' ' || title END AS explanation, "
    "count(*) AS n FROM (SELECT risk.*, cat.title FROM risk LEFT JOIN cat ON cat.id = risk.prim) GROUP BY 1", _CELLS))
def _explain(spark, sf):
    e = _risky(spark, sf).select(R.explain_risk(F.col("risk")).alias("explanation"))
    return e.groupBy("explanation").agg(F.count("*").alias("n"))


# --- policy ---------------------------------------------------------------------------

# Facts of every event, flat.
_FACTS = (
    "fl AS (SELECT event_id, string_agg(detector, ',' ORDER BY pos) FILTER (WHERE detected) AS dets, string_agg(DISTINCT category, ',' ORDER BY category) FILTER (WHERE detected) AS cats, "
    "string_agg(label, ',') FILTER (WHERE detected AND label IS NOT NULL) AS labs, max(CASE WHEN detected THEN CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END ELSE 0 END) AS sev, "
    "max(CASE WHEN detected THEN score ELSE 0 END) AS top FROM f GROUP BY 1), "
    "facts AS (SELECT a.*, coalesce(dets, '') AS dets, coalesce(cats, '') AS cats, coalesce(labs, '') AS labs, sev, CAST(top AS DOUBLE) AS top, coalesce(t.ths, '') AS ths FROM a JOIN fl USING (event_id) "
    "LEFT JOIN (SELECT event_id, string_agg(threat, ',' ORDER BY threat) AS ths FROM th GROUP BY 1) t USING (event_id))"
)


def _facts(**kw):
    tags = F.col("tags")
    return policy_facts(
        F.col("findings"), stage=F.col("stage"), risk=F.col("risk"), payload=F.col("prompt"), environment=F.col("environment"),
        application=F.col("application"), model=F.col("model"), provider=F.col("provider"), tenant=F.col("tenant"), principal_id=F.col("principal_id"),
        roles=F.col("principal_roles"), authenticated=F.col("principal_id").isNotNull(), trust=tags["trust"], tool=tags["tool"], tags=tags, **kw,
    )


@query("policy_facts", audit_sql("SELECT dets AS detectors, cats AS categories, labs AS labels, CASE sev WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity, "
                                 "ths AS threats, count(*) AS n, max(top) AS max_score FROM facts GROUP BY ALL", _FACTS))
def _fact_query(spark, sf):
    f = _facts()
    e = audit(spark, sf).select(*[F.array_join(f[k], ",").alias(n) for k, n in (("detectors_fired", "detectors"), ("categories", "categories"), ("labels", "labels"), ("threats", "threats"))],
                                f["severity"].alias("severity"), f["max_score"].alias("s"))
    return e.groupBy("detectors", "categories", "labels", "severity", "threats").agg(F.count("*").alias("n"), F.max("s").alias("max_score"))


# Each leaf predicate, with its check.
_LEAF_CASES = {
    "stage": ({"stage": ["input", "tool_*"]}, "stage = 'input' OR stage LIKE 'tool_%'"),
    "environment": ({"environment": "prod*"}, "environment LIKE 'prod%'"),
    "application": ({"application": ["app1", "app[23]"]}, "application IN ('app1', 'app2', 'app3')"),
    "model": ({"model": "model-?"}, "model IS NOT NULL"),
    "provider": ({"provider": "prov1"}, "provider = 'prov1'"),
    "tenant": ({"tenant": ["t0", "t2"]}, "tenant IN ('t0', 't2')"),
    "principal": ({"principal": "u1*"}, "coalesce(principal_id, '') LIKE 'u1%'"),
    "role": ({"role": ["analyst", "a*"]}, "role IN ('analyst', 'agent')"),
    "not_role": ({"not_role": "analyst"}, "role <> 'analyst'"),
    "authenticated": ({"authenticated": False}, "principal_id IS NULL"),
    "trust": ({"trust": ["external", "retrieved"]}, "trust IN ('external', 'retrieved')"),
    "tool": ({"tool": ["payment.*", "*.exec"]}, "coalesce(tool, '') IN ('payment.charge', 'shell.exec')"),
    "detector_fired": ({"detector_fired": "p*i*"}, "contains(dets, 'pii') OR contains(dets, 'prompt_injection')"),
    "detector_not_fired": ({"detector_not_fired": ["pii", "secrets"]}, "NOT (contains(dets, 'pii') OR contains(dets, 'secrets'))"),
    "category": ({"category": "unsafe_*"}, "contains(cats, 'unsafe_flow')"),
    "label": ({"label": ["credit_card"]}, "contains(labs, 'credit_card')"),
    "severity_at_least": ({"severity_at_least": "high"}, "sev >= 3"),
    "score_at_least": ({"score_at_least": 0.8}, "top >= 0.8"),
    "threat": ({"threat": "ASI*"}, "contains(ths, 'ASI')"),
    "risk_at_least": ({"risk_at_least": "high"}, "risk_score > 9"),
    "risk_score_at_least": ({"risk_score_at_least": 6}, "risk_score >= 6"),
    "tag": ({"tag": {"data_region": ["eu", "eea"], "trust": "user"}}, "region = 'eu' AND trust = 'user'"),
    "content_matches": ({"content_matches": ["number 1\\d$", "prompt NUMBER 7$"]}, "regexp_matches(prompt, 'number 1[0-9]$|number 7$')"),
    "always": ({"always": True}, "true"),
}
_COMBINED = {
    "all_any_not": ({"all": [{"stage": "input"}, {"any": [{"severity_at_least": "high"}, {"not": {"environment": "production"}}]}]},
                    "stage = 'input' AND (sev >= 3 OR environment <> 'production')"),
    "none": ({"none": {"stage": "input", "environment": "staging"}}, "NOT (stage = 'input' AND environment = 'staging')"),
    "list_is_all": ([{"stage": "output"}, {"trust": "user"}], "stage = 'output' AND trust = 'user'"),
    "many_keys": ({"application": "app1", "severity_at_least": "low", "not": {"tenant": "t1"}}, "application = 'app1' AND sev >= 1 AND tenant <> 't1'"),
    "null_is_true": (None, "true"),
    "null_tool_never": ({"not": {"tool": "*"}}, "tool IS NULL"),
}




def _case_sql(cases) -> str:
    parts = [f"SELECT '{n}' AS condition, count(*) FILTER (WHERE {sql}) AS events FROM facts" for n, (_, sql) in cases.items()]
    return audit_sql(" UNION ALL ".join(parts), _FACTS)


def _one_pass(spark, sf, cases):
    """All conditions counted in one pass over the events."""
    from wardspark.operators.policy import condition_sql, with_facts

    e, names = with_facts(audit(spark, sf), _facts())
    counts = e.agg(*[F.count_if(F.expr(condition_sql(spec, names))).alias(n) for n, (spec, _) in cases.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("condition"), F.col(n).alias("events")) for n in cases])
    return counts.select(F.inline(pairs))


@query("leaf_predicates", _case_sql(_LEAF_CASES))
def _leaves(spark, sf):
    return _one_pass(spark, sf, _LEAF_CASES)


@query("combinators", _case_sql(_COMBINED))
def _combinators(spark, sf):
    return _one_pass(spark, sf, _COMBINED)


# A small policy used for the trace queries, with its ladder in SQL.
RULES = Policy.from_dict({
    "id": "check", "version": "3",
    "rules": [
        {"id": "note-pii", "action": "redact", "stop": False, "when": {"detector_fired": "pii"}},
        {"id": "flag-agentic", "action": "flag", "stop": False, "when": {"threat": "ASI*"}},
        {"id": "stop-secrets", "action": "block", "when": {"detector_fired": "secrets", "severity_at_least": "high"}, "message": "no credentials"},
        {"id": "ask-tools", "action": "challenge", "when": {"tool": ["payment.*", "shell.*"]}},
        {"id": "stop-critical", "action": "block", "when": {"severity_at_least": "critical"}},
    ],
})
_R = ("rl AS (SELECT *, contains(dets, 'pii') AS r1, contains(ths, 'ASI') AS r2, contains(dets, 'secrets') AND sev >= 3 AS r3, coalesce(tool, '') IN ('payment.charge', 'shell.exec') AS r4, sev >= 4 AS r5 FROM facts), "
      "tr AS (SELECT *, concat_ws(',', CASE WHEN r1 THEN 'note-pii' END, CASE WHEN r2 THEN 'flag-agentic' END, CASE WHEN r3 THEN 'stop-secrets' WHEN r4 THEN 'ask-tools' WHEN r5 THEN 'stop-critical' END) AS rules, "
      "greatest(CASE WHEN r1 THEN 2 ELSE 0 END, CASE WHEN r2 THEN 1 ELSE 0 END, CASE WHEN r3 THEN 4 WHEN r4 THEN 3 WHEN r5 THEN 4 ELSE 0 END) AS pol FROM rl), "
      "dc AS (SELECT tr.*, greatest(pol, CASE action WHEN 'block' THEN 4 WHEN 'challenge' THEN 3 WHEN 'redact' THEN 2 WHEN 'flag' THEN 1 ELSE 0 END, CASE WHEN pii_label IS NOT NULL THEN 2 ELSE 0 END) AS final FROM tr)")
_NAME = "CASE {x} WHEN 4 THEN 'block' WHEN 3 THEN 'challenge' WHEN 2 THEN 'redact' WHEN 1 THEN 'flag' ELSE 'allow' END"


def _traced(spark, sf):
    return apply_policy(audit(spark, sf).drop("policy_traces"), RULES, _facts())


def _decided(spark, sf):
    return D.decision_fields(_traced(spark, sf).drop("action", "severity", "threats"))


@query("apply_policy", audit_sql("SELECT rules, count(*) AS events FROM tr GROUP BY 1", _FACTS, _R))
def _apply(spark, sf):
    rules = F.transform(F.filter("policy_traces", lambda t: t["matched"]), lambda t: t["rule_id"])
    return _traced(spark, sf).groupBy(F.array_join(rules, ",").alias("rules")).agg(F.count("*").alias("events"))


@query("combine_decision", audit_sql(f"SELECT {_NAME.format(x='final')} AS action, count(*) AS events FROM dc GROUP BY 1", _FACTS, _R))
def _combine(spark, sf):
    return _decided(spark, sf).groupBy("action").agg(F.count("*").alias("events"))


@query("decision_fields", audit_sql(
    f"SELECT {_NAME.format(x='final')} AS action, CASE sev WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity, final <= 2 AS allowed, final = 4 AS blocked, "
    "CASE WHEN dets = '' THEN '' WHEN pii_label IS NULL OR action = 'allow' THEN dets WHEN action IN ('block', 'challenge') THEN detector || ',pii' WHEN action = 'redact' AND value >= 250 THEN detector || ',pii' ELSE 'pii,' || detector END AS reasons, "
    "count(*) AS events FROM dc GROUP BY ALL", _FACTS, _R))
def _fields(spark, sf):
    """Decisions with severity and reasons, most severe action first."""
    return _decided(spark, sf).groupBy("action", "severity", "allowed", "blocked", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("events"))


@query("monitor_only", audit_sql(f"SELECT CASE WHEN final >= 3 THEN 'flag' ELSE {_NAME.format(x='final')} END AS action, count(*) AS events, count(*) FILTER (WHERE final >= 3 AND dets <> '') AS marked FROM dc GROUP BY 1", _FACTS, _R))
def _monitor(spark, sf):
    out = D.monitor_only(_decided(spark, sf))
    marked = F.exists("findings", lambda f: F.contains(F.coalesce(f["evidence"], F.lit("")), F.lit("monitor_only")))
    return out.groupBy("action").agg(F.count("*").alias("events"), F.count_if(marked).alias("marked"))


@query("block_message", audit_sql(
    "SELECT correlation_id, CASE WHEN r3 THEN 'no credentials' ELSE 'This request was blocked by the AI firewall. Reference: ' || correlation_id END AS message FROM dc WHERE final = 4", _FACTS, _R))
def _message(spark, sf):
    out = _decided(spark, sf).filter("action = 'block'")
    return out.select("correlation_id", D.block_message(F.col("policy_traces"), F.col("correlation_id")).alias("message"))


@query("resolve_challenges", audit_sql(
    f"SELECT {_NAME.format(x='final')} AS before, CASE WHEN final <> 3 THEN {_NAME.format(x='final')} WHEN ok.approved THEN 'allow' ELSE 'block' END AS action, count(*) AS events "
    "FROM dc LEFT JOIN (SELECT DISTINCT correlation_id, approved FROM (SELECT correlation_id, min(value) < 50 AS approved FROM a GROUP BY 1 HAVING max(k) < 95)) ok USING (correlation_id) GROUP BY ALL", _FACTS, _R))
def _resolve(spark, sf):
    e = audit(spark, sf)
    answers = e.groupBy("correlation_id").agg((F.min("latency_ms") < 5).alias("approved"), F.max(F.substring("prompt", 15, 9).cast("int")).alias("k")).filter("k < 95")
    out = _decided(spark, sf).withColumn("before", F.col("action"))
    return D.resolve_challenges(out, answers.select("correlation_id", "approved")).groupBy("before", "action").agg(F.count("*").alias("events"))


@query("policy_dry_run", audit_sql(
    "SELECT action AS from_action, " + _NAME.format(x="new") + " AS to_action, count(*) AS events FROM (SELECT *, greatest(CASE WHEN contains(dets, 'pii') THEN 2 ELSE 0 END, "
    "CASE WHEN contains(dets, 'secrets') AND rsev >= 3 THEN 4 WHEN coalesce(tool, '') IN ('payment.charge', 'shell.exec') THEN 3 WHEN rsev >= 4 THEN 4 ELSE 0 END) AS new "
    "FROM (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rsev FROM facts)) GROUP BY ALL", _FACTS))
def _dry_run(spark, sf):
    """Replay under a candidate policy; rules on threats never match, as recorded facts lack them."""
    return A.policy_dry_run(audit(spark, sf), RULES)


@query("policy_changes", audit_sql(
    "SELECT event_id, correlation_id, action AS from_action, to_action FROM (SELECT *, " + _NAME.format(x="new") + " AS to_action FROM (SELECT *, greatest(CASE WHEN contains(dets, 'pii') THEN 2 ELSE 0 END, "
    "CASE WHEN contains(dets, 'secrets') AND rsev >= 3 THEN 4 WHEN coalesce(tool, '') IN ('payment.charge', 'shell.exec') THEN 3 WHEN rsev >= 4 THEN 4 ELSE 0 END) AS new "
    "FROM (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rsev FROM facts))) WHERE to_action <> action", _FACTS))
def _changes(spark, sf):
    """Every event that the candidate policy would treat otherwise."""
    return A.policy_changes(audit(spark, sf), RULES).select("event_id", "correlation_id", "from_action", "to_action")


@query("policy_dry_run_full", audit_sql(
    "SELECT action AS from_action, " + _NAME.format(x="pol2") + " AS to_action, count(*) AS events FROM (SELECT *, greatest(CASE WHEN contains(dets, 'pii') THEN 2 ELSE 0 END, CASE WHEN contains(ths, 'ASI') THEN 1 ELSE 0 END, "
    "CASE WHEN contains(dets, 'secrets') AND rsev >= 3 THEN 4 WHEN coalesce(tool, '') IN ('payment.charge', 'shell.exec') THEN 3 WHEN rsev >= 4 THEN 4 ELSE 0 END) AS pol2 "
    "FROM (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rsev FROM facts)) GROUP BY ALL", _FACTS))
def _dry_full(spark, sf):
    return A.policy_dry_run(audit(spark, sf), RULES, full_facts=True)


_CR = {  # template -> ordered (rule, action, stop, SQL over the replay facts); replayed rules on threats never match
    "default": [("block-credential-egress", "block", True, "sec"), ("block-indirect-injection", "block", True, "inj AND stage IN ('retrieval', 'tool_result', 'memory_write')"),
                ("block-direct-injection", "block", True, "inj AND rsev >= 3"), ("block-unsafe-tool-flow", "block", True, "flow AND rsev >= 3"),
                ("block-tool-poisoning", "block", True, "false"), ("block-code-execution", "block", True, "false"), ("block-system-prompt-leak", "block", True, "false"),
                ("block-multi-turn-escalation", "block", True, "contains(dets, 'trajectory') AND rsev >= 3"), ("challenge-unverified-authority", "challenge", True, "claim AND rsev >= 3"),
                ("block-banned-content", "block", True, "contains(dets, 'banned_topics') AND rsev >= 3"), ("redact-personal-data", "redact", False, "pii"),
                ("flag-agentic-threats", "flag", False, "false"), ("flag-weak-injection-signals", "flag", False, "inj AND rsev >= 1"),
                ("flag-ungrounded-answers", "flag", False, "contains(dets, 'groundedness')"), ("flag-external-content-in-memory", "flag", False, "false")],
    "agent-safety": [("agent-block-unsafe-flow", "block", True, "flow"), ("agent-block-laundered-memory", "block", True, "false"),
                     ("agent-block-injected-tool-results", "block", True, "stage IN ('tool_result', 'retrieval') AND (inj OR claim)"),
                     ("agent-confirm-destructive-actions", "challenge", True, "stage = 'tool_call' AND coalesce(tool, '') IN ('payment.charge', 'email.send', 'shell.exec')"),
                     ("agent-block-credentials-in-arguments", "block", True, "stage = 'tool_call' AND sec"), ("agent-flag-external-in-memory", "flag", False, "false")],
    "gdpr": [("gdpr-block-special-category", "block", True, "false"), ("gdpr-minimise-personal-data", "redact", False, "pii"), ("gdpr-block-credentials", "block", True, "sec"),
             ("gdpr-flag-cross-border-model", "flag", False, "pii AND region <> 'eu'"), ("gdpr-redact-output-personal-data", "redact", False, "pii AND stage = 'output'")],
    "hipaa": [("hipaa-block-phi-to-uncovered-model", "block", True, "pii"), ("hipaa-block-identifiers", "block", True, "card"), ("hipaa-require-authentication", "block", True, "principal_id IS NULL"),
              ("hipaa-block-credentials", "block", True, "sec"), ("hipaa-block-phi-in-output", "block", True, "pii AND stage = 'output'")],
    "pci": [("pci-block-cardholder-data", "block", True, "card"), ("pci-block-credentials", "block", True, "sec"), ("pci-block-card-data-in-output", "block", True, "card AND stage = 'output'"),
            ("pci-restrict-payment-tools", "block", True, "stage = 'tool_call' AND coalesce(tool, '') = 'payment.charge'"), ("pci-flag-all-payment-activity", "flag", False, "coalesce(tool, '') = 'payment.charge'")],
}


def _compliance_sql(full: bool = False) -> str:
    """The rule sets as a ladder in SQL; with ``full`` facts, threats are known too."""
    parts = []
    for template, rules in _CR.items():
        stops = []
        cols = []
        for rule, action, stop, cond in rules:
            if full and rule == "flag-agentic-threats":
                cond = "contains(ths, 'ASI')"
            reach = " AND ".join(f"NOT ({s})" for s in stops) or "true"
            cols.append(f"CASE WHEN ({cond}) AND {reach} THEN {{'rule_id': '{rule}', 'r': {ACTIONS.index(action)}}} END")
            if stop:
                stops.append(cond)
        parts.append(f"SELECT '{template}' AS template, event_id, list_filter([{', '.join(cols)}], lambda x: x IS NOT NULL) AS ms FROM cf")
    none = "[{'rule_id': CAST(NULL AS VARCHAR), 'r': 0}]"
    return audit_sql(
        f"SELECT template, m.rule_id AS rule_id, {_NAME.format(x='top')} AS new_action, count(*) AS events FROM (SELECT template, unnest(CASE WHEN len(ms) = 0 THEN {none} ELSE ms END) AS m, "
        "coalesce(list_max(list_transform(ms, lambda x: x.r)), 0) AS top FROM (" + " UNION ALL ".join(parts) + ")) GROUP BY ALL",
        _FACTS, "cf AS (SELECT *, contains(dets, 'pii') AS pii, contains(dets, 'secrets') AS sec, contains(labs, 'credit_card') AS card, "
        "contains(dets, 'prompt_injection') AS inj, contains(dets, 'token_flow') AS flow, contains(dets, 'authority_claim') AS claim, "
        "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rsev FROM facts)")


@query("compliance_report", _compliance_sql())
def _compliance(spark, sf):
    """Recorded traffic as every bundled rule set would have treated it."""
    return A.compliance_report(audit(spark, sf), [bundled(n) for n in BUNDLES])


@query("replay_bundles", _compliance_sql(full=True))
def _bundles(spark, sf):
    """Recorded traffic under every bundled rule set, full facts."""
    return A.compliance_report(audit(spark, sf), [bundled(n) for n in BUNDLES], full_facts=True)


@query("redecide_events")
def _redecide(spark, sf):
    """Recorded findings of every stage decided again under the default policy and matrix."""
    e = audit(spark, sf).select("event_id", F.col("stage").alias("at"), "findings")
    return decide(e, stage=F.col("at")).groupBy("action", "risk.band").agg(F.count("*").alias("events"))
