"""Access control, tool scope, quotas and memory provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.operators import access as AC
from wardspark.operators import memory as M
from wardspark.operators import signals as S
from wardspark.operators import tools as TL
from wardspark.queries.base import CHATS_SQL, audit, audit_sql, chats, mem_sql, memories, query, re2, table
from wardspark.streaming.checkpoints import checkpoint_scan

# Roles are nations and regions: a nation inherits its region, two regions form a cycle.
_EDGES_SQL = ("edges AS (SELECT 'n' || n_nationkey AS role, 'r' || n_regionkey AS inherits FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || (r_regionkey + 1) FROM region WHERE r_regionkey < 2 UNION ALL SELECT 'r2', 'r0'), "
              "reach AS (SELECT role, role AS effective FROM (SELECT role FROM edges UNION SELECT inherits FROM edges) UNION SELECT reach.role, e.inherits FROM reach JOIN edges e ON e.role = reach.effective)")


def _edges(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("role"), F.concat(F.lit("r"), "n_regionkey").alias("inherits"))
    r = table(spark, sf, "region").filter("r_regionkey < 2").select(F.concat(F.lit("r"), "r_regionkey").alias("role"), F.concat(F.lit("r"), F.col("r_regionkey") + 1).alias("inherits"))
    back = table(spark, sf, "region").filter("r_regionkey = 2").select(F.lit("r2").alias("role"), F.lit("r0").alias("inherits"))
    return n.unionByName(r).unionByName(back)


@query("effective_roles", f"WITH RECURSIVE {_EDGES_SQL} SELECT role, effective FROM reach")
def _roles(spark, sf):
    return AC.effective_roles(_edges(spark, sf))


@query("effective_roles_sql", f"WITH RECURSIVE {_EDGES_SQL} SELECT role, effective FROM reach")
def _roles_sql(spark, sf):
    return AC.effective_roles_sql(_edges(spark, sf))


PERMISSIONS = (
    ("analyst", "tool", "crm.*", "allow"), ("analyst", "tool", "*.send", "allow"), ("analyst", "tool", "payment.*", "deny"),
    ("agent", "tool", "*", "allow"), ("agent", "*", "shell.*", "deny"), ("basic", "tool", "email.send", "deny"),
)
_ROLE_EDGES = (("agent", "basic"), ("service", "analyst"))
_VERDICT = ("CASE role WHEN 'agent' THEN CASE tool WHEN 'shell.exec' THEN 'denied by *:shell.*' WHEN 'email.send' THEN 'denied by tool:email.send' ELSE 'allowed by tool:*' END "
            "ELSE CASE tool WHEN 'payment.charge' THEN 'denied by tool:payment.*' WHEN 'crm.lookup' THEN 'allowed by tool:crm.*' WHEN 'email.send' THEN 'allowed by tool:*.send' "
            "ELSE 'no permission for tool:shell.exec (roles: ' || role || ')' END END")


def _calls(spark, sf):
    e = audit(spark, sf).filter("stage = 'tool_call'")
    return e.select("event_id", "correlation_id", "timestamp_ms", "action", "application", "model", "tenant", "principal_id", "instance_id",
                    F.col("principal_roles").alias("roles"), F.col("tags")["tool"].alias("tool"), F.col("principal_id").isNotNull().alias("authenticated"))


def _access(spark, sf):
    perms = spark.createDataFrame(list(PERMISSIONS), "role string, resource_type string, pattern string, effect string")
    closure = AC.effective_roles(spark.createDataFrame(list(_ROLE_EDGES), "role string, inherits string"))
    asked = _calls(spark, sf).select("event_id", "roles", F.lit("tool").alias("resource_type"), F.col("tool").alias("resource"))
    return AC.audit_access(asked, perms, closure)


@query("audit_access", audit_sql(f"SELECT role, tool, {_VERDICT} LIKE 'allowed%' AS allowed, {_VERDICT} AS reason, count(*) AS n FROM a WHERE stage = 'tool_call' GROUP BY ALL"))
def _audit_access(spark, sf):
    calls = _calls(spark, sf).select("event_id", F.col("roles")[0].alias("role"), "tool")
    return calls.join(_access(spark, sf), "event_id").groupBy("role", "tool", "allowed", "reason").agg(F.count("*").alias("n"))


@query("resolve_tool_risk", audit_sql("SELECT tool, CASE tool WHEN 'crm.lookup' THEN 'medium' WHEN 'email.send' THEN 'high' ELSE 'critical' END AS tool_risk, count(*) AS n FROM a WHERE stage = 'tool_call' GROUP BY ALL"))
def _tool_risk(spark, sf):
    specs = spark.createDataFrame([("crm.lookup", "medium")], "tool string, risk string")
    return TL.resolve_tool_risk(_calls(spark, sf), specs).groupBy("tool", "tool_risk").agg(F.count("*").alias("n"))


_HALT = "fb AS (SELECT correlation_id, min(timestamp_ms * 1 + 0) AS t FROM a WHERE action = 'block' GROUP BY 1), hl AS (SELECT a.*, coalesce(a.timestamp_ms > fb.t, false) AS halted FROM a LEFT JOIN fb USING (correlation_id))"


@query("halt_after_block", audit_sql("SELECT stage, halted, count(*) AS events FROM hl GROUP BY ALL", _HALT))
def _halt(spark, sf):
    return TL.halt_after_block(audit(spark, sf)).groupBy("stage", "halted").agg(F.count("*").alias("events"))


@query("tool_scope", audit_sql(
    f"SELECT tool, role, CASE WHEN halted THEN 'agent run halted' WHEN tool = 'shell.exec' THEN 'tool matches denylist entry ''shell.*''' WHEN tool = 'payment.charge' AND role <> 'agent' THEN 'tool requires one of roles [''agent'']' "
    f"WHEN {_VERDICT} NOT LIKE 'allowed%' THEN {_VERDICT} END AS scope_reason, count(*) AS n FROM hl WHERE stage = 'tool_call' GROUP BY ALL", _HALT))
def _scope(spark, sf):
    halted = TL.halt_after_block(audit(spark, sf)).select("event_id", "halted")
    calls = _calls(spark, sf).join(halted, "event_id")
    out = TL.tool_scope(calls, denylist=["shell.*"], allowlist=["*.*"], tool_roles={"payment.charge": ["agent"]}, access=_access(spark, sf), halted=F.col("halted"))
    return out.groupBy("tool", F.col("roles")[0].alias("role"), "scope_reason").agg(F.count("*").alias("n"))


_MODEL_PERMISSIONS = (("agent", "model", "model-*", "allow"), ("agent", "model", "model-2", "deny"), ("analyst", "model", "model-0", "allow"))
_MODEL_VERDICT = ("CASE role WHEN 'agent' THEN CASE model WHEN 'model-2' THEN 'denied by model:model-2' ELSE 'allowed by model:model-*' END "
                  "ELSE CASE model WHEN 'model-0' THEN 'allowed by model:model-0' ELSE 'no permission for model:' || model || ' (roles: ' || role || ')' END END")


@query("access_denials", audit_sql(
    f"SELECT denial, CASE denial WHEN 'unauthenticated' THEN 'unauthenticated principal' WHEN 'model_forbidden' THEN 'model: ' || v ELSE 'rate limit exceeded for tenant:' || tenant END AS denial_reason, count(*) AS n FROM "
    f"(SELECT CASE WHEN principal_id IS NULL THEN 'unauthenticated' WHEN {_MODEL_VERDICT} NOT LIKE 'allowed%' THEN 'model_forbidden' WHEN k % 5 = 0 THEN 'rate_limited' END AS denial, {_MODEL_VERDICT} AS v, tenant FROM a WHERE stage = 'tool_call') "
    "WHERE denial IS NOT NULL GROUP BY ALL"))
def _denials(spark, sf):
    """Calls refused for their principal, their model or a limit, in that order; every fifth is over its tenant's limit."""
    e = audit(spark, sf).filter("stage = 'tool_call'")
    perms = spark.createDataFrame(list(_MODEL_PERMISSIONS), "role string, resource_type string, pattern string, effect string")
    closure = AC.effective_roles(spark.createDataFrame(list(_ROLE_EDGES), "role string, inherits string"))
    calls = _calls(spark, sf)
    access = AC.audit_access(calls.select("event_id", "roles", F.lit("model").alias("resource_type"), F.col("model").alias("resource")), perms, closure)
    limits = e.select("event_id", (F.substring("prompt", 15, 9).cast("int") % 5 != 0).alias("allowed"), F.concat(F.lit("tenant:"), "tenant").alias("scope"))
    return AC.access_denials(calls, access, limits).groupBy("denial", "denial_reason").agg(F.count("*").alias("n"))


@query("quota_lease", "SELECT 's' || s_suppkey AS scope, CAST(greatest(1, (s_suppkey + 5) // (SELECT count(*) FROM nation WHERE n_nationkey % 4 <> 0)) AS INT) AS rpm, CAST(greatest(1, greatest(1, s_suppkey // 3) // (SELECT count(*) FROM nation WHERE n_nationkey % 4 <> 0)) AS INT) AS burst FROM supplier")
def _lease(spark, sf):
    quotas = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("scope"), (F.col("s_suppkey") + 5).alias("rpm"), F.expr("s_suppkey div 3").alias("burst"))
    fleet = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 4 == 0, "stale").otherwise("healthy").alias("status"))
    return AC.quota_lease(quotas, fleet)


@query("replay_rate_limits")
def _limits(spark, sf):
    """Recorded requests under tight token buckets, per instance."""
    e = audit(spark, sf).select("event_id", "instance_id", "timestamp_ms", "principal_id", "tenant", F.col("principal_roles").alias("roles"), "model")
    spec = {"*": {"rpm": 1, "burst": 3}, "role:service": {"rpm": 1, "burst": 2}, "tenant:t0": {"rpm": 1, "burst": 1}}
    return AC.replay_rate_limits(e, spec).groupBy("allowed", "scope").agg(F.count("*").alias("n"))


# --- memories -----------------------------------------------------------------------------


@query("effective_trust", mem_sql("SELECT memory_id, CASE level WHEN 5 THEN 'system' WHEN 4 THEN 'user_confirmed' WHEN 3 THEN 'user' WHEN 2 THEN 'tool' WHEN 1 THEN 'retrieved' ELSE 'external' END AS effective_trust, "
                                  "confirmed, CAST(authority AS INT) AS authority FROM memx"))
def _trust(spark, sf):
    return M.effective_trust(memories(spark, sf)).select("memory_id", "effective_trust", "confirmed", "authority")


@query("memory_stats", mem_sql("SELECT CASE level WHEN 5 THEN 'system' WHEN 4 THEN 'user_confirmed' WHEN 3 THEN 'user' WHEN 2 THEN 'tool' WHEN 1 THEN 'retrieved' ELSE 'external' END AS effective_trust, count(*) AS total, "
                               "count(*) FILTER (WHERE parent IS NOT NULL) AS derived, count(*) FILTER (WHERE confirmed) AS user_confirmed FROM memx GROUP BY 1"))
def _mstats(spark, sf):
    return M.memory_stats(M.effective_trust(memories(spark, sf)))


@query("lineage", mem_sql("SELECT memory_id, ancestor, CAST(depth AS INT) AS depth FROM anc"))
def _lineage(spark, sf):
    m = memories(spark, sf)
    return M.lineage(m, m.select("memory_id"))


_TERMS = "list_filter(list_distinct(regexp_extract_all(lower({t}), '[a-z0-9_.\\-]{{3,}}')), lambda w: NOT list_contains({stop}, w))"
_MSTOP = "['" + "', '".join("the and for with from that this when where what have has was were are you your our their".split()) + "']"
_RECALL = (
    f"q AS (SELECT 'q' || item_id AS query_id, item_id, text, {_TERMS.format(t='text', stop=_MSTOP)} AS ts FROM benchmark), qt AS (SELECT query_id, len(ts) AS n, unnest(ts) AS t FROM q), "
    f"mt AS (SELECT memory_id, authority, unnest({_TERMS.format(t='content', stop=_MSTOP)}) AS t FROM memx), "
    "pr AS (SELECT query_id, memory_id, authority, count(*) / any_value(n) AS overlap FROM qt JOIN mt USING (t) GROUP BY ALL), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY authority DESC, overlap DESC, memory_id) AS rank FROM pr)"
)


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("query_id"), "item_id", "text")


@query("recall", mem_sql("SELECT query_id, memory_id, CAST(authority AS INT) AS authority, round(overlap, 6) AS overlap, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 5", _RECALL))
def _recall(spark, sf):
    m = M.effective_trust(memories(spark, sf))
    return M.recall(_queries(spark, sf), m).withColumn("overlap", F.round("overlap", 6))


_GATE = (_RECALL + ", cl AS (SELECT query_id, CASE item_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'critical' ELSE 'medium' END AS risk, item_id % 7 = 0 AS uc FROM q), "
         "sp AS (SELECT query_id, max(authority) AS av, min(authority) AS wk, string_agg(memory_id, ',' ORDER BY memory_id) AS ids FROM rk WHERE rank <= 10 AND overlap >= 0.2 GROUP BY 1), "
         "gt AS (SELECT cl.*, risk IN ('high', 'critical') AS gated, sp.av, sp.wk, sp.ids FROM cl LEFT JOIN sp USING (query_id)), "
         "gr AS (SELECT *, NOT gated OR uc OR coalesce(av >= 4, false) AS allowed FROM gt)")


def _gated(spark, sf):
    i = F.col("item_id")
    calls = _queries(spark, sf).select("query_id", "text", F.when(i % 3 == 0, "high").when(i % 3 == 1, "critical").otherwise("medium").alias("risk"), (i % 7 == 0).alias("user_confirmed"))
    return M.authorize_calls(calls, M.effective_trust(memories(spark, sf)))


@query("authorize_calls", mem_sql(
    "SELECT query_id, risk, allowed, CAST(CASE WHEN NOT gated THEN 5 WHEN uc THEN 4 ELSE coalesce(av, -1) END AS INT) AS available_authority, CASE WHEN gated AND NOT uc THEN coalesce(ids, '') ELSE '' END AS supporting FROM gr", _GATE))
def _authorize(spark, sf):
    return _gated(spark, sf).select("query_id", "risk", "allowed", "available_authority", F.array_join("supporting", ",").alias("supporting"))


@query("gate_findings", mem_sql("SELECT risk, NOT allowed AS detected, CASE WHEN allowed THEN 'allow' ELSE 'block' END AS action, count(*) AS n FROM gr GROUP BY ALL", _GATE))
def _gate(spark, sf):
    return M.gate_findings(_gated(spark, sf)).groupBy("risk", "finding.detected", "finding.action").agg(F.count("*").alias("n"))


# The checking engine knows neither look-ahead nor counts above 1000.
_LEAKS = "|".join(f"(?:{e.pattern})" for e in S.VENDOR_TOKENS).replace("(?!ant-)", "").replace("1024}", "1000}").replace("2048}", "1000}")
_BANNED = "|".join(rf"\b{t}\b" for _, terms in S.BANNED_TOPICS.values() for t in terms)


@query("checkpoint_scan", f"""
WITH {CHATS_SQL}, d AS (SELECT conv_id || '_' || turn AS stream_id, text || CASE WHEN conv_id % 4 = 0 THEN ' here is the ransomware payload' ELSE '' END AS text FROM chats WHERE role = 'assistant'),
c AS (SELECT stream_id, text, length(text) AS n, CAST(ceil(length(text) / 80) AS BIGINT) AS chunks FROM d),
k AS (SELECT *, unnest(range(1, (chunks + 1) // 2 + 1)) AS k FROM c),
v AS (SELECT *, regexp_matches(substr(text, 1, least(160 * k, n)), {re2(_BANNED, True)}) OR regexp_matches(substr(text, 1, least(160 * k, n)), {re2(_LEAKS)}) AS bad FROM k),
s AS (SELECT stream_id, any_value(n) AS n, any_value(chunks) AS chunks, max(k) AS last, min(k) FILTER (WHERE bad) AS stop FROM v GROUP BY 1)
SELECT stream_id, chunks, CAST(coalesce(stop, last) AS BIGINT) AS checkpoints, stop IS NOT NULL AS broken, CAST(CASE WHEN stop IS NULL THEN n ELSE 160 * (stop - 1) END AS BIGINT) AS delivered_chars, CAST(n AS BIGINT) AS total_chars FROM s""")
def _checkpoints(spark, sf):
    """Assistant messages cut into 80-character chunks and replayed as streamed output."""
    said = chats(spark, sf).filter("role = 'assistant'")
    harm = F.when(F.col("conv_id") % 4 == 0, F.lit(" here is the ransomware payload")).otherwise(F.lit(""))
    d = said.select(F.concat_ws("_", "conv_id", "turn").alias("stream_id"), F.concat("text", harm).alias("text"))
    n = F.ceil(F.length("text") / 80).cast("int")
    chunks = d.select("stream_id", "text", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("seq", "i")).select(
        "stream_id", F.col("seq").cast("bigint").alias("seq"), F.substring(F.col("text"), F.col("i") * 80 + 1, F.lit(80)).alias("chunk"))
    return checkpoint_scan(chunks).drop("break_signals")
