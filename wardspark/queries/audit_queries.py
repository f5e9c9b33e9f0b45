"""Ingest, exports, analytics, anomalies and alerts over the audit view."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.operators import alerts as AL
from wardspark.operators import anomaly as AN
from wardspark.operators import audit as A
from wardspark.operators import taxonomy as T
from wardspark.operators.scan import with_scalars
from wardspark.queries.base import audit, audit_events, audit_sql, query, table
from wardspark.sources import audit_log as L
from wardspark.sources import export as X

_CUT = 1_705_276_800_000  # 2024-01-15
_PER = lambda col, names, prefix="": ", ".join(f"count(*) FILTER (WHERE {col} = '{n}') AS {prefix}{n}" for n in names)
ACT = ("allow", "flag", "redact", "challenge", "block")
SEV = ("info", "low", "medium", "high", "critical")


@query("normalise_event", audit_sql(
    "SELECT a.event_id, a.risk_score, a.risk_band, a.received_ms, coalesce(d.ds, '') AS detectors, coalesce(d.cs, '') AS categories, coalesce(t.ts, '') AS threats, "
    "lower(concat_ws(' ', prompt, principal_id, application, model, s.sm, nullif(coalesce(d.ds2, ''), ''), nullif(coalesce(t.ts2, ''), ''))) AS search_text FROM a "
    "LEFT JOIN (SELECT event_id, string_agg(detector, ',' ORDER BY pos) AS ds, string_agg(detector, ' ' ORDER BY pos) AS ds2, string_agg(DISTINCT category, ',' ORDER BY category) AS cs FROM f WHERE detected GROUP BY 1) d USING (event_id) "
    "LEFT JOIN (SELECT event_id, string_agg(detector || ' fired', ' ' ORDER BY pos) AS sm FROM f GROUP BY 1) s USING (event_id) "
    "LEFT JOIN (SELECT event_id, string_agg(threat, ',' ORDER BY ord) AS ts, string_agg(threat, ' ' ORDER BY ord) AS ts2 FROM th GROUP BY 1) t USING (event_id)"))
def _normalise(spark, sf):
    return audit(spark, sf).select("event_id", "risk_score", "risk_band", "received_ms", F.array_join("detectors_fired", ",").alias("detectors"),
                                   F.array_join("categories", ",").alias("categories"), F.array_join("threats", ",").alias("threats"), "search_text")


@query("ingest_json", audit_sql(
    "SELECT CASE WHEN k IN (97, 98) THEN 'rejected' ELSE 'accepted' END AS outcome, CASE k WHEN 98 THEN 'malformed JSON or wrong field type' WHEN 97 THEN 'missing stage' ELSE stage END AS key, "
    "count(*) AS n FROM a GROUP BY ALL"))
def _ingest(spark, sf):
    """Events round-tripped through JSON lines, some of them broken, parsed tolerantly."""
    e = audit_events(spark, sf)
    body = F.to_json(F.struct(*e.columns))
    k = F.substring("prompt", 15, 9).cast("int")
    raw = e.select(F.when(k == 98, F.lit("{broken")).when(k == 97, F.replace(body, F.lit('"stage":'), F.lit('"stagf":'))).otherwise(body).alias("value"))
    ok, bad = L.ingest(raw)
    good = ok.groupBy("stage").agg(F.count("*").alias("n")).select(F.lit("accepted").alias("outcome"), F.col("stage").alias("key"), "n")
    return good.unionByName(bad.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("rejected").alias("outcome"), F.col("reason").alias("key"), "n"))


@query("idempotent_ingest", audit_sql(
    "SELECT (SELECT count(DISTINCT event_id) FROM a WHERE k >= 20) AS accepted, (SELECT count(*) FROM a) + (SELECT count(*) FROM a WHERE k >= 60) - (SELECT count(DISTINCT event_id) FROM a WHERE k >= 20) AS duplicates"))
def _idempotent(spark, sf):
    """A batch delivered with repeats, against a store that already holds part of it."""
    e = audit(spark, sf).select("event_id", F.substring("prompt", 15, 9).cast("int").alias("k"))
    batch = e.unionByName(e.filter("k >= 60"))
    return L.ingest_counts(batch, e.filter("k < 20"))


@query("dedupe_rows", audit_sql("SELECT application, count(*) AS events FROM a WHERE k >= 20 GROUP BY 1"))
def _dedupe(spark, sf):
    e = audit(spark, sf).withColumn("k", F.substring("prompt", 15, 9).cast("int")).select("event_id", "application", "k")
    return L.idempotent_ingest(e.unionByName(e.filter("k >= 60")), e.filter("k < 20")).groupBy("application").agg(F.count("*").alias("events"))


@query("purge_older_than", audit_sql(f"SELECT application, count(*) AS kept, min(timestamp_ms) AS oldest FROM a WHERE timestamp_ms >= {_CUT} GROUP BY 1"))
def _purge(spark, sf):
    return L.purge_older_than(audit(spark, sf), _CUT).groupBy("application").agg(F.count("*").alias("kept"), F.min("timestamp_ms").alias("oldest"))


@query("erase_subject", audit_sql("SELECT tenant, count(*) AS kept, count(DISTINCT principal_id) AS principals FROM a WHERE principal_id IS NULL OR principal_id NOT IN (SELECT 'u' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1"))
def _erase(spark, sf):
    """Subjects are the customers of one segment."""
    gone = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("u"), "c_custkey").alias("principal_id"))
    return L.erase_subject(audit(spark, sf), gone).groupBy("tenant").agg(F.count("*").alias("kept"), F.count_distinct("principal_id").alias("principals"))


@query("to_siem_json", audit_sql(
    "SELECT a.event_id, action, severity, CAST(timestamp_ms AS VARCHAR) AS rt, CASE WHEN pii_label IS NULL THEN '1' ELSE '2' END AS n_findings, trust, '25' AS n_fields FROM a"))
def _siem(spark, sf):
    r = X.to_siem_json(audit(spark, sf))
    j = lambda p: F.get_json_object("record", p)
    n = F.json_array_length(j("$.findings")).cast("string")
    fields = F.size(F.json_object_keys("record")).cast("string")
    return r.select("event_id", j("$.action").alias("action"), j("$.severity").alias("severity"), j("$.timestamp_ms").alias("rt"), n.alias("n_findings"),
                    j("$.tags.trust").alias("trust"), fields.alias("n_fields"))


_CEF = ("'CEF:0|Wardspark|LLM Traffic Security|1.0|' || CASE WHEN action <> 'allow' THEN category WHEN pii_label IS NOT NULL THEN 'sensitive_data' ELSE 'audit.' || stage END || '|' || "
        "CASE WHEN action <> 'allow' THEN detector || ' fired' WHEN pii_label IS NOT NULL THEN 'pii fired' ELSE action || ' at ' || stage END || '|' || "
        "greatest(CASE action WHEN 'allow' THEN 1 WHEN 'flag' THEN 4 WHEN 'redact' THEN 4 WHEN 'challenge' THEN 7 ELSE 8 END, CASE severity WHEN 'info' THEN 1 WHEN 'low' THEN 3 WHEN 'medium' THEN 5 WHEN 'high' THEN 8 ELSE 10 END)")


@query("to_cef", audit_sql(
    f"SELECT a.event_id, {_CEF} || '|rt=' || timestamp_ms || ' externalId=' || a.event_id || ' cs1Label=correlationId cs1=' || correlation_id || ' cs2Label=detectors' AS head, "
    "'act=' || action || ' outcome=' || CASE WHEN action IN ('block', 'challenge') THEN 'failure' ELSE 'success' END || coalesce(' suser=' || principal_id, '') || ' duser=' || tenant || ' dproc=' || model || ' app=' || application || ' deviceProcessName=' || stage || ' cn1Label=latencyMs' AS mid, "
    "'cn2Label=riskScore cn2=' || risk_score || ' cs6Label=riskBand cs6=' || risk_band || ' deviceExternalId=' || instance_id AS tail FROM a"))
def _cef(spark, sf):
    r = X.to_cef(audit(spark, sf))
    return r.select("event_id", F.regexp_extract("record", r"^(.*cs2Label=detectors)", 1).alias("head"),
                    F.regexp_extract("record", r"(act=.*cn1Label=latencyMs)", 1).alias("mid"), F.regexp_extract("record", r"(cn2Label=.*)$", 1).alias("tail"))


@query("to_syslog", audit_sql(
    "SELECT event_id, '<' || (104 + greatest(0, least(7, 7 - (CASE severity WHEN 'info' THEN 1 WHEN 'low' THEN 3 WHEN 'medium' THEN 5 WHEN 'high' THEN 8 ELSE 10 END) // 2))) || '>1 ' || "
    "strftime(make_timestamp((timestamp_ms // 1000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') || ' ' || application || ' wardspark - - - CEF:0|' AS head FROM a"))
def _syslog(spark, sf):
    return X.to_syslog(audit(spark, sf)).select("event_id", F.regexp_extract("record", r"^(.*?CEF:0\|)", 1).alias("head"))


@query("to_otlp_records", audit_sql(
    "SELECT event_id, CAST(timestamp_ms AS VARCHAR) || '000000' AS nanos, CAST(CASE severity WHEN 'medium' THEN 13 WHEN 'high' THEN 17 WHEN 'critical' THEN 21 ELSE 9 END AS VARCHAR) AS level, upper(severity) AS text, "
    "CASE WHEN action <> 'allow' THEN detector || ' fired' WHEN pii_label IS NOT NULL THEN 'pii fired' ELSE action || ' at ' || stage END AS body, 'audit.action=' || action AS third, trace_id FROM a"))
def _otlp(spark, sf):
    j = lambda p: F.get_json_object("record", p)
    return X.to_otlp_records(audit(spark, sf)).select(
        "event_id", j("$.timeUnixNano").alias("nanos"), j("$.severityNumber").alias("level"), j("$.severityText").alias("text"), j("$.body.stringValue").alias("body"),
        F.concat_ws("=", j("$.attributes[2].key"), j("$.attributes[2].value.stringValue")).alias("third"), j("$.traceId").alias("trace_id"))


# --- search and correlation --------------------------------------------------------------


@query("search_events", audit_sql(
    f"SELECT event_id, timestamp_ms, action FROM a WHERE timestamp_ms >= {_CUT} AND environment = 'production' AND severity IN ('medium', 'high', 'critical') AND risk_score >= 4 AND "
    "event_id IN (SELECT event_id FROM f WHERE detected AND detector = 'token_flow') AND event_id IN (SELECT event_id FROM th WHERE threat = 'ASI02') AND contains(lower(concat_ws(' ', prompt, principal_id, application)), 'number 1')"))
def _search(spark, sf):
    e = A.search_events(audit(spark, sf), since_ms=_CUT, environment="production", min_severity="medium", min_risk=4, detector="TOKEN_flow", threat="asi02", search="Number 1")
    return e.select("event_id", "timestamp_ms", "action")


@query("page_events", audit_sql("SELECT event_id, timestamp_ms FROM a WHERE action = 'block' ORDER BY timestamp_ms DESC, event_id DESC LIMIT 50 OFFSET 100"))
def _page(spark, sf):
    return A.page(A.search_events(audit(spark, sf), action="block"), 50, 100).select("event_id", "timestamp_ms")


@query("search_total", audit_sql("SELECT count(*) AS total FROM a WHERE action = 'block'"))
def _total(spark, sf):
    return A.search_events(audit(spark, sf), action="block").agg(F.count("*").alias("total"))


@query("get_event", audit_sql("SELECT event_id, correlation_id, action, severity FROM a WHERE event_id = 'evt_77'"))
def _get(spark, sf):
    return A.get_event(audit(spark, sf), "evt_77").select("event_id", "correlation_id", "action", "severity")


@query("correlation_timeline", audit_sql("SELECT event_id, timestamp_ms, stage, action FROM a WHERE correlation_id = 'req_19'"))
def _timeline_of(spark, sf):
    return A.correlation_timeline(audit(spark, sf), "req_19").select("event_id", "timestamp_ms", "stage", "action")


@query("correlation_summary", audit_sql(
    "SELECT correlation_id, 1 AS part, arg_min(application, timestamp_ms) AS application, min(timestamp_ms) AS started_ms, max(timestamp_ms) - min(timestamp_ms) AS duration_ms, string_agg(stage, ',' ORDER BY timestamp_ms, event_id) AS stages, "
    "arg_max(action, CASE action WHEN 'block' THEN 4 WHEN 'challenge' THEN 3 WHEN 'redact' THEN 2 WHEN 'flag' THEN 1 ELSE 0 END) AS outcome, any_value(coalesce(ds, '')) AS detectors FROM a "
    "LEFT JOIN (SELECT correlation_id AS cid, string_agg(DISTINCT f.detector, ',' ORDER BY f.detector) AS ds FROM f JOIN a USING (event_id) WHERE f.detected GROUP BY 1) d ON d.cid = a.correlation_id GROUP BY 1"))
def _summary(spark, sf):
    s = A.correlation_summary(audit(spark, sf))
    return s.select("correlation_id", "part", "application", "started_ms", "duration_ms", F.array_join("stages", ",").alias("stages"), "outcome", F.array_join("detectors_fired", ",").alias("detectors"))


@query("correlation_stages", audit_sql(
    "SELECT correlation_id, CAST(n // 64 + 1 AS INT) AS part, string_agg(stage, ',' ORDER BY n) AS stages FROM "
    "(SELECT principal_id AS correlation_id, stage, row_number() OVER (PARTITION BY principal_id ORDER BY timestamp_ms, event_id, stage) - 1 AS n FROM a WHERE principal_id IS NOT NULL) GROUP BY ALL"))
def _stages(spark, sf):
    """Stages in numbered parts, a principal's whole traffic taken as one long request."""
    s = A.correlation_stages(audit(spark, sf).withColumn("correlation_id", F.col("principal_id")))
    return s.select("correlation_id", "part", F.array_join("stages", ",").alias("stages"))


_SESS = ("se AS (SELECT *, CASE WHEN k % 3 = 0 THEN NULL ELSE session_id END AS sid FROM a), "
         "gp AS (SELECT *, coalesce(principal_id, 'anonymous') AS who, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY coalesce(principal_id, 'anonymous') ORDER BY timestamp_ms, event_id) AS pause FROM se WHERE sid IS NULL), "
         "gs AS (SELECT *, count(*) FILTER (WHERE pause >= 1800000) OVER (PARTITION BY who ORDER BY timestamp_ms, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM gp)")
_SESS_AGG = "min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, count(*) AS events, count(*) FILTER (WHERE action IN ('block', 'challenge')) AS blocked"


@query("session_activity", audit_sql(
    f"SELECT sid AS session, true AS known, {_SESS_AGG} FROM se WHERE sid IS NOT NULL GROUP BY sid UNION ALL "
    f"SELECT 'gap:' || who, false, {_SESS_AGG} FROM gs GROUP BY who, nth", _SESS))
def _sessions(spark, sf):
    """Sessions by id, and by pauses where every third event lost its id."""
    e = audit(spark, sf)
    return A.session_activity(e.withColumn("session_id", F.when(F.substring("prompt", 15, 9).cast("int") % 3 != 0, F.col("session_id"))))


# --- aggregates -----------------------------------------------------------------------------


@query("overview", audit_sql(
    "SELECT 'action' AS facet, action AS key, count(*) AS events, CAST(NULL AS DOUBLE) AS value FROM a GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*), NULL FROM a GROUP BY 2 "
    "UNION ALL SELECT 'application', application, count(*), NULL FROM a GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*), NULL FROM a "
    "UNION ALL SELECT 'measure', 'blocked', count(*), CAST(count(*) FILTER (WHERE action IN ('block', 'challenge')) AS DOUBLE) FROM a "
    "UNION ALL SELECT 'measure', 'block_rate', count(*), round(count(*) FILTER (WHERE action IN ('block', 'challenge')) / count(*), 4) FROM a "
    "UNION ALL SELECT 'measure', 'avg_latency_ms', count(*), round(avg(latency_ms), 2) FROM a UNION ALL SELECT 'measure', 'max_latency_ms', count(*), round(max(latency_ms), 2) FROM a"))
def _overview(spark, sf):
    return A.overview(audit(spark, sf))


@query("minute_counters", audit_sql("SELECT timestamp_ms // 60000 * 60000 AS bucket_ms, application, action, count(*) AS count FROM a GROUP BY ALL"))
def _counters(spark, sf):
    return A.minute_counters(audit(spark, sf))


@query("timeline", audit_sql(f"SELECT timestamp_ms // 3600000 * 3600000 AS bucket_ms, count(*) AS total, {_PER('action', ACT)} FROM a WHERE application = 'app2' GROUP BY 1"))
def _timeline(spark, sf):
    return A.timeline(A.minute_counters(audit(spark, sf)), 60, "app2")


@query("detector_stats", audit_sql(
    "SELECT detector, count(*) AS runs, count(*) FILTER (WHERE detected) AS hits, round(count(*) FILTER (WHERE detected) / count(*), 4) AS hit_rate, count(error) AS errors, round(CAST(sum(elapsed_ms) AS DOUBLE) / count(*), 3) AS avg_latency_ms, "
    f"any_value(category) AS categories, {', '.join(f'count(*) FILTER (WHERE detected AND severity = {chr(39)}{s}{chr(39)}) AS hits_{s}' for s in SEV)} FROM f GROUP BY 1"))
def _dstats(spark, sf):
    return A.detector_stats(audit(spark, sf)).withColumn("categories", F.array_join("categories", ","))


@query("band_counts", audit_sql("SELECT risk_band AS band, count(*) AS events FROM a GROUP BY 1"))
def _bands(spark, sf):
    return A.band_counts(audit(spark, sf))


@query("threat_stats", audit_sql("SELECT threat, count(*) AS events, count(*) FILTER (WHERE action IN ('block', 'challenge')) AS blocked FROM th JOIN a USING (event_id) WHERE risk_score > 0 GROUP BY 1"))
def _threats(spark, sf):
    return A.threat_stats(audit(spark, sf))


@query("riskiest_events", audit_sql("SELECT event_id, timestamp_ms, risk_score, risk_band FROM a WHERE risk_score > 0 ORDER BY risk_score DESC, timestamp_ms DESC, event_id LIMIT 15"))
def _riskiest(spark, sf):
    return A.riskiest_events(audit(spark, sf)).select("event_id", "timestamp_ms", "risk_score", "risk_band")


@query("policy_stats", audit_sql(
    f"SELECT 'default' AS policy_id, 'rule-' || event_type AS rule_id, count(*) AS matches, round(sum(k / 100.0) / count(*), 4) AS avg_eval_ms, {_PER('action', ACT, 'action_')} FROM a WHERE action <> 'allow' GROUP BY 2"))
def _pstats(spark, sf):
    return A.policy_stats(audit(spark, sf))


@query("top_offenders", audit_sql("SELECT principal_id, application, count(*) AS blocked_events FROM a WHERE action IN ('block', 'challenge') GROUP BY ALL ORDER BY blocked_events DESC, principal_id NULLS FIRST, application LIMIT 10"))
def _offenders(spark, sf):
    return A.top_offenders(audit(spark, sf))


@query("recent_for_anomaly", audit_sql(f"SELECT application, action, count(*) AS events FROM a WHERE timestamp_ms >= {_CUT} GROUP BY ALL"))
def _recent(spark, sf):
    return A.recent_for_anomaly(audit(spark, sf), _CUT).groupBy("application", "action").agg(F.count("*").alias("events"))


@query("attack_rate_by", audit_sql(
    "SELECT application, stage, count(*) AS events, count(*) FILTER (WHERE action IN ('block', 'challenge')) AS blocked, round(count(*) FILTER (WHERE action IN ('block', 'challenge')) / count(*), 4) AS block_rate, round(avg(risk_score), 4) AS avg_risk FROM a GROUP BY CUBE (application, stage)"))
def _rate(spark, sf):
    return A.attack_rate_by(audit(spark, sf), "application", "stage", how="cube")


@query("latency_quantiles", audit_sql("SELECT stage, quantile_cont(latency_ms, 0.5) AS p50_ms, quantile_cont(latency_ms, 0.95) AS p95_ms, count(*) AS events FROM a GROUP BY 1"))
def _quantiles(spark, sf):
    q = A.latency_quantiles(audit(spark, sf), "stage", exact=True)
    return q


_APPS = ("app0", "app1", "app2")
_APP = "CASE WHEN application IN ('app0', 'app1', 'app2') THEN application ELSE 'other' END"


@query("metric_counters", audit_sql(
    "SELECT metric, labels, count(*) AS value FROM ("
    f"SELECT 'requests_total' AS metric, 'action=' || action || ',application=' || {_APP} || ',stage=' || stage AS labels FROM a UNION ALL "
    f"SELECT 'telemetry_events_total', 'application=' || {_APP} || ',outcome=emitted' FROM a UNION ALL "
    f"SELECT 'detector_runs_total', 'application=' || {_APP} || ',detector=' || detector || ',outcome=' || CASE WHEN error IS NOT NULL THEN 'error' WHEN detected THEN 'detected' ELSE 'clean' END || ',stage=' || stage FROM f UNION ALL "
    f"SELECT 'detector_hits_total', 'action=' || action || ',application=' || {_APP} || ',detector=' || detector || ',severity=' || severity FROM f WHERE detected UNION ALL "
    f"SELECT 'detector_errors_total', 'application=' || {_APP} || ',detector=' || detector || ',fail_mode=' || CASE WHEN detected THEN 'closed' ELSE 'open' END FROM f WHERE error IS NOT NULL UNION ALL "
    f"SELECT 'policy_evaluations_total', 'action=' || action || ',application=' || {_APP} || ',policy_id=default' FROM a UNION ALL "
    f"SELECT 'threat_detections_total', 'action=' || ft.event_action || ',application=' || {_APP} || ',framework=' || CASE substr(threat, 1, 3) WHEN 'LLM' THEN '{T.LLM}' WHEN 'ASI' THEN '{T.ASI}' ELSE '{T.MCP}' END || ',stage=' || a.stage || ',threat=' || threat FROM ft JOIN a USING (event_id) UNION ALL "
    f"SELECT 'risk_decisions_total', 'application=' || {_APP} || ',band=' || risk_band || ',stage=' || stage FROM a WHERE risk_score > 0 UNION ALL "
    f"SELECT 'blocked_total', 'application=' || {_APP} || ',category=' || category || ',stage=' || stage FROM a WHERE action = 'block') GROUP BY ALL"))
def _mcounters(spark, sf):
    return A.metric_counters(audit(spark, sf), _APPS)


def _hist_sql(name: str, value: str, bounds, source: str, labels: dict[str, str]) -> str:
    les = ", ".join(f"('{b}', {b})" for b in bounds) + ", ('+Inf', 1e300)"
    named = ", ".join(f"{labels.get(n, 'CAST(NULL AS VARCHAR)')} AS {n}" for n in ("stage", "application", "detector", "policy_id", "provider"))
    return (f"SELECT '{name}' AS metric, stage, application, detector, policy_id, provider, round(CAST(sum(v) AS DOUBLE), 4) AS sum, count(*) AS count, le, count(*) FILTER (WHERE v <= ub) AS bucket "
            f"FROM (SELECT {named}, {value} AS v FROM {source}) x, (VALUES {les}) b(le, ub) WHERE v IS NOT NULL GROUP BY ALL")


_BY_STAGE = {"stage": "stage", "application": "application"}


@query("metric_histograms", audit_sql(" UNION ALL ".join((
    _hist_sql("pipeline_latency_ms", "latency_ms", A.LATENCY_BOUNDS, "a", _BY_STAGE),
    _hist_sql("risk_score", "CASE WHEN risk_score > 0 THEN risk_score END", A.RISK_BOUNDS, "a", _BY_STAGE),
    _hist_sql("detector_latency_ms", "elapsed_ms", A.LATENCY_BOUNDS, "f", {"detector": "detector", "application": "application"}),
    _hist_sql("policy_latency_ms", "k / 100.0", A.LATENCY_BOUNDS, "a", {"policy_id": "'default'", "application": "application"}),
    _hist_sql("model_latency_ms", "CASE WHEN stage = 'output' THEN k * 40.0 END", A.MODEL_BOUNDS, "a", {"provider": "provider", "application": "application"})))))
def _mhist(spark, sf):
    """All five families; answers take a model time that follows from the event."""
    model = F.when(F.col("stage") == "output", F.substring("prompt", 15, 9).cast("int") * 40.0)
    return A.metric_histograms(audit(spark, sf), model).withColumn("sum", F.round("sum", 4))


# --- fleet and versions -----------------------------------------------------------------------

_REPORTS_SQL = ("rep AS (SELECT CASE WHEN k % 20 = 0 THEN 'register' ELSE 'heartbeat' END AS kind, instance_id, timestamp_ms AS ts_ms, event_id AS seq, CASE WHEN k % 3 = 0 THEN application END AS application, "
                "CASE WHEN k % 4 = 0 THEN environment ELSE '' END AS environment, CASE WHEN k % 5 = 0 THEN '1.' || k END AS sdk_version, policy_version, k % 7 = 0 AS mo, k FROM a), "
                "reg AS (SELECT instance_id, max(CASE WHEN kind = 'register' THEN ts_ms END) AS reg_at, min(ts_ms) AS first_seen_ms, max(ts_ms) AS last_seen_ms FROM rep GROUP BY 1), "
                "inst AS (SELECT r.instance_id, coalesce(arg_max(application, ts_ms) FILTER (WHERE application IS NOT NULL), 'unknown') AS application, coalesce(arg_max(environment, ts_ms) FILTER (WHERE environment <> ''), 'unknown') AS environment, "
                "arg_max(sdk_version, ts_ms) FILTER (WHERE sdk_version IS NOT NULL) AS sdk_version, arg_max(mo, ts_ms) AS monitor_only, arg_max(policy_version, ts_ms) AS policy_version, any_value(first_seen_ms) AS first_seen_ms, any_value(last_seen_ms) AS last_seen_ms "
                "FROM rep r JOIN reg USING (instance_id) WHERE reg_at IS NULL OR ts_ms >= reg_at GROUP BY 1)")


def _instances(spark, sf):
    e = audit(spark, sf).withColumn("k", F.substring("prompt", 15, 9).cast("int"))
    some = lambda n, c: F.when(F.col("k") % n == 0, c)
    reports = e.select(
        F.when(F.col("k") % 20 == 0, "register").otherwise("heartbeat").alias("kind"), "instance_id", F.col("timestamp_ms").alias("ts_ms"), F.col("event_id").alias("seq"),
        some(3, F.col("application")).alias("application"), F.coalesce(some(4, F.col("environment")), F.lit("")).alias("environment"),
        some(5, F.concat(F.lit("1."), "k")).alias("sdk_version"), F.lit("python").alias("language"), F.lit("default").alias("policy_id"),
        F.col("policy_version"), some(6, F.array(F.lit("secrets"), F.lit("pii"))).alias("detectors"), (F.col("k") % 7 == 0).alias("monitor_only"))
    return A.upsert_instances(reports)


@query("upsert_instances", audit_sql("SELECT instance_id, application, environment, sdk_version, monitor_only, first_seen_ms, last_seen_ms FROM inst", _REPORTS_SQL))
def _upsert(spark, sf):
    return _instances(spark, sf).select("instance_id", "application", "environment", "sdk_version", "monitor_only", "first_seen_ms", "last_seen_ms")


def _fleet(spark, sf):
    now = audit(spark, sf).agg(F.max("timestamp_ms").alias("_now"))
    i = with_scalars(_instances(spark, sf), now, "_now")
    return A.fleet_status(i, F.col("_now"), 600).drop("_now")


_STATUS = "CASE WHEN last_seen_ms >= (SELECT max(timestamp_ms) FROM a) - 600000 THEN 'healthy' ELSE 'stale' END"


@query("fleet_status", audit_sql(f"SELECT instance_id, {_STATUS} AS status FROM inst", _REPORTS_SQL))
def _status(spark, sf):
    return _fleet(spark, sf).select("instance_id", "status")


@query("fleet_summary", audit_sql(
    f"SELECT facet, key, count(*) AS instances FROM (SELECT 'total' AS facet, 'all' AS key FROM inst UNION ALL SELECT 'status', {_STATUS} FROM inst UNION ALL SELECT 'sdk_version', coalesce(sdk_version, 'unknown') FROM inst "
    "UNION ALL SELECT 'policy_version', 'default@' || policy_version FROM inst UNION ALL SELECT 'monitor_only', instance_id FROM inst WHERE monitor_only) GROUP BY ALL", _REPORTS_SQL))
def _fsummary(spark, sf):
    return A.fleet_summary(_fleet(spark, sf))


@query("decisions_by_policy_version", audit_sql(
    "SELECT policy_version, decisions, blocked, CASE WHEN policy_version = 'default@1.0' THEN true WHEN policy_version LIKE 'default@%' THEN false END AS altered, "
    "CASE WHEN policy_version = 'default@1.1' THEN true WHEN policy_version LIKE 'default@%' THEN false END AS current FROM (SELECT policy_version, count(*) AS decisions, count(*) FILTER (WHERE action IN ('block', 'challenge')) AS blocked FROM a GROUP BY 1)"))
def _versions(spark, sf):
    """History: version 1.0 was published twice with different content; 1.2 was never published."""
    v = audit(spark, sf).groupBy("policy_version").agg(F.min("timestamp_ms").alias("t"))
    h = v.select(F.lit("default").alias("bundle"), F.substring_index("policy_version", "@", -1).alias("version"), "t")
    etags = F.when(F.col("version") == "1.0", F.array(F.lit("e0"), F.lit("e0b"))).otherwise(F.array(F.concat(F.lit("e"), "version")))
    hist = h.select("bundle", "version", F.explode(etags).alias("etag"), (F.col("version") != "1.2").alias("published"), F.when(F.col("version") == "1.1", 2).otherwise(1).cast("bigint").alias("created_ms"))
    return A.decisions_by_policy_version(audit(spark, sf), hist).select("policy_version", "decisions", "blocked", "altered", "current")


@query("align_schema", audit_sql("SELECT CASE WHEN timestamp_ms < 1705276800000 THEN 'none' ELSE risk_band END AS band, count(*) AS events, count(CASE WHEN timestamp_ms >= 1705276800000 THEN risk_score END) AS scored FROM a GROUP BY 1"))
def _align(spark, sf):
    """Events from before risk was recorded, read together with newer ones."""
    e = audit(spark, sf).select("event_id", "timestamp_ms", "risk_score", "risk_band")
    old = e.filter(F.col("timestamp_ms") < _CUT).select("event_id", "timestamp_ms")
    both = L.align_schema(old, e.filter(F.col("timestamp_ms") >= _CUT))
    return both.groupBy(F.coalesce("risk_band", F.lit("none")).alias("band")).agg(F.count("*").alias("events"), F.count("risk_score").alias("scored"))


# --- anomalies -----------------------------------------------------------------------------------

_INJ_ROWS = "r AS (SELECT coalesce(principal_id, 'anonymous') AS p, application, correlation_id FROM a WHERE action IN ('block', 'challenge') AND category IN ('prompt_injection', 'authority_manipulation'))"


@query("repeated_injection", audit_sql(
    "SELECT 'repeated_injection:' || p || ':' || application AS dedupe_key, CASE WHEN count(*) >= 10 THEN 'high' ELSE 'medium' END AS severity, round(least(1.0, count(*) / 15), 4) AS score, count(*) || ' blocked injection attempts from ' || p AS title FROM r GROUP BY p, application HAVING count(*) >= 5", _INJ_ROWS))
def _repeated(spark, sf):
    return AN.repeated_injection(audit(spark, sf)).select("dedupe_key", "severity", F.round("score", 4).alias("score"), "title")


@query("cross_application_probe", audit_sql(
    "SELECT 'cross_application_probe:d' || k AS dedupe_key, round(least(1.0, count(DISTINCT application) / 4), 4) AS score, string_agg(DISTINCT application, ',' ORDER BY application) AS applications, CAST(count(*) AS VARCHAR) AS total, CAST(count(*) FILTER (WHERE action IN ('block', 'challenge', 'flag')) AS VARCHAR) AS flagged "
    "FROM a GROUP BY k HAVING count(DISTINCT application) >= 2 AND count(*) FILTER (WHERE action IN ('block', 'challenge', 'flag')) > 0"))
def _probe(spark, sf):
    ev = F.col("evidence")
    return AN.cross_application_probe(audit(spark, sf)).select("dedupe_key", F.round("score", 4).alias("score"), ev["applications"].alias("applications"), ev["total"].alias("total"), ev["flagged"].alias("flagged"))


_HOURS = ("hc AS (SELECT timestamp_ms // 3600000 AS b, application, count(*) AS n FROM a GROUP BY ALL), hb AS (SELECT DISTINCT b FROM hc), grid AS (SELECT hb.b, ap.application, coalesce(hc.n, 0) AS n FROM hb CROSS JOIN (SELECT DISTINCT application FROM a) ap "
          "LEFT JOIN hc ON hc.b = hb.b AND hc.application = ap.application), bl AS (SELECT application, max(n) FILTER (WHERE b = (SELECT max(b) FROM hb)) AS current, avg(n) FILTER (WHERE b < (SELECT max(b) FROM hb)) AS mean, stddev_pop(n) FILTER (WHERE b < (SELECT max(b) FROM hb)) AS stdev FROM grid GROUP BY 1)")


@query("volume_baseline", audit_sql("SELECT application, current, round(mean, 6) AS mean, round(stdev, 6) AS stdev FROM bl", _HOURS))
def _baseline(spark, sf):
    """Baselines over hourly counters."""
    c = audit(spark, sf).groupBy(F.expr("timestamp_ms div 3600000").alias("bucket_ms"), "application").agg(F.count("*").alias("count"))
    return AN.volume_baseline(c).select("application", "current", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"))


_SPIKE = ("m0 AS (SELECT timestamp_ms // 60000 AS b, application, count(*) AS n0 FROM a GROUP BY ALL), mc AS (SELECT b, application, CASE WHEN b = (SELECT max(b) FROM m0) THEN 30 * n0 ELSE n0 END AS n FROM m0), mb AS (SELECT DISTINCT b FROM mc), "
          "mg AS (SELECT mb.b, ap.application, coalesce(mc.n, 0) AS n FROM mb CROSS JOIN (SELECT DISTINCT application FROM a) ap LEFT JOIN mc ON mc.b = mb.b AND mc.application = ap.application), "
          "ms AS (SELECT application, max(n) FILTER (WHERE b = (SELECT max(b) FROM mb)) AS cur, avg(n) FILTER (WHERE b < (SELECT max(b) FROM mb)) AS mean, stddev_pop(n) FILTER (WHERE b < (SELECT max(b) FROM mb)) AS sd FROM mg GROUP BY 1)")


@query("volume_spike", audit_sql(
    "SELECT 'volume_spike:' || application AS dedupe_key, round(least(1.0, (cur - mean) / sd / 10), 4) AS score, CAST(cur AS VARCHAR) AS current FROM ms WHERE cur > 0 AND (cur - mean) / sd >= 3", _SPIKE))
def _spike(spark, sf):
    """Minute counters with the newest minute amplified thirtyfold."""
    c = A.minute_counters(audit(spark, sf))
    last = c.agg(F.max("bucket_ms").alias("_last"))
    loud = with_scalars(c, last, "_last").withColumn("count", F.when(F.col("bucket_ms") == F.col("_last"), F.col("count") * 30).otherwise(F.col("count")))
    return AN.volume_spike(loud).select("dedupe_key", F.round("score", 4).alias("score"), F.col("evidence")["current"].alias("current"))


_SURF = ("s AS (SELECT *, concat(application, '-', k) AS app FROM a), o AS (SELECT *, row_number() OVER (ORDER BY timestamp_ms, event_id) AS rn, count(*) OVER () AS n FROM s), h AS (SELECT *, rn > n // 2 AS late FROM o)")


@query("new_attack_surface", audit_sql(
    "SELECT 'new_attack_surface:' || app AS dedupe_key, CAST(count(*) FILTER (WHERE late AND action IN ('block', 'challenge')) AS VARCHAR) AS blocks FROM h GROUP BY app HAVING count(*) FILTER (WHERE NOT late) > 0 "
    "AND count(*) FILTER (WHERE NOT late AND action IN ('block', 'challenge')) = 0 AND count(*) FILTER (WHERE late AND action IN ('block', 'challenge')) > 0", _SURF))
def _surface(spark, sf):
    """Applications split finely so that some start blocking only in the later half."""
    e = audit(spark, sf).withColumn("application", F.concat_ws("-", "application", F.substring("prompt", 15, 9)))
    return AN.new_attack_surface(e).select("dedupe_key", F.col("evidence")["blocks"].alias("blocks"))


@query("coverage_gap", audit_sql(
    f"SELECT 'coverage_gap:' || application || ':' || i.instance_id AS dedupe_key, CASE WHEN d.has THEN 'prompt_injection' ELSE 'pii,prompt_injection,secrets' END AS missing, monitor_only FROM inst i JOIN (SELECT r.instance_id, bool_or(k % 6 = 0) AS has FROM rep r JOIN reg USING (instance_id) WHERE reg_at IS NULL OR ts_ms >= reg_at GROUP BY 1) d USING (instance_id) "
    f"WHERE environment = 'production' AND {_STATUS} = 'healthy'", _REPORTS_SQL))
def _gap(spark, sf):
    ev = F.col("evidence")
    return AN.coverage_gap(_fleet(spark, sf)).select("dedupe_key", ev["missing_detectors"].alias("missing"), (ev["monitor_only"] == "true").alias("monitor_only"))


def _all_anomalies(spark, sf):
    e = audit(spark, sf)
    return AN.analyse_anomalies(e, A.minute_counters(e), _fleet(spark, sf))


_QUIET = _SPIKE.replace("CASE WHEN b = (SELECT max(b) FROM m0) THEN 30 * n0 ELSE n0 END", "n0")
_SAME_APP = _SURF.replace("concat(application, '-', k)", "application")
_ANOM = (
    _INJ_ROWS, _QUIET, _SAME_APP, _REPORTS_SQL,
    "an AS (SELECT 'repeated_injection' AS kind, CASE WHEN count(*) >= 10 THEN 'high' ELSE 'medium' END AS severity FROM r GROUP BY p, application HAVING count(*) >= 5 "
    "UNION ALL SELECT 'cross_application_probe', 'high' FROM a GROUP BY k HAVING count(DISTINCT application) >= 2 AND count(*) FILTER (WHERE action IN ('block', 'challenge', 'flag')) > 0 "
    "UNION ALL SELECT 'volume_spike', 'medium' FROM ms WHERE cur > 0 AND (cur - mean) / sd >= 3 "
    "UNION ALL SELECT 'new_attack_surface', 'medium' FROM h GROUP BY app HAVING count(*) FILTER (WHERE NOT late) > 0 "
    "AND count(*) FILTER (WHERE NOT late AND action IN ('block', 'challenge')) = 0 AND count(*) FILTER (WHERE late AND action IN ('block', 'challenge')) > 0 "
    f"UNION ALL SELECT 'coverage_gap', 'high' FROM inst WHERE environment = 'production' AND {_STATUS} = 'healthy')",
)


@query("analyse_anomalies", audit_sql("SELECT kind, severity, count(*) AS n FROM an GROUP BY ALL", *_ANOM))
def _anomalies(spark, sf):
    """All five kinds together."""
    return _all_anomalies(spark, sf).groupBy("kind", "severity").agg(F.count("*").alias("n"))


# --- alerts ------------------------------------------------------------------------------------------

_MATCH = ("mt AS (SELECT 'rule_credential_leak' AS rule_id, * FROM a WHERE action = 'block' AND detector IN ('secrets', 'secret_leakage') UNION ALL "
          "SELECT 'rule_indirect_injection', * FROM a WHERE category = 'prompt_injection' AND stage IN ('retrieval', 'tool_result', 'memory_write') UNION ALL "
          "SELECT 'rule_unsafe_tool_flow', * FROM a WHERE action = 'block' AND category IN ('unsafe_flow', 'excessive_agency', 'memory_provenance_laundering'))")


@query("match_alerts", audit_sql(
    "SELECT rule_id, arg_min(event_id, timestamp_ms) AS event_id, min(timestamp_ms) AS timestamp_ms, arg_min(action || ' at ' || stage || ' in ' || application, timestamp_ms) AS description FROM mt GROUP BY 1", _MATCH))
def _match(spark, sf):
    return AL.match_alerts(audit(spark, sf)).select("rule_id", "event_id", "timestamp_ms", "description")


_THRESHOLDS = (
    AL.AlertRule("burst", "Blocks by principal", "threshold", {"window_s": 7 * 86400, "count": 3, "group_by": "principal_id", "filter": {"action": ["block", "challenge"]}}),
    AL.AlertRule("total", "Blocks", "threshold", {"window_s": 7 * 86400, "count": 10, "filter": {"action": "block", "min_severity": "high"}}),
    AL.AlertRule("never", "Never", "threshold", {"window_s": 60, "count": 10**9}),
)


@query("threshold_alerts", audit_sql(
    "SELECT 'burst' AS rule_id, min(p) AS group_key, max(n) AS count FROM (SELECT *, max(n) OVER () AS top FROM (SELECT principal_id AS p, count(*) AS n FROM a WHERE action IN ('block', 'challenge') AND timestamp_ms >= (SELECT max(timestamp_ms) FROM a) - 604800000 GROUP BY 1 HAVING count(*) >= 3)) WHERE n = top "
    "UNION ALL SELECT 'total', NULL, count(*) FROM a WHERE action = 'block' AND timestamp_ms >= (SELECT max(timestamp_ms) FROM a) - 604800000 HAVING count(*) >= 10"))
def _threshold(spark, sf):
    e = audit(spark, sf)
    now = e.agg(F.max("timestamp_ms").alias("_now"))
    return AL.threshold_alerts(with_scalars(e, now, "_now"), _THRESHOLDS, F.col("_now")).select("rule_id", "group_key", "count")


@query("anomaly_alerts", audit_sql("SELECT 'rule_anomalies' AS rule_id, kind, count(*) AS n FROM an WHERE severity = 'high' GROUP BY ALL", *_ANOM))
def _aalerts(spark, sf):
    return AL.anomaly_alerts(_all_anomalies(spark, sf)).groupBy("rule_id", "kind").agg(F.count("*").alias("n"))


_COOL = "CASE rule_id WHEN 'rule_indirect_injection' THEN 600000 ELSE 300000 END"


@query("suppress_cooldown", audit_sql(
    "SELECT rule_id, t AS timestamp_ms FROM fires", _MATCH,
    "fires AS (SELECT rule_id, min(timestamp_ms) AS t FROM mt GROUP BY 1 UNION ALL "
    f"SELECT rule_id, n FROM (SELECT f.rule_id, (SELECT min(m.timestamp_ms) FROM mt m WHERE m.rule_id = f.rule_id AND m.timestamp_ms >= f.t + {_COOL.replace('rule_id', 'f.rule_id')}) AS n FROM fires f) WHERE n IS NOT NULL)").replace("WITH ", "WITH RECURSIVE ", 1))
def _cooldown(spark, sf):
    """Every match of the default rules, thinned to those that would really fire."""
    hits = AL.rule_hits(audit(spark, sf), AL.DEFAULT_RULES).select("rule_id", "cooldown_s", "event_id", "timestamp_ms")
    return AL.suppress_cooldown(hits).select("rule_id", "timestamp_ms")


@query("alert_list", audit_sql(
    "SELECT event_id AS alert_id, timestamp_ms AS created_ms, acknowledged_ms, acknowledged_by FROM mt LEFT JOIN (SELECT event_id AS eid, timestamp_ms + 1000 AS acknowledged_ms, 'op0' AS acknowledged_by FROM a WHERE k % 2 = 0) k ON k.eid = mt.event_id "
    "WHERE acknowledged_ms IS NULL", _MATCH))
def _alerts(spark, sf):
    """Unacknowledged alerts; some were acknowledged twice and the first counts."""
    e = audit(spark, sf)
    hits = AL.rule_hits(e, AL.DEFAULT_RULES)
    alerts = hits.select(F.col("event_id").alias("alert_id"), F.col("timestamp_ms").alias("created_ms"))
    done = e.filter(F.substring("prompt", 15, 9).cast("int") % 2 == 0)
    acks = done.select(F.col("event_id").alias("alert_id"), F.explode(F.array(*[
        F.struct((F.col("timestamp_ms") + (i + 1) * 1000).alias("acknowledged_ms"), F.lit(f"op{i}").alias("acknowledged_by")) for i in range(2)])).alias("x")).select("alert_id", "x.*")
    return AL.alert_list(alerts, acks, unacknowledged_only=True, limit=None)
