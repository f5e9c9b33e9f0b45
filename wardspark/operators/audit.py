"""Questions over normalised audit events.

Every one is an aggregate, a filter or a top-k; nested findings are exploded only where a
question is about them. No row caps: whole tables are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.functions.ranks import ACTIONS, SEVERITIES, action_rank
from wardspark.operators.policy import Policy, apply_policy, policy_facts
from wardspark.operators.scan import settle
from wardspark.operators.taxonomy import BY_ID, coverage_report

BLOCKED = ("block", "challenge")
_EQUALS = ("application", "environment", "action", "severity", "stage", "principal_id", "tenant", "correlation_id",
           "trace_id", "model", "risk_band")


def is_blocked(action: Column | None = None) -> Column:
    return (F.col("action") if action is None else action).isin(*BLOCKED)


def since(events: DataFrame, since_ms: int | None) -> DataFrame:
    return events if since_ms is None else events.filter(F.col("timestamp_ms") >= since_ms)


def search_events(events: DataFrame, *, since_ms: int | None = None, until_ms: int | None = None,
                  min_severity: str | None = None, detector: str | None = None, category: str | None = None,
                  search: str | None = None, threat: str | None = None, min_risk: int | None = None,
                  **equals: Any) -> DataFrame:
    """Filter the audit log; every filter is optional and ``None`` means absent."""
    unknown = set(equals) - set(_EQUALS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    out = since(events, since_ms)
    if until_ms is not None:
        out = out.filter(F.col("timestamp_ms") <= until_ms)
    for name, value in equals.items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    if min_severity is not None:
        at = SEVERITIES.index(min_severity) if min_severity in SEVERITIES else 0
        out = out.filter(F.col("severity").isin(*SEVERITIES[at:]))
    if detector is not None:
        out = out.filter(F.exists("detectors_fired", lambda d: F.lower(d) == detector.lower()))
    if category is not None:
        out = out.filter(F.exists("categories", lambda c: F.lower(c) == category.lower()))
    if search is not None:
        out = out.filter(F.contains(F.col("search_text"), F.lit(search.lower())))
    if threat is not None:
        out = out.filter(F.exists("threats", lambda t: F.upper(t) == threat.upper()))
    if min_risk is not None:
        out = out.filter(F.col("risk_score") >= min_risk)
    return out


def page(events: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page, newest first. Totals are a separate ``count``."""
    return events.orderBy(F.desc("timestamp_ms"), F.desc("event_id")).offset(offset).limit(limit)


def get_event(events: DataFrame, event_id: str) -> DataFrame:
    return events.filter(F.col("event_id") == event_id)


def correlation_timeline(events: DataFrame, correlation_id: str) -> DataFrame:
    return events.filter(F.col("correlation_id") == correlation_id).orderBy("timestamp_ms", "event_id")


def correlation_stages(events: DataFrame, most: int = 64, slice_ms: int = 60_000) -> DataFrame:
    """(correlation_id, part, stages): each request's stages in order of time and id, at most ``most`` a part.

    An event's place is the number of events in earlier slices of its request plus its place in its own
    slice, so a request that holds a third of the log is numbered slice by slice in many tasks.
    """
    at = F.expr(f"timestamp_ms div {int(slice_ms)}").alias("_slice")
    rows = events.filter(F.col("correlation_id").isNotNull()).select("correlation_id", at, "timestamp_ms", "event_id", "stage")
    before = Window.partitionBy("correlation_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("correlation_id", "_slice").agg(F.count("*").alias("_n")).select(
        "correlation_id", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    own = Window.partitionBy("correlation_id", "_slice").orderBy("timestamp_ms", "event_id", "stage")
    placed = rows.withColumn("_own", F.row_number().over(own)).join(base, ["correlation_id", "_slice"])
    place = F.col("_base") + F.col("_own") - 1
    return placed.groupBy("correlation_id", (F.floor(place / most) + 1).cast("int").alias("part")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(place.alias("at"), "stage"))), lambda x: x["stage"]).alias("stages")
    )


def correlation_summary(events: DataFrame, most: int = 64) -> DataFrame:
    """Each request's start, end, ordered stages, worst action and detectors.

    A request of more than ``most`` events has several rows, numbered by ``part``, which differ in
    ``stages`` only; no row grows with the request. Events without a correlation id form one row without stages.
    """
    at = F.struct("timestamp_ms", "event_id")
    plain = events.groupBy("correlation_id").agg(
        *[F.min_by(c, at).alias(c) for c in ("application", "principal_id", "session_id", "model", "trace_id", "policy_version")],
        F.min("timestamp_ms").alias("started_ms"), F.max("timestamp_ms").alias("ended_ms"),
        F.count("*").alias("events"),
        F.max(F.struct(action_rank(F.col("action")).alias("r"), "action")).alias("_worst"),
    )
    fired = events.select("correlation_id", F.explode("detectors_fired").alias("_d")).groupBy("correlation_id").agg(
        F.sort_array(F.collect_set("_d")).alias("detectors_fired")
    )
    return (
        plain.join(fired, "correlation_id", "left").join(correlation_stages(events, most), "correlation_id", "left")
        .withColumns({
            "part": F.coalesce("part", F.lit(1)),
            "duration_ms": F.col("ended_ms") - F.col("started_ms"),
            "outcome": F.col("_worst.action"),
            "detectors_fired": F.coalesce("detectors_fired", F.array().cast("array<string>")),
        }).drop("_worst")
    )


def session_activity(events: DataFrame, gap: str = "30 minutes", idle: str | None = None, at: str = "timestamp_ms") -> DataFrame:
    """(session, start_ms, end_ms, events, blocked): activity of each session.

    A known session id is one session however long its pauses are (on a stream, until it was silent for
    ``idle``, after which its state goes). Events without one are split by principal wherever ``gap`` passes
    without an event. ``end_ms`` is the last event's time.
    """
    known = F.coalesce("session_id", F.lit("")) != ""
    session = F.when(known, F.col("session_id")).otherwise(F.concat(F.lit("gap:"), F.coalesce("principal_id", F.lit("anonymous"))))
    figures = [F.min(at).alias("start_ms"), F.max(at).alias("end_ms"), F.count("*").alias("events"), F.count_if(is_blocked()).alias("blocked")]
    if idle is not None:  # a stream: one window whose gap depends on the row
        w = F.session_window("ts", F.when(known, idle).otherwise(gap))
        return events.groupBy(w, session.alias("session"), known.alias("known")).agg(*figures).drop("session_window")
    rows = events.withColumn("ts", F.timestamp_millis(at))
    by_id = rows.filter(known).groupBy(session.alias("session"), F.lit(True).alias("known")).agg(*figures)
    by_gap = rows.filter(~known).groupBy(F.session_window("ts", gap), session.alias("session"), F.lit(False).alias("known")).agg(*figures)
    return by_id.unionByName(by_gap.drop("session_window"))


def overview(events: DataFrame, instances: DataFrame | None = None, since_ms: int | None = None, top: int | None = None) -> DataFrame:
    """(facet, key, events) rows: totals, by action, by severity, by application (the ``top`` busiest, if given), and measures in ``value``.

    One scan and one shuffle: the facets are grouping sets over the same rows, and the measures unfold from the row of totals.
    """
    rows = since(events, since_ms)
    sets = rows.groupingSets(
        [[F.col("action")], [F.col("severity")], [F.col("application")], []], F.col("action"), F.col("severity"), F.col("application")
    ).agg(
        F.count("*").alias("events"), F.count_if(is_blocked()).alias("_b"), F.avg("latency_ms").alias("_avg"),
        F.max("latency_ms").alias("_max"), F.grouping_id().alias("_g"),
    )
    tag = F.when(F.col("_g") == 3, "action").when(F.col("_g") == 5, "severity").when(F.col("_g") == 6, "application").otherwise("total")
    sets = sets.select(tag.alias("facet"), F.coalesce("action", "severity", "application", F.lit("all")).alias("key"),
                       "events", "_b", "_avg", "_max")
    if top is not None:  # one row per action, severity and application: the ranked filter works on grouped rows only
        place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("events"), "key"))
        sets = sets.withColumn("_place", place).filter((F.col("facet") != "application") | (F.col("_place") <= top))

    def row(facet: Column, key: Column, value: Column) -> Column:
        return F.struct(facet.alias("facet"), key.alias("key"), F.col("events").alias("events"), value.cast("double").alias("value"))

    own = row(F.col("facet"), F.col("key"), F.lit(None))
    measures = [row(F.lit("measure"), F.lit(name), value) for name, value in (
        ("blocked", F.col("_b")), ("block_rate", F.round(F.col("_b") / F.col("events"), 4)),
        ("avg_latency_ms", F.round("_avg", 2)), ("max_latency_ms", F.round("_max", 2)))]
    out = sets.select(F.inline(F.when(F.col("facet") == "total", F.array(own, *measures)).otherwise(F.array(own))))
    if instances is not None:
        live = instances if since_ms is None else instances.filter(F.col("last_seen_ms") >= since_ms)
        n = live.agg(F.count("*").alias("events"))
        out = out.unionByName(n.select(F.lit("measure").alias("facet"), F.lit("active_instances").alias("key"), "events",
                                       F.col("events").cast("double").alias("value")))
    return out


def minute_counters(events: DataFrame, keys: Sequence[str] = ("application", "action")) -> DataFrame:
    bucket = F.expr("timestamp_ms div 60000 * 60000").alias("bucket_ms")
    return events.groupBy(bucket, *keys).agg(F.count("*").alias("count"))


def timeline(counters: DataFrame, bucket_minutes: int = 1, application: str | None = None) -> DataFrame:
    """Counters re-bucketed, one column per action, plus the total."""
    rows = counters if application is None else counters.filter(F.col("application") == application)
    width = bucket_minutes * 60_000
    bucket = F.expr(f"bucket_ms div {width} * {width}").alias("bucket_ms")
    per = [F.coalesce(F.sum(F.when(F.col("action") == a, F.col("count"))), F.lit(0)).alias(a) for a in ACTIONS]
    return rows.groupBy(bucket).agg(F.sum("count").alias("total"), *per)


def detector_stats(events: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Runs, hits, errors, latency, categories and severities of each detector."""
    f = since(events, since_ms).select(F.explode("findings").alias("f")).select("f.*")
    hit = F.col("detected")
    err = F.coalesce(F.col("error"), F.lit("")) != ""
    sev = [F.count_if(hit & (F.col("severity") == s)).alias(f"hits_{s}") for s in SEVERITIES]
    return f.groupBy("detector").agg(
        F.count("*").alias("runs"), F.count_if(hit).alias("hits"),
        F.round(F.count_if(hit) / F.count("*"), 4).alias("hit_rate"), F.count_if(err).alias("errors"),
        F.round(F.sum(F.coalesce("elapsed_ms", F.lit(0.0))) / F.count("*"), 3).alias("avg_latency_ms"),
        F.sort_array(F.collect_set(F.when(hit, F.col("category")))).alias("categories"), *sev,
    )


def band_counts(events: DataFrame, since_ms: int | None = None) -> DataFrame:
    return since(events, since_ms).groupBy(F.coalesce("risk_band", F.lit("none")).alias("band")).agg(F.count("*").alias("events"))


def threat_stats(events: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Events and blocks of each threat, scored events only."""
    rows = since(events, since_ms).filter(F.col("risk_score") > 0)
    return rows.select("action", F.explode("threats").alias("threat")).groupBy("threat").agg(
        F.count("*").alias("events"), F.count_if(is_blocked()).alias("blocked")
    )


def riskiest_events(events: DataFrame, k: int = 15, since_ms: int | None = None) -> DataFrame:
    rows = since(events, since_ms).filter(F.col("risk_score") > 0)
    return rows.orderBy(F.desc("risk_score"), F.desc("timestamp_ms"), "event_id").limit(k).select(
        "event_id", "correlation_id", "timestamp_ms", "application", "stage", "action", "risk_score", "risk_band",
        "risk_likelihood", "risk_impact", "threats", "principal_id",
    )


def policy_stats(events: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Matches, mean evaluation time and actions of each rule."""
    t = since(events, since_ms).select(F.explode("policy_traces").alias("t")).select("t.*").filter("matched")
    per = [F.count_if(F.col("action") == a).alias(f"action_{a}") for a in ACTIONS]
    return t.groupBy("policy_id", "rule_id").agg(
        F.count("*").alias("matches"), F.round(F.sum(F.coalesce("elapsed_ms", F.lit(0.0))) / F.count("*"), 4).alias("avg_eval_ms"), *per
    )


def top_offenders(events: DataFrame, k: int = 10, since_ms: int | None = None) -> DataFrame:
    rows = since(events, since_ms).filter(is_blocked())
    return (
        rows.groupBy("principal_id", "application").agg(F.count("*").alias("blocked_events"))
        .orderBy(F.desc("blocked_events"), "principal_id", "application").limit(k)
    )


def recent_for_anomaly(events: DataFrame, since_ms: int | None = None, limit: int | None = None) -> DataFrame:
    """The light projection anomaly detection reads; ``limit`` is the caller's choice of newest rows."""
    out = since(events, since_ms).select(
        "event_id", "timestamp_ms", "application", "principal_id", "action", "severity", "categories", "detectors_fired",
        "tags", "correlation_id",
    )
    return out if limit is None else out.orderBy(F.desc("timestamp_ms"), F.desc("event_id")).limit(limit)


def threat_hits(events: DataFrame, since_ms: int | None = None, enabled: Sequence[str] | None = None) -> DataFrame:
    """The catalogue with each threat's event count."""
    return coverage_report(events.sparkSession, enabled, threat_stats(events, since_ms))


def attack_rate_by(events: DataFrame, *dims: str, how: str = "rollup") -> DataFrame:
    """Block rate and mean risk over a rollup or cube of dimensions; null marks a total."""
    grouped = getattr(events, how)(*[F.col(d) for d in dims])
    return grouped.agg(
        F.count("*").alias("events"), F.count_if(is_blocked()).alias("blocked"),
        F.round(F.count_if(is_blocked()) / F.count("*"), 4).alias("block_rate"), F.round(F.avg("risk_score"), 4).alias("avg_risk"),
    )


def latency_quantiles(events: DataFrame, *dims: str, exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """p50 and p95 latency; the sketch by default, the exact percentile on request."""
    q = (lambda p: F.percentile("latency_ms", F.lit(p))) if exact else (lambda p: F.percentile_approx("latency_ms", p, accuracy))
    return events.groupBy(*dims).agg(q(0.5).alias("p50_ms"), q(0.95).alias("p95_ms"), F.count("*").alias("events"))


# --- metric families ----------------------------------------------------------------


def bounded(col: Column, allowed: Sequence[str], fallback: str = "other") -> Column:
    """A label value, or ``fallback`` when outside its known set."""
    return F.when(col.isin(*allowed), col).otherwise(fallback)


def metric_counters(events: DataFrame, applications: Sequence[str] | None = None) -> DataFrame:
    """(metric, labels, value): the counter families over audit events.

    Each event is turned into its samples in place and one aggregate counts them all; the
    label sets are closed, so the result is small.
    """
    app = F.col("application") if applications is None else bounded(F.col("application"), applications)

    def sample(metric: str, **labels: Column) -> Column:
        named = [F.concat(F.lit(k + "="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in sorted({**labels, "application": app}.items())]
        return F.struct(F.lit(metric).alias("metric"), F.concat_ws(",", *named).alias("labels"))

    def per(array: str, build, keep=None) -> Column:
        source = F.col(array) if keep is None else F.filter(array, keep)
        return F.transform(source, build)

    stage, action = F.col("stage"), F.col("action")
    frameworks = {name: sorted(i for i, t in BY_ID.items() if t.framework == name) for name in dict.fromkeys(t.framework for t in BY_ID.values())}
    framework = lambda t: F.coalesce(*[F.when(t.isin(*ids), name) for name, ids in frameworks.items()], F.lit("other"))
    none = F.array().cast("array<struct<metric:string,labels:string>>")
    outcome = lambda f: F.when(F.coalesce(f["error"], F.lit("")) != "", "error").when(f["detected"], "detected").otherwise("clean")
    ranked = F.transform(
        F.filter("findings", lambda f: f["detected"]),
        lambda f, i: F.struct((-action_rank(f["action"])).alias("a"), (-f["score"]).alias("s"), i.alias("i"), f["category"].alias("c")),
    )
    reason = F.coalesce(F.array_min(ranked)["c"], F.lit("policy"))
    samples = F.concat(
        F.array(sample("requests_total", stage=stage, action=action)),
        F.array(sample("telemetry_events_total", outcome=F.lit("emitted"))),
        per("findings", lambda f: sample("detector_runs_total", detector=f["detector"], stage=stage, outcome=outcome(f))),
        per("findings", lambda f: sample("detector_hits_total", detector=f["detector"], severity=f["severity"], action=f["action"]),
            lambda f: f["detected"]),
        per("findings", lambda f: sample("detector_errors_total", detector=f["detector"],
                                         fail_mode=F.when(f["detected"], "closed").otherwise("open")),
            lambda f: F.coalesce(f["error"], F.lit("")) != ""),
        per("policy_traces", lambda t: sample("policy_evaluations_total", policy_id=t["policy_id"], action=t["action"])),
        F.flatten(per("findings", lambda f: F.transform(f["threats"], lambda t: sample("threat_detections_total", threat=t, framework=framework(t), stage=stage, action=action)),
                      lambda f: f["detected"])),
        F.when(F.col("risk_score") > 0, F.array(sample("risk_decisions_total", band=F.col("risk_band"), stage=stage))).otherwise(none),
        F.when(action == "block", F.array(sample("blocked_total", stage=stage, category=reason))).otherwise(none),
        F.when(stage == "access", F.array(sample("access_denied_total", reason=F.coalesce(F.col("tags")["reason"], F.lit("other"))))).otherwise(none),
        F.when(F.col("tags")["dropped"].isNotNull(), F.array(sample("telemetry_dropped_total", reason=F.col("tags")["dropped"]))).otherwise(none),
    )
    return events.select(F.explode(samples).alias("s")).select("s.*").groupBy("metric", "labels").agg(F.count("*").alias("value"))


# Histogram bounds.
LATENCY_BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500)
RISK_BOUNDS = (1, 2, 4, 6, 9, 12, 16, 20, 25)
MODEL_BOUNDS = (10, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000)


_LABELS = ("stage", "application", "detector", "policy_id", "provider")


def metric_histograms(events: DataFrame, model_latency: Column | None = None) -> DataFrame:
    """Cumulative buckets (``le``), sum and count of five measures: pipeline, detector, policy and model latency, and risk.

    Labels that a family does not have are null. ``model_latency`` is the upstream model's time in
    milliseconds, by default what the tag ``model_latency_ms`` states. Measures without a value are not
    counted. A policy's latency is the sum over its rules, one observation an event.

    One scan and one aggregate: an event unfolds into its observations, which are combined before the shuffle.
    """
    model = F.try_to_number(F.col("tags")["model_latency_ms"], F.lit("999999999.999999")) if model_latency is None else model_latency
    bounds = {"pipeline_latency_ms": LATENCY_BOUNDS, "detector_latency_ms": LATENCY_BOUNDS, "policy_latency_ms": LATENCY_BOUNDS,
              "model_latency_ms": MODEL_BOUNDS, "risk_score": RISK_BOUNDS}

    def seen(metric: str, value: Column, **labels: Column) -> Column:
        named = [labels.get(n, F.lit(None)).cast("string").alias(n) for n in _LABELS]
        return F.struct(F.lit(metric).alias("metric"), *named, value.cast("double").alias("value"))

    stage, app = F.col("stage"), F.col("application")
    policies = F.array_distinct(F.transform("policy_traces", lambda t: t["policy_id"]))
    spent = lambda p: F.aggregate(
        F.filter("policy_traces", lambda t: t["policy_id"].eqNullSafe(p) & t["elapsed_ms"].isNotNull()), F.lit(None).cast("double"),
        lambda total, t: F.coalesce(total, F.lit(0.0)) + t["elapsed_ms"])
    none = F.array().cast("array<struct<metric:string," + ",".join(f"{n}:string" for n in _LABELS) + ",value:double>>")
    observed = F.concat(
        F.array(seen("pipeline_latency_ms", F.col("latency_ms"), stage=stage, application=app),
                seen("risk_score", F.when(F.col("risk_score") > 0, F.col("risk_score")), stage=stage, application=app),
                seen("model_latency_ms", model, provider=F.col("provider"), application=app)),
        F.coalesce(F.transform("findings", lambda f: seen("detector_latency_ms", f["elapsed_ms"], detector=f["detector"], application=app)), none),
        F.coalesce(F.transform(policies, lambda p: seen("policy_latency_ms", spent(p), policy_id=p, application=app)), none),
    )
    rows = events.select(F.inline(F.filter(observed, lambda o: o["value"].isNotNull())))
    upper = lambda i: F.coalesce(*[F.when(F.col("metric") == m, float(b[i])) for m, b in bounds.items() if i < len(b)])
    grouped = rows.groupBy("metric", *_LABELS).agg(
        *[F.count_if(F.col("value") <= upper(i)).alias(f"_b{i}") for i in range(max(map(len, bounds.values())))],
        F.count("*").alias("count"), F.sum("value").alias("sum"),
    )
    cells = lambda b: F.array(*[F.struct(F.lit(str(x)).alias("le"), F.col(f"_b{i}").alias("bucket")) for i, x in enumerate(b)],
                              F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket")))
    return grouped.select("metric", *_LABELS, "sum", "count",
                          F.inline(F.coalesce(*[F.when(F.col("metric") == m, cells(b)) for m, b in bounds.items()])))


# --- replay -------------------------------------------------------------------------


def replayed(events: DataFrame, policy: Policy, full_facts: bool = False) -> DataFrame:
    """Events with ``new_action`` and ``rules`` under a candidate policy; narrow, every event.

    By default only what recorded events always carried feeds the rules. ``full_facts`` also
    offers threats and risk.
    """
    tags = F.col("tags")
    facts = policy_facts(
        F.col("findings"), stage=F.col("stage"), fired_only_score=False, environment=F.col("environment"),
        application=F.col("application"), model=F.col("model"), provider=F.col("provider"), tenant=F.col("tenant"),
        principal_id=F.col("principal_id"), roles=F.coalesce("principal_roles", F.array().cast("array<string>")),
        authenticated=F.coalesce(F.col("principal_id"), F.lit("")) != "", trust=F.coalesce(tags["trust"], F.lit("user")),
        tool=tags["tool"], tags=tags,
    )
    facts["severity"] = F.coalesce("severity", F.lit("info"))
    if full_facts:
        facts.update(threats=F.col("threats"), risk_score=F.col("risk_score"), risk_band=F.col("risk_band"))
    else:
        facts.update(threats=F.array().cast("array<string>"), risk_score=F.lit(0), risk_band=F.lit("none"))
    matched = F.filter("_traces", lambda t: t["matched"])
    ranked = F.transform(matched, lambda t: F.struct(action_rank(t["action"]).alias("r"), t["action"].alias("a")))
    out = (
        apply_policy(events, policy, facts, out="_traces")
        .withColumn("new_action", F.coalesce(F.array_max(ranked)["a"], F.lit("allow")))
        .withColumn("rules", F.transform(matched, lambda t: t["rule_id"])).drop("_traces")
    )
    return settle(out, "new_action", "rules")


def policy_dry_run(events: DataFrame, policy: Policy, full_facts: bool = False) -> DataFrame:
    """How many events would go from each recorded action to each new one."""
    out = replayed(events, policy, full_facts)
    return out.groupBy(F.col("action").alias("from_action"), F.col("new_action").alias("to_action")).agg(F.count("*").alias("events"))


def policy_changes(events: DataFrame, policy: Policy, full_facts: bool = False, examples: int | None = None) -> DataFrame:
    """Events whose outcome would change; ``examples`` is how many the report shows, ``None`` all."""
    out = replayed(events, policy, full_facts).filter(F.col("new_action") != F.col("action")).select(
        "event_id", "correlation_id", F.col("action").alias("from_action"), F.col("new_action").alias("to_action"), "rules"
    )
    return out if examples is None else out.orderBy("event_id").limit(examples)


def compliance_report(events: DataFrame, policies: Sequence[Policy], full_facts: bool = False) -> DataFrame:
    """Events per rule set, rule and new action: the traffic as each template would have treated it.

    All rule sets are evaluated on one pass over the events.
    """
    out = events
    keep = []
    for i, p in enumerate(policies):
        out = replayed(out, p, full_facts).withColumnRenamed("new_action", f"_a{i}").withColumnRenamed("rules", f"_r{i}")
        none = F.array(F.lit(None).cast("string"))
        keep.append(F.struct(
            F.lit(p.id).alias("template"), F.col(f"_a{i}").alias("new_action"),
            F.when(F.size(f"_r{i}") > 0, F.col(f"_r{i}")).otherwise(none).alias("rules"),
        ))
    rows = out.select(F.inline(F.array(*keep)))
    rules = rows.select("template", "new_action", F.explode("rules").alias("rule_id"))
    return rules.groupBy("template", "rule_id", "new_action").agg(F.count("*").alias("events"))


# --- policy versions and fleet ---------------------------------------------------------


def decisions_by_policy_version(events: DataFrame, policies: DataFrame) -> DataFrame:
    """Decisions per recorded policy version, joined to the history (bundle, version, etag, published, created_ms).

    ``altered`` marks a version whose content changed; ``current`` the bundle's newest published one.
    """
    per = events.groupBy("policy_version").agg(F.count("*").alias("decisions"), F.count_if(is_blocked()).alias("blocked"))
    history = policies.groupBy("bundle", "version").agg(
        (F.count_distinct("etag") > 1).alias("altered"),
        F.max(F.when(F.col("published"), F.col("created_ms"))).alias("_at"),
    )
    newest = policies.filter("published").groupBy("bundle").agg(
        F.max(F.struct("created_ms", "version")).alias("_new")
    ).select("bundle", F.col("_new.version").alias("_current"))
    known = history.join(newest, "bundle", "left").select(
        F.concat_ws("@", "bundle", "version").alias("policy_version"), "bundle", "version", "altered",
        F.coalesce(F.col("version") == F.col("_current"), F.lit(False)).alias("current"),
    )
    return known.join(per, "policy_version", "full").withColumns({
        "decisions": F.coalesce("decisions", F.lit(0).cast("bigint")), "blocked": F.coalesce("blocked", F.lit(0).cast("bigint")),
    })


_INSTANCE_DEFAULTS = {"application": "unknown", "environment": "unknown", "language": "python"}
_INSTANCE_FIELDS = ("application", "environment", "sdk_version", "language", "policy_id", "policy_version", "detectors", "monitor_only")


def upsert_instances(reports: DataFrame) -> DataFrame:
    """Fleet table from registrations and heartbeats (kind, instance_id, ts_ms, seq, fields...).

    A registration sets every field; a heartbeat only those it carries. Each field is the
    newest non-empty value at or after the last registration: one combined aggregate.
    """
    at = F.struct("ts_ms", "seq")
    full = F.col("kind") == "register"
    last = reports.groupBy("instance_id").agg(
        F.max(F.when(full, at)).alias("_reg"), F.min("ts_ms").alias("first_seen_ms"), F.max("ts_ms").alias("last_seen_ms")
    )
    rows = reports.join(last, "instance_id").filter(F.col("_reg").isNull() | (at >= F.col("_reg")))
    agg = []
    for name in _INSTANCE_FIELDS:
        c = F.col(name)
        given = (F.size(c) > 0) if name == "detectors" else c.isNotNull() if name == "monitor_only" else (c.isNotNull() & (c != ""))
        agg.append(F.max_by(F.when(given, c), F.when(given, at)).alias(name))
    out = rows.groupBy("instance_id").agg(*agg, F.first("first_seen_ms").alias("first_seen_ms"), F.first("last_seen_ms").alias("last_seen_ms"))
    fills = {n: F.coalesce(n, F.lit(d)) for n, d in _INSTANCE_DEFAULTS.items()}
    fills["monitor_only"] = F.coalesce("monitor_only", F.lit(False))
    fills["detectors"] = F.coalesce("detectors", F.array().cast("array<string>"))
    return out.withColumns(fills)


def fleet_status(instances: DataFrame, now_ms: int | Column, stale_after_s: int = 300) -> DataFrame:
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return instances.withColumn("status", F.when(F.col("last_seen_ms") >= now - stale_after_s * 1000, "healthy").otherwise("stale"))


def fleet_summary(instances: DataFrame) -> DataFrame:
    """(facet, key, instances): totals, versions, policies and who only monitors, from one scan."""
    ref = F.concat_ws("@", F.coalesce("policy_id", F.lit("None")), F.coalesce("policy_version", F.lit("None")))
    keys = {"total": F.lit("all"), "status": F.col("status"), "sdk_version": F.coalesce("sdk_version", F.lit("unknown")), "policy_version": ref}
    facets = [F.struct(F.lit(name).alias("facet"), key.cast("string").alias("key")) for name, key in keys.items()]
    alone = F.when(F.col("monitor_only"), F.struct(F.lit("monitor_only").alias("facet"), F.col("instance_id").cast("string").alias("key")))
    cells = instances.select(F.inline(F.filter(F.array(*facets, alone), lambda c: c.isNotNull())))
    return cells.groupBy("facet", "key").agg(F.count("*").alias("instances"))
