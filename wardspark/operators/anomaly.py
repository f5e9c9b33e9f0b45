"""Fleet anomalies over light event projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.functions.ranks import severity_rank
from wardspark.operators.audit import is_blocked
from wardspark.operators.scan import with_scalars

# Thresholds and the detectors production must run.
INJECTION_THRESHOLD, CROSS_APP_THRESHOLD, VOLUME_SIGMA = 5, 2, 3.0
MANIPULATION = ("prompt_injection", "multi_turn_attack", "authority_manipulation")
EXPECTED_DETECTORS = ("pii", "prompt_injection", "secrets")

ANOMALY_COLUMNS = ("kind", "dedupe_key", "title", "severity", "score", "entities", "evidence", "examples")
_MAP = "map<string,string>"


def _pairs(**cols: Column) -> Column:
    entries: list[Column] = []
    for name, c in cols.items():
        entries += [F.lit(name), c.cast("string")]
    return F.create_map(*entries).cast(_MAP)


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *parts)


def first_examples(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` correlation ids of each key, by ranked filter, so no group is gathered."""
    at = Window.partitionBy(*keys).orderBy("timestamp_ms", "event_id")
    few = rows.select(*keys, "timestamp_ms", "event_id", "correlation_id").withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= n)
    return few.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_n", "correlation_id"))), lambda x: x["correlation_id"]).alias("examples")
    )


def repeated_injection(events: DataFrame, threshold: int = INJECTION_THRESHOLD) -> DataFrame:
    """One principal grinding away at injection attempts in one application."""
    who = F.coalesce(F.when(F.col("principal_id") != "", F.col("principal_id")), F.lit("anonymous"))
    rows = events.filter(is_blocked() & F.arrays_overlap("categories", F.lit(list(MANIPULATION)))).withColumns(
        {"principal": who, "app": F.coalesce("application", F.lit("unknown"))}
    )
    keys = ["principal", "app"]
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= threshold)
    hot = rows.join(found.select(*keys), keys, "left_semi")
    cats = hot.select(*keys, F.explode("categories").alias("c")).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("c")), ",").alias("cats"))
    return found.join(cats, keys).join(first_examples(hot, keys, 5), keys).select(
        F.lit("repeated_injection").alias("kind"), _key("repeated_injection", F.col("principal"), F.col("app")).alias("dedupe_key"),
        F.concat(F.col("n"), F.lit(" blocked injection attempts from "), "principal").alias("title"),
        F.when(F.col("n") >= threshold * 2, "high").otherwise("medium").alias("severity"),
        F.least(F.lit(1.0), F.col("n") / (threshold * 3)).alias("score"),
        _pairs(principal_id=F.col("principal"), application=F.col("app")).alias("entities"),
        _pairs(count=F.col("n"), categories=F.col("cats")).alias("evidence"), "examples",
    )


def cross_application_probe(events: DataFrame, threshold: int = CROSS_APP_THRESHOLD) -> DataFrame:
    """The same prompt digest seen in several applications and refused at least once.

    A digest may carry a third of the rows: counts are combined over distinct
    (digest, application) pairs, never over gathered events.
    """
    rows = events.withColumn("digest", F.col("tags")["prompt_sha256"]).filter(F.coalesce("digest", F.lit("")) != "")
    flagged = F.col("action").isin("block", "challenge", "flag")
    per_app = rows.groupBy("digest", "application").agg(F.count("*").alias("_n"), F.count_if(flagged).alias("_f"))
    found = (
        per_app.groupBy("digest").agg(
            F.count("*").alias("apps"), F.sum("_n").alias("total"), F.sum("_f").alias("flagged"),
            F.array_join(F.sort_array(F.collect_set("application")), ",").alias("names"))
        .filter((F.col("apps") >= threshold) & (F.col("flagged") > 0))
    )
    hot = rows.filter(flagged).join(found.select("digest"), "digest", "left_semi")
    return found.join(first_examples(hot, ["digest"], 5), "digest").select(
        F.lit("cross_application_probe").alias("kind"), _key("cross_application_probe", F.col("digest")).alias("dedupe_key"),
        F.concat(F.lit("Identical payload probed "), F.col("apps"), F.lit(" applications")).alias("title"),
        F.lit("high").alias("severity"), F.least(F.lit(1.0), F.col("apps") / (threshold * 2)).alias("score"),
        _pairs(prompt_sha256=F.col("digest")).alias("entities"),
        _pairs(applications=F.col("names"), flagged=F.col("flagged"), total=F.col("total")).alias("evidence"), "examples",
    )


def volume_baseline(counters: DataFrame) -> DataFrame:
    """Per application: last minute's count, and mean and deviation over the earlier observed minutes.

    ``counters`` is (bucket_ms, application, count). Minutes without an application's events
    count as zero, so the moments come from sums and the number of observed minutes: nothing
    is filled in or crossed.
    """
    per = counters.groupBy("bucket_ms", F.coalesce("application", F.lit("unknown")).alias("application")).agg(F.sum("count").alias("n"))
    span = per.groupBy("bucket_ms").agg(F.lit(1).alias("_one")).agg(F.max("bucket_ms").alias("latest"), F.count("*").alias("minutes"))
    marked = with_scalars(per, span, "latest", "minutes").filter(F.col("minutes") >= 5)
    past = F.col("bucket_ms") < F.col("latest")
    agg = marked.groupBy("application", "minutes").agg(
        F.coalesce(F.sum(F.when(~past, F.col("n"))), F.lit(0)).alias("current"),
        F.coalesce(F.sum(F.when(past, F.col("n"))), F.lit(0)).alias("_s1"),
        F.coalesce(F.sum(F.when(past, F.col("n") * F.col("n"))), F.lit(0)).alias("_s2"),
    )
    k = F.col("minutes") - 1
    mean = F.col("_s1") / k
    # Exact integer numerator, so a flat series has deviation zero and not a rounding residue.
    var = (k * F.col("_s2") - F.col("_s1") * F.col("_s1")) / (k * k)
    return agg.select("application", "current", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), var)).alias("stdev"))


def volume_spike(counters: DataFrame, sigma: float = VOLUME_SIGMA) -> DataFrame:
    """Applications whose last minute is far above their baseline."""
    base = volume_baseline(counters).filter(F.col("current") > 0)
    flat = F.col("stdev") < 1e-6
    z = F.when(~flat, (F.col("current") - F.col("mean")) / F.col("stdev"))
    burst = flat & (F.col("mean") > 0) & (F.col("current") > F.greatest(F.lit(10.0), F.col("mean") * 5))
    out = base.withColumns({"z": z, "burst": burst}).filter((F.col("z") >= sigma) | F.col("burst"))
    return out.select(
        F.lit("volume_spike").alias("kind"), _key("volume_spike", F.col("application")).alias("dedupe_key"),
        F.concat(F.lit("Traffic spike in "), "application").alias("title"), F.lit("medium").alias("severity"),
        F.when(F.col("burst"), 0.5).otherwise(F.least(F.lit(1.0), F.col("z") / 10)).alias("score"),
        _pairs(application=F.col("application")).alias("entities"),
        _pairs(current=F.col("current"), baseline_mean=F.round("mean", 2), z_score=F.round("z", 2)).alias("evidence"),
        F.array().cast("array<string>").alias("examples"),
    )


def _up_to(counts: DataFrame, key: str) -> DataFrame:
    """Running totals over grouped counts, in key order."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("_cum", F.sum("n").over(w))


def midpoint(events: DataFrame) -> DataFrame:
    """One row (rows, half, cut_ms, cut_id): the first event of the later half in (timestamp, id) order.

    Found by narrowing: counts per minute, then per millisecond of the one minute holding the
    middle, then the ids of the one millisecond. Only grouped counts are ordered globally, so
    the log itself is never sorted or brought to one task.
    """
    e = events.select("timestamp_ms", "event_id", F.expr("timestamp_ms div 60000").alias("_m"))
    minutes = _up_to(e.groupBy("_m").agg(F.count("*").alias("n")), "_m")
    total = e.agg(F.count("*").alias("rows")).withColumn("half", F.expr("rows div 2"))
    at_m = with_scalars(minutes, total, "rows", "half").filter((F.col("_cum") > F.col("half")) & (F.col("_cum") - F.col("n") <= F.col("half")))
    at_m = at_m.select("_m", "rows", "half", (F.col("half") - F.col("_cum") + F.col("n")).alias("_left"))
    ms = _up_to(e.join(F.broadcast(at_m.select("_m")), "_m").groupBy("timestamp_ms").agg(F.count("*").alias("n")), "timestamp_ms")
    at_ms = with_scalars(ms, at_m, "rows", "half", "_left").filter((F.col("_cum") > F.col("_left")) & (F.col("_cum") - F.col("n") <= F.col("_left")))
    at_ms = at_ms.select("timestamp_ms", "rows", "half", (F.col("_left") - F.col("_cum") + F.col("n")).alias("_left"))
    same = e.join(F.broadcast(at_ms), "timestamp_ms")
    nth = same.withColumn("_n", F.row_number().over(Window.partitionBy("timestamp_ms").orderBy("event_id")))
    return nth.filter(F.col("_n") == F.col("_left") + 1).select(
        "rows", "half", F.col("timestamp_ms").alias("cut_ms"), F.col("event_id").alias("cut_id")
    )


def new_attack_surface(events: DataFrame, min_rows: int = 20) -> DataFrame:
    """Applications without a block in the first half of the rows that block in the second."""
    cut = midpoint(events).filter(F.col("rows") >= min_rows).select("cut_ms", "cut_id")
    rows = with_scalars(events, cut, "cut_ms", "cut_id").withColumn(
        "_late", (F.col("timestamp_ms") > F.col("cut_ms")) | ((F.col("timestamp_ms") == F.col("cut_ms")) & (F.col("event_id") >= F.col("cut_id")))
    )
    late_block = F.col("_late") & is_blocked()
    found = rows.groupBy("application").agg(
        F.count_if(~F.col("_late")).alias("early"), F.count_if(~F.col("_late") & is_blocked()).alias("early_blocks"),
        F.count_if(late_block).alias("blocks"),
    ).filter((F.col("early") > 0) & (F.col("early_blocks") == 0) & (F.col("blocks") > 0))
    hot = rows.filter(late_block).join(found.select("application"), "application", "left_semi")
    cats = hot.select("application", F.explode_outer("categories").alias("c")).groupBy("application").agg(
        F.array_join(F.sort_array(F.collect_set("c")), ",").alias("cats")
    )
    return found.join(cats, "application").join(first_examples(hot, ["application"], 3), "application").select(
        F.lit("new_attack_surface").alias("kind"), _key("new_attack_surface", F.col("application")).alias("dedupe_key"),
        F.concat("application", F.lit(" started blocking requests")).alias("title"), F.lit("medium").alias("severity"),
        F.lit(0.5).alias("score"), _pairs(application=F.col("application")).alias("entities"),
        _pairs(blocks=F.col("blocks"), categories=F.col("cats")).alias("evidence"), "examples",
    )


def coverage_gap(instances: DataFrame) -> DataFrame:
    """Live production instances missing an expected detector, or only monitoring."""
    rows = instances.filter(F.col("environment").isin("production", "prod") & (F.coalesce("status", F.lit("")) != "stale")).withColumn(
        "missing", F.array_sort(F.array_except(F.lit(list(EXPECTED_DETECTORS)), F.coalesce("detectors", F.array().cast("array<string>"))))
    )
    rows = rows.filter((F.size("missing") > 0) | F.col("monitor_only"))
    return rows.select(
        F.lit("coverage_gap").alias("kind"), _key("coverage_gap", F.col("application"), F.col("instance_id")).alias("dedupe_key"),
        F.concat(F.lit("Coverage gap in "), "application").alias("title"),
        F.when(F.size("missing") > 0, "high").otherwise("medium").alias("severity"), F.lit(0.6).alias("score"),
        _pairs(application=F.col("application"), instance_id=F.col("instance_id")).alias("entities"),
        _pairs(missing_detectors=F.array_join("missing", ","), monitor_only=F.col("monitor_only")).alias("evidence"),
        F.array().cast("array<string>").alias("examples"),
    )


def analyse_anomalies(events: DataFrame, counters: DataFrame, instances: DataFrame | None = None,
                      failures: list[tuple[str, str]] | None = None) -> DataFrame:
    """All anomalies, worst first. A kind whose plan cannot be built is noted in ``failures`` and left out."""
    kinds = {
        "repeated_injection": lambda: repeated_injection(events),
        "cross_application_probe": lambda: cross_application_probe(events),
        "volume_spike": lambda: volume_spike(counters),
        "new_attack_surface": lambda: new_attack_surface(events),
    }
    if instances is not None:
        kinds["coverage_gap"] = lambda: coverage_gap(instances)
    out: DataFrame | None = None
    for name, build in kinds.items():
        try:
            found = build().select(*ANOMALY_COLUMNS)
            found.schema  # analysis errors surface here
        except Exception as exc:  # noqa: BLE001 - one broken kind must not silence the others
            if failures is None:
                raise
            failures.append((name, str(exc)))
            continue
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no anomaly kind could be evaluated")
    return out.orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("score"), "dedupe_key")
