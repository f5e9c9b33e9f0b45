"""Provenance of agent memories: trust floors, lineage, recall and the authority gate.

Memories are (memory_id, content, trust, source, derived_from, transformations, user_confirmed).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspark.functions.ranks import AUTHORITY, REQUIRED_AUTHORITY, authority, lookup
from wardspark.functions.text import memory_terms
from wardspark.operators.scan import finding
from wardspark.session import ensure_checkpoint_dir

BY_AUTHORITY = {v: k for k, v in AUTHORITY.items()}
GATED_TIERS = ("high", "critical")
RELEVANCE = 0.2
CONSOLIDATION = "llm_consolidation"


def provenance_edges(memories: DataFrame) -> DataFrame:
    """(child, parent) pairs whose parent is known."""
    edges = memories.select(F.col("memory_id").alias("child"), F.explode("derived_from").alias("parent")).distinct()
    known = memories.select(F.col("memory_id").alias("parent"))
    return edges.join(known, "parent", "left_semi").select("child", "parent")


def effective_trust(memories: DataFrame) -> DataFrame:
    """Add ``effective_trust`` and ``authority``: no record outranks any ancestor.

    Lowered levels spread along the edges until none changes; a round touches only the
    children of what was lowered in the last one. Unknown parents are ignored, and a
    consolidation without a known parent counts as external.
    """
    ensure_checkpoint_dir(memories.sparkSession)
    edges = provenance_edges(memories).checkpoint()
    parented = edges.groupBy(F.col("child").alias("memory_id")).agg(F.lit(True).alias("_has_parent"))
    merged = F.coalesce(F.array_contains("transformations", F.lit(CONSOLIDATION)), F.lit(False))
    orphan = merged & F.col("_has_parent").isNull()
    start = F.when(orphan, F.lit(0)).when(merged, F.lit(5)).otherwise(authority(F.col("trust")))
    state = memories.join(parented, "memory_id", "left").select("memory_id", start.alias("level")).checkpoint()
    changed = state
    while True:
        offers = (
            edges.join(changed.withColumnRenamed("memory_id", "parent"), "parent")
            .groupBy(F.col("child").alias("memory_id")).agg(F.min("level").alias("_offer"))
        )
        changed = (
            offers.join(state, "memory_id").filter(F.col("_offer") < F.col("level"))
            .select("memory_id", F.col("_offer").alias("level")).checkpoint()
        )
        if changed.isEmpty():
            break
        lowered = changed.withColumnRenamed("level", "_low")
        state = state.join(lowered, "memory_id", "left").select(
            "memory_id", F.coalesce("_low", "level").alias("level")
        ).checkpoint()
    confirmed = F.coalesce(F.col("user_confirmed"), F.lit(False)) & (F.col("level") >= AUTHORITY["user"])
    return memories.join(state, "memory_id").select(
        *memories.columns,
        lookup(F.col("level"), BY_AUTHORITY).alias("effective_trust"),
        confirmed.alias("confirmed"),
        F.when(confirmed, F.greatest(F.col("level"), F.lit(AUTHORITY["user_confirmed"]))).otherwise(F.col("level")).alias("authority"),
    )


def lineage(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """(memory_id, ancestor, depth): the full ancestry of each requested id, itself at depth 0."""
    ensure_checkpoint_dir(memories.sparkSession)
    edges = provenance_edges(memories).checkpoint()
    known = ids.select("memory_id").distinct().join(memories.select("memory_id"), "memory_id", "left_semi")
    found = known.select("memory_id", F.col("memory_id").alias("ancestor"), F.lit(0).alias("depth")).checkpoint()
    frontier = found
    for depth in count(1):
        up = (
            frontier.select("memory_id", F.col("ancestor").alias("child")).join(edges, "child")
            .select("memory_id", F.col("parent").alias("ancestor")).distinct()
        )
        frontier = up.join(found, ["memory_id", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            return found
        found = found.union(frontier)


def recall(queries: DataFrame, memories: DataFrame, k: int = 5, min_trust: str | None = None) -> DataFrame:
    """The ``k`` memories of each query (query_id, text): highest authority first, then term overlap.

    Memories are partitioned by id before their terms are exploded, so counting a pair's shared
    terms needs no further shuffle when Spark broadcasts the query terms, and the ranked filter
    prunes each task's pairs to ``k`` per query before the one that ranks them.
    """
    pool = memories if min_trust is None else memories.filter(F.col("authority") >= AUTHORITY[min_trust])
    terms = memory_terms(F.col("text"))
    q = queries.select("query_id", F.size(terms).alias("n_terms"), F.explode(terms).alias("_t"))
    m = pool.repartition("memory_id").select("memory_id", "authority", F.explode(memory_terms(F.col("content"))).alias("_t"))
    pairs = m.join(q, "_t").groupBy("memory_id", "query_id", "authority", "n_terms").agg(F.count("*").alias("shared"))
    scored = pairs.withColumn("overlap", F.col("shared") / F.col("n_terms"))
    best = Window.partitionBy("query_id").orderBy(F.desc("authority"), F.desc("overlap"), "memory_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "memory_id", "authority", "overlap", "rank"
    )


def authorize_calls(calls: DataFrame, memories: DataFrame, pool: int = 10, relevance: float = RELEVANCE) -> DataFrame:
    """Whether memories carry enough authority for each call (query_id, text, risk, user_confirmed).

    Only high and critical calls are gated; a confirmed call passes; support is a recalled
    memory sharing at least ``relevance`` of the call's argument terms.
    """
    gated = calls.filter(F.col("risk").isin(*GATED_TIERS) & ~F.coalesce("user_confirmed", F.lit(False)))
    required = lookup(F.col("risk"), REQUIRED_AUTHORITY)
    support = recall(gated.select("query_id", "text"), memories, pool).filter(F.col("overlap") >= relevance)
    # At most ``pool`` rows per call reach these lists.
    held = support.join(gated.select("query_id", required.alias("_req")), "query_id").groupBy("query_id").agg(
        F.max("authority").alias("available"), F.min("authority").alias("_weakest"),
        F.sort_array(F.collect_list("memory_id")).alias("supporting"),
        F.sort_array(F.collect_list(F.when(F.col("authority") < F.col("_req"), F.col("memory_id")))).alias("_low"),
    )
    is_gated = F.col("risk").isin(*GATED_TIERS)
    confirmed = F.coalesce("user_confirmed", F.lit(False))
    none = F.array().cast("array<string>")
    enough = F.col("available") >= required
    allowed = ~is_gated | confirmed | F.coalesce(enough, F.lit(False))
    reason = (
        F.when(~is_gated, F.concat("risk", F.lit("-risk call does not require memory-backed authority")))
        .when(confirmed, "user confirmed this action out of band")
        .when(F.col("available").isNull(), F.concat(F.lit("no memory supports this "), "risk", F.lit("-risk call")))
        .when(enough, "supporting memory carries sufficient authority")
        .otherwise(F.concat(F.lit("supported only by "), lookup(F.col("_weakest"), BY_AUTHORITY), F.lit("-authority memory")))
    )
    available = (
        F.when(~is_gated, AUTHORITY["system"]).when(confirmed, AUTHORITY["user_confirmed"])
        .otherwise(F.coalesce("available", F.lit(-1)))
    )
    return calls.join(held, "query_id", "left").select(
        *calls.columns, allowed.alias("allowed"), reason.alias("reason"), required.alias("required_authority"),
        available.alias("available_authority"), F.coalesce("supporting", none).alias("supporting"),
        F.when(allowed, none).otherwise(F.coalesce("_low", none)).alias("blocking"),
    )


def gate_findings(gated: DataFrame) -> DataFrame:
    """The gate's verdicts as findings: a refusal is a critical block."""
    found = finding(
        "memory_provenance", "memory_provenance_laundering", ~F.col("allowed"), score=F.lit(1.0),
        severity=F.lit("critical"), action=F.lit("block"), summary=F.col("reason"),
        evidence=F.to_json(F.struct("required_authority", "available_authority", "supporting", "blocking")),
    )
    return gated.withColumn("finding", found)


def memory_stats(memories: DataFrame) -> DataFrame:
    """Totals by trust level, with how many were derived and confirmed."""
    return memories.groupBy("effective_trust").agg(
        F.count("*").alias("total"), F.count_if(F.size("derived_from") > 0).alias("derived"),
        F.count_if("confirmed").alias("user_confirmed"),
    )


def screen_memory_writes(memories: DataFrame, policy=None) -> DataFrame:
    """Scan each write at its boundary: blocked ones are not ``stored``, redacted ones are rewritten and marked."""
    from wardspark.plans.firewall import screen

    trust = F.col("effective_trust") if "effective_trust" in memories.columns else F.col("trust")
    out = screen(memories, "content", stage="memory_write", policy=policy, trust=trust)
    marked = F.concat(F.coalesce("transformations", F.array().cast("array<string>")), F.array(F.lit("redaction")))
    return out.withColumns({
        "stored": F.col("action") != "block",
        "content": F.when(F.col("action") == "redact", F.col("payload")).otherwise(F.col("content")),
        "transformations": F.when(F.col("action") == "redact", marked).otherwise(F.col("transformations")),
    })
