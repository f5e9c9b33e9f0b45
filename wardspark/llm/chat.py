"""Chat rows for training: logged snapshots collapse to the longest, then turns are rendered.

A log that writes a conversation again after every turn holds many conversations that are the
beginning of longer ones. Each turn's digest, bound to its place, is added to those before it, so
every prefix of a conversation has a hash; a conversation whose hash is a proper prefix of
another is dropped by an anti-join, and of equal conversations the smallest conv_id stays.

A row holds at most ``TURNS`` turns of a conversation, so no conversation gathers without bound;
longer ones continue in the next part. Equal rows (conv_id, turn, role, text) count once; turns
that share a number follow each other by role and text; a null conv_id is a conversation like
any other, a null turn comes first, null roles and texts are empty; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm import shared

TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_HASH = [f"h{i}" for i in range(4)]


def _turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # The length keeps (role, text) apart however the two are split.
    return rows.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, digest of each distinct turn, its place (from 0) and the hash of the turns up to it."""
    distinct = turns.select("conv_id", "turn", "role", "digest").distinct()
    placed = shared.running_totals(distinct, ["conv_id"], ["turn", "role", "digest"], {"place": F.lit(1).cast("long")})
    bound = placed.withColumn("_bound", F.sha2(F.concat_ws(":", F.col("place").cast("string"), "digest"), 256))
    # Four sums of 32 bits each: they cannot overflow, and a prefix's hash is the sum of its turns.
    parts = [F.conv(F.substring("_bound", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    bound = bound.select("conv_id", "turn", "role", "digest", "place", *(p.alias(f"_p{i}") for i, p in enumerate(parts)))
    summed = shared.running_totals(bound, ["conv_id"], ["turn", "role", "digest"], {h: f"_p{i}" for i, h in enumerate(_HASH)})
    return shared.saved(summed.select("conv_id", "turn", "digest", "place", *((F.col(h) + F.col(f"_p{i}")).alias(h) for i, h in enumerate(_HASH))), "placed")


def maximal(placed: DataFrame) -> DataFrame:
    """conv_id of the conversations that no longer one begins with; of equal ones the smallest."""
    key = ["place", *_HASH]
    last = placed.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("end")).select("conv_id", "end.*")
    ends = last.groupBy(*key).agg(F.count("*").alias("n_ends"), F.min("conv_id").alias("conv_id"))
    passed = placed.groupBy(*key).agg(F.count("*").alias("n_turns"))
    # More turns than ends with one hash: some conversation goes on from there.
    longer = passed.join(ends.select(*key, "n_ends"), key).where("n_turns > n_ends").select(*key)
    return ends.join(longer, key, "left_anti").select("conv_id")


def chat_rows(conversations: DataFrame, turns_per_row: int = TURNS) -> DataFrame:
    """conv_id, part, n_turns and text of the conversations that are kept."""
    turns = _turns(conversations)
    placed = placed_turns(turns)
    kept = maximal(placed).withColumnRenamed("conv_id", "_kept")
    order = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("_kept")), "left_semi").select(
        F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("digest").alias("_digest"), "place")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("digest") == F.col("_digest"))
    texts = turns.join(order, same).select("conv_id", "place", F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE)).alias("turn"))
    part = F.floor(F.col("place") / turns_per_row).cast("long")
    rows = texts.distinct().groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "turn"))).alias("turns"))
    return rows.select("conv_id", "part", F.size("turns").alias("n_turns"), F.array_join(F.col("turns.turn"), "").alias("text"))
