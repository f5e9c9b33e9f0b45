"""From raw documents to packed sequences: each stage works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir), keeps the columns of documents (the last returns pieces)
and has defined results for nulls, empty texts, repeated rows and empty tables: see its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import attention, jaccard, mixing, packing, shared, tokens

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: A fitted network and the tokenizers library have no SQL form.
ORACLE_SQL = None
#: What is left after the first stages should be good prose; other domains get no share.
TARGETS = {"good": 1.0, "poor": 0.0, "toxic": 0.0}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.ship(spark).read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = attention.train(docs, _labels(spark, sf_dir))
    score = shared.free(docs, "_score")
    return attention.score_documents(docs, model, score).where(F.col(score) >= attention.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id, of equal ones the first row."""
    row = shared.free(docs, "_row")
    rows = shared.numbered(docs, row)
    groups = jaccard.jaccard_groups(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    named = groups.join(rows.select(F.col(row).alias("row"), "doc_id"), "row")
    first = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    return rows.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once or, with the chance that its rate leaves, not at all; none twice, as near copies are gone."""
    row = shared.free(docs, "_row")
    rows = shared.numbered(docs, row)
    rates = mixing.mix(rows, _labels(spark, sf_dir), TARGETS, most=1.0, row=row)
    return mixing.apply_rates(rows, rates, row).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, in sequences mixed by source."""
    return packing.digests(packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"), keep_ids=False))


STAGES: list[tuple[str, Stage]] = [("quality", keep_quality), ("near copies", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written once and read by the next."""
    docs = shared.ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared.saved(docs, "stage-" + name.replace(" ", "-"))
    return docs
