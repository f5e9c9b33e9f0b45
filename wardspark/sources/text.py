"""Screening plain text files line by line."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.plans.firewall import screen


def screened_lines(lines: DataFrame, stage: str = "input", trust: str | Column = "user", **kw: Any) -> DataFrame:
    """Every non-blank line of a ``value`` column, screened."""
    t = trust if isinstance(trust, Column) else F.lit(trust)
    return screen(lines.filter(F.trim("value") != ""), "value", stage=stage, trust=t, **kw)


def scan_lines(spark: SparkSession, path: str, stage: str = "input", trust: str = "user", **kw: Any) -> DataFrame:
    """Screen the lines of text files under ``path``."""
    return screened_lines(spark.read.text(path), stage, trust, **kw)


def scan_totals(screened: DataFrame) -> DataFrame:
    return screened.agg(F.count("*").alias("scanned"), F.count_if(F.col("action") == "block").alias("blocked"))
