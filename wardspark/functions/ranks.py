"""Ordered names (actions, severities, trust, tiers, bands) and lookups on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered vocabularies and their ranks.
ACTIONS = ("allow", "flag", "redact", "challenge", "block")
SEVERITIES = ("info", "low", "medium", "high", "critical")
BANDS = ("none", "low", "medium", "high", "critical")
TIERS = ("low", "medium", "high", "critical")
STAGES = (
    "input", "output", "stream", "tool_call", "tool_result",
    "retrieval", "memory_write", "memory_read", "access", "tool_definition",
)
AUTHORITY = {"system": 5, "user_confirmed": 4, "user": 3, "tool": 2, "retrieved": 1, "external": 0}
REQUIRED_AUTHORITY = {"low": 1, "medium": 3, "high": 4, "critical": 4}


def lookup(col: Column, table: Mapping[str, object], default: object = None) -> Column:
    """``table[col]``, a lookup in a literal map."""
    from wardspark.functions.sqltext import mapping

    fallback = default if isinstance(default, Column) else F.lit(default)
    if not table:
        return fallback
    found = F.element_at(F.expr(mapping(table)), col)
    return found if default is None else F.coalesce(found, fallback)


def rank(col: Column, order: Sequence[str]) -> Column:
    """Position of ``col`` in ``order``; -1 for unknown or null."""
    from wardspark.functions.sqltext import strings

    return F.coalesce(F.array_position(strings(order), col), F.lit(0)).cast("int") - F.lit(1)


def action_rank(col: Column) -> Column:
    return rank(col, ACTIONS)


def severity_rank(col: Column) -> Column:
    return rank(col, SEVERITIES)


def tier_rank(col: Column) -> Column:
    return rank(col, TIERS)


def band_rank(col: Column) -> Column:
    return rank(col, BANDS)


def authority(trust: Column) -> Column:
    return lookup(trust, AUTHORITY)


def required_authority(tier: Column) -> Column:
    return lookup(tier, REQUIRED_AUTHORITY)


def band_of(score: Column) -> Column:
    """Risk band of a 0-25 score."""
    return (
        F.when(score <= 0, "none").when(score <= 4, "low").when(score <= 9, "medium")
        .when(score <= 16, "high").otherwise("critical")
    )


def worst(names: Column, order: Sequence[str], default: str) -> Column:
    """The highest-ranked name of an array column."""
    ranked = F.transform(names, lambda n: F.struct(rank(n, order).alias("r"), n.alias("n")))
    return F.coalesce(F.array_max(ranked)["n"], F.lit(default))


def security_relevant(action: Column, severity: Column, error: Column) -> Column:
    """Events that must never be sampled away."""
    return action.isin("block", "challenge") | (severity_rank(severity) >= 3) | error.isNotNull()


def sampled(key: Column, share: float) -> Column:
    """Whether a key is in a sample of ``share`` of all keys: by its MD5, alike in every run and engine; null keys are left out."""
    place = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 10_000
    return F.coalesce(place < round(share * 10_000), F.lit(False))
