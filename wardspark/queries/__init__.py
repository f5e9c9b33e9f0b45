"""Registered queries over the given tables, each with its check SQL."""

from __future__ import annotations

from wardspark.queries.base import ORACLES, QUERIES, Query


def _load() -> None:
    from wardspark.queries import audit_queries, graph_queries, risk_queries, scan_queries, text_queries  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load()
    return QUERIES


def all_oracles() -> dict[str, str]:
    _load()
    return ORACLES
