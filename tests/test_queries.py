"""Registered queries agree with their check SQL (a quick selection; tools/check_queries.py runs all)."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ("scan_pii", "scan_banned_topics", "overview", "detector_stats", "risk_matrix", "policy_dry_run",
         "halt_after_block", "cross_application_probe", "effective_roles_sql", "minute_counters", "current_turn")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return f"{float(v):.6g}" if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1e5 else str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in QUICK if n in entry.queries()])
def test_query_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(_norm(v) for v in r) for r in df.select(*cols).collect()) == want


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    out = entry.entry(spark)
    assert out.columns == ["source", "action", "band", "n"] and out.count() > 0


def test_scans_do_not_shuffle(spark):
    """Screening is one narrow plan: no exchange, only the needed columns read."""
    from wardspark.plans.firewall import screen

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = screen(docs).select("doc_id", "action")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "n_chars" not in plan.split("ReadSchema:")[-1]
