from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from wardspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def events(spark, sf):
    """The audit view, written once."""
    from wardspark.queries.base import audit

    return audit(spark, sf).persist()


@pytest.fixture
def scan(spark):
    """scan(name, texts, stage, options, **columns) -> list of finding rows."""
    from pyspark.sql import functions as F

    from wardspark.operators import detectors as _  # noqa: F401
    from wardspark.operators.scan import REGISTRY, ScanInput, run_scan

    def run(name, texts, stage="input", options=None, **columns):
        many = [texts] if isinstance(texts, str) else list(texts)
        df = spark.createDataFrame(list(enumerate(many)), "i int, t string").coalesce(1)
        out = run_scan(df, REGISTRY[name].build(ScanInput(F.col("t"), stage=stage, **columns), options or {}), "f")
        rows = [r["f"] for r in out.select("i", "f").orderBy("i").collect()]
        return rows[0] if isinstance(texts, str) else rows

    return run
