"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package, once a session: they need no copy of the repository and no search path."""
    if spark.sparkContext.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(made)
        _SHIPPED.add(spark.sparkContext.applicationId)
    return spark


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a local session without one gets its own.

    Raises ``ValueError`` on a cluster that names none: a machine-local folder would lose rows there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/wardspark/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Jobs started here hand their rows to Python workers in lots of at most ``size``, which JVM and worker hold each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of ``df``, written once and read back: later stages survive lost executors without redoing it."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for each row under ``name``, written once: a scan done again may number its rows differently."""
    return saved(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def discard(df: DataFrame) -> None:
    """Remove the files of a table from ``saved`` that nothing will read again."""
    spark = df.sparkSession
    for root in {name.rpartition("/")[0] for name in df.inputFiles()}:
        if "/wardspark/" in root:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def running_totals(df: DataFrame, group: list[str], order: list[str], values: dict[str, str | Column]) -> DataFrame:
    """``df`` with, under each name of ``values``, the sum of that value over earlier rows of its group.

    A group may hold most rows: rows are ranged by (group, order), so that a large group covers
    many ranges; each range is summed, the sums are accumulated by range, and rows add only what
    precedes them in their own range. ``order`` must tell the rows of a group apart.
    """
    ranged = df.select("*", *(F.col(v).alias(f"_v_{n}") if isinstance(v, str) else v.alias(f"_v_{n}") for n, v in values.items()))
    ranged = saved(ranged.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    keys = [*group, "_range"]
    sums = ranged.groupBy(*keys).agg(*(F.sum(f"_v_{n}").alias(f"_sum_{n}") for n in values))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*(F.col(k).alias(f"_key_{k}") for k in keys), *(F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in values))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.select("*", *(F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_own_{n}") for n in values))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return own.join(bases, same).select(*df.columns, *((F.col(f"_base_{n}") + F.col(f"_own_{n}")).alias(n) for n in values))
