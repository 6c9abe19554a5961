"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or else a folder in the warehouse.  On a cluster, one of this machine alone raises."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse + "/intermediate"


def drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - at exit the session may be gone
        return


def kept_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


_OPEN: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`cut` makes inside go at the end, so what leaves must have been written or collected."""
    _OPEN.append([])
    try:
        yield
    finally:
        for owner, path in _OPEN.pop():
            drop(owner, path)


#: Bytes that a join of :func:`measured_joins` broadcasts at most; a walk has some twenty joins a hop.
BROADCAST = 1 << 20


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """What is planned inside broadcasts only what was measured to be small, not what has small files.

    Ids and types in files are coded so well that a broadcast of them is many times larger, and grows with the graph.
    """
    first, later = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before, after = spark.conf.get(first), spark.conf.get(later, None)
    if (after or before) != "-1":
        spark.conf.set(later, str(BROADCAST))
    spark.conf.set(first, "-1")
    try:
        yield
    finally:
        spark.conf.set(first, before)
        if after is None:
            spark.conf.unset(later)
        else:
            spark.conf.set(later, after)


def saved(df: DataFrame, by: str) -> DataFrame:
    """The same rows, read back from a table with a folder for each value of a column; it goes when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    atexit.register(drop, df.sparkSession, path)
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table; it goes with the innermost :func:`scope`, else when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append((df.sparkSession, path))
    else:
        atexit.register(drop, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, n: int, rows: int = 500_000) -> DataFrame:
    """The same ``n`` rows or so, in a table bucketed and sorted by a key, about ``rows`` a bucket; it goes when the driver ends.

    There are as many buckets as shuffles have partitions, or more, so that a join by the key leaves the table where it is.
    """
    spark = df.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rows))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", kept_path(spark, name)).saveAsTable(table)
    atexit.register(_forget, spark, table)
    return spark.table(table)


def _forget(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # noqa: BLE001 - at exit the session may be gone
        return
