"""Staging tables in the shared folder of the cluster.

A staged table cuts lineage like ``checkpoint()`` does and, being Parquet, gives the planner its true
size: later joins against it become broadcasts only while it is under ``autoBroadcastJoinThreshold``
and sort-merge joins beyond it, with no hint in the code.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/tipoff/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in partitions of column ``by`` if named, and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if by is None:
        df.write.mode("errorifexists").parquet(path)
    else:
        # a file a task and partition: ``df`` comes out of a shuffle, and another one would move every row again
        df.write.mode("errorifexists").option("compression", "zstd").partitionBy(by).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    staged._staged_path = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Remove tables made by ``stage`` that nothing will read again."""
    for df in staged:
        path = getattr(df, "_staged_path", None)
        if path is not None:
            sc = df.sparkSession.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def drop_staged(spark: SparkSession) -> None:
    """Remove what this application staged; call it when its last job is done."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tipoff/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
