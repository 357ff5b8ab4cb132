"""Tables in the folder that driver and executors share, which cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; a cluster session raises, as no
    machine-local folder would do there.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or getattr(spark.sparkContext, "_sediment_dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    spark.sparkContext._sediment_dir = "file://" + tempfile.mkdtemp(prefix="spark-sediment-", dir="/tmp")
    return spark.sparkContext._sediment_dir


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/sediment-{uuid.uuid4().hex}/{tag}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: its rows are fixed from then on, and a lost
    executor costs no recomputation of what came before."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(size: int, cores: int) -> int:
    """The number of tasks for source texts of ``size`` bytes in all: no task holds what comes of more than half a megabyte
    (a token takes some hundred bytes), and small ones still go to all cores."""
    return max(1, -(-size // (1 << 19)), min(cores, -(-size // (1 << 16))))


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", parts: int | None = None) -> DataFrame:
    """A join for tables that compress well. Their size on disk or in a shuffle says little of what they take in memory, so
    nothing is broadcast by it, and with ``parts`` both sides go to as many tasks, which aren't merged by it."""
    if parts:
        left, right = left.repartition(parts, *on), right.repartition(parts, *on)
    return left.join(right.hint("merge"), on, how)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
