"""Snapshots of a repository that are kept in versions: a save says which version it follows, and is refused where another
one came first; a load is refused where the stored rows are not the ones that were saved."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("path", "mtime", "size", "sha256")


class Refused(ValueError):
    """A snapshot that may not be saved or loaded."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _digest(rows: DataFrame) -> tuple[int, str]:
    """How many rows there are, and a sum of their hashes: the order does not matter, the number of copies does."""
    one = F.xxhash64(*[F.col(c).cast("string") if c == "mtime" else F.col(c) for c in COLUMNS], *[F.col(c).isNull() for c in COLUMNS])
    n, total = rows.agg(F.count(F.lit(1)), F.sum(one.cast("decimal(38,0)"))).first()
    return n, str(total or 0)


def latest(spark: SparkSession, path: str) -> int:
    """The number of the last version under ``path``, 0 where there is none."""
    at, fs = _fs(spark, f"{path}/versions")
    return max((int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()), default=0) if fs.exists(at) else 0


def save(files: DataFrame, path: str, expected: int | None = None) -> int:
    """Save path, mtime, size and sha256 of ``files`` as the version after ``expected`` (null: the last one) and give its
    number. Refused: a version that exists by then, a null, blank or repeated path, an absolute one, one that leaves the root.

    Rows are written first, beside those of other versions; the version is one small file that is created only if no other
    save did so. That needs a file system that can (HDFS and local ones can).
    """
    spark = files.sparkSession
    expected = latest(spark, path) if expected is None else expected
    rows = f"rows-{uuid.uuid4().hex}"
    files.select(*COLUMNS).write.parquet(f"{path}/{rows}")
    stored = spark.read.parquet(f"{path}/{rows}")
    slashed = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    bad = F.col("path").isNull() | (F.trim("path") == "") | slashed.rlike(r"^/|^[A-Za-z]:") | F.array_contains(F.split(slashed, "/"), "..")
    wrong = stored.filter(F.coalesce(bad, F.lit(True))).select("path").unionByName(stored.groupBy("path").count().filter("count > 1").select("path"))
    found = wrong.first()
    n, total = (0, "") if found else _digest(stored)
    at, fs = _fs(spark, f"{path}/versions/{expected + 1}")
    try:
        if found:
            raise Refused(f"{found[0]!r} can't be the path of a snapshot")
        if latest(spark, path) != expected:
            raise Refused(f"version {latest(spark, path)} was saved since version {expected}")
        try:
            out = fs.create(at, False)
        except Exception as e:
            raise Refused(f"version {expected + 1} was saved by another") from e
        out.write(bytearray(json.dumps({"rows": rows, "n": n, "sum": total}).encode()))
        out.close()
    except Refused:
        gone, _ = _fs(spark, f"{path}/{rows}")
        fs.delete(gone, True)
        raise
    return expected + 1


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, int]:
    """The rows of a version (null: the last one) and its number; refused if there is none or its rows were changed."""
    version = latest(spark, path) if version is None else version
    at, fs = _fs(spark, f"{path}/versions/{version}")
    if not fs.exists(at):
        raise Refused(f"there is no version {version} under {path}")
    try:
        kept = json.loads(spark.read.text(f"{path}/versions/{version}", wholetext=True).first()[0])
        rows = spark.read.parquet(f"{path}/{kept['rows']}")
        same = _digest(rows) == (kept["n"], kept["sum"])
    except Exception as e:
        raise Refused(f"version {version} under {path} can't be read") from e
    if not same:
        raise Refused(f"the rows of version {version} under {path} are not the ones that were saved")
    return rows, version
