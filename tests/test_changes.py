"""Streams of file versions, and snapshots in versions."""

import datetime
import glob

import pytest
from pyspark.sql import functions as F
from sediment.operators import snapshots
from sediment.streaming import changes

AT = datetime.datetime(2024, 1, 1)


def version(path, seq, text, at=0, gone=False):
    return path, seq, AT + datetime.timedelta(seconds=at), None if text is None else "sha of " + text, gone, text


def lines(batch):
    return batch.select("path", F.explode(F.split("content", "\n")).alias("line"))


def run(spark, base, number, rows):
    spark.createDataFrame(rows, changes.VERSION).coalesce(1).write.parquet(f"{base}/in/{number}")
    stream = spark.readStream.schema(changes.VERSION).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    changes.keep_analysed(stream, lines, f"{base}/out").awaitTermination()
    found = spark.read.parquet(f"{base}/out/versions").filter(F.col("batch") == number)
    states = {r["path"]: (r["state"], r["version"]) for r in found.collect()}
    return states, sorted((r["path"], r["line"]) for r in changes.analysed(spark, f"{base}/out").collect())


def test_versions_of_files(spark, tmp_path):
    base = f"file://{tmp_path}"
    first = [version("a", 1, "x\ny"), version("b", 1, "b1"), version("b", 2, "b2"), version("c", 1, "c"), version("d", 1, None, gone=True), version(None, 1, "n"), version("e", None, "n"), version("f", 1, "f"), version("f", 1, "f")]
    states, found = run(spark, base, 0, first)
    assert states == {"a": ("new", 1), "b": ("new", 2), "c": ("new", 1), "f": ("new", 1)}  # of b, only what is newest
    assert found == [("a", "x"), ("a", "y"), ("b", "b2"), ("c", "c"), ("f", "f")]
    second = [version("a", 2, "y\nz"), version("b", 3, "b2", at=9), version("c", 2, None, gone=True), version("f", 2, "f"), version("d", 1, "late")]
    states, found = run(spark, base, 1, second)
    assert states == {"a": ("modified", 2), "b": ("touched", 2), "c": ("deleted", 1), "f": ("unmodified", 1)}
    assert found == [("a", "y"), ("a", "z"), ("b", "b2"), ("f", "f")]  # line x of a and the lines of c are taken back
    third = [version("a", 1, "x\ny"), version("c", 1, "c"), version("d", 2, "d"), version("c", 3, "again"), version("f", 3, None, gone=True)]
    states, found = run(spark, base, 2, third)
    assert states == {"c": ("new", 3), "d": ("new", 2), "f": ("deleted", 1)}  # a's old version came late
    assert found == [("a", "y"), ("a", "z"), ("b", "b2"), ("c", "again"), ("d", "d")]


def table(spark, *paths):
    return spark.createDataFrame([(p, AT, 1, p) for p in paths], "path string, mtime timestamp, size long, sha256 string")


def test_snapshots_follow_each_other(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    with pytest.raises(snapshots.Refused, match="no version"):
        snapshots.load(spark, at)
    assert snapshots.latest(spark, at) == 0 and snapshots.save(table(spark, "a"), at) == 1
    assert snapshots.save(table(spark, "a", "b"), at, expected=1) == 2
    with pytest.raises(snapshots.Refused, match="saved since"):
        snapshots.save(table(spark, "c"), at, expected=1)
    rows, number = snapshots.load(spark, at)
    assert number == 2 and sorted(r["path"] for r in rows.collect()) == ["a", "b"]
    assert snapshots.load(spark, at, 1)[0].count() == 1
    assert len(glob.glob(f"{tmp_path}/s/rows-*")) == 2  # a refused save leaves nothing
    assert snapshots.save(table(spark), at) == 3 and snapshots.load(spark, at)[0].count() == 0


@pytest.mark.parametrize("path", ["", " ", None, "/etc/x", "C:\\x", "a/../../b", "..\\b"])
def test_snapshots_refuse_paths(spark, tmp_path, path):
    with pytest.raises(snapshots.Refused, match="path"):
        snapshots.save(table(spark, "a", path), f"file://{tmp_path}/s")


def test_snapshots_refuse_repeats_and_changed_rows(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    with pytest.raises(snapshots.Refused, match="path"):
        snapshots.save(table(spark, "a", "a"), at)
    snapshots.save(table(spark, "a"), at)
    table(spark, "b").write.mode("append").parquet(glob.glob(f"{tmp_path}/s/rows-*")[0])
    with pytest.raises(snapshots.Refused, match="not the ones"):
        snapshots.load(spark, at)
