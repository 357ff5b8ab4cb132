"""Streams: events in time windows, and repository snapshots of which only what changed is analysed again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sediment.shared import new_path


def windowed(events: DataFrame, when: str = "ts", what: str = "event_type", value: str = "value", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``started, event_type, n, total`` of a stream or table of events, by window; a stream drops what comes later
    than ``late``."""
    events = events.withColumn(when, F.col(when).cast("timestamp"))
    rows = events.withWatermark(when, late) if events.isStreaming else events
    out = rows.groupBy(F.window(when, length).alias("w"), what).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total"))
    return out.select(F.col("w.start").alias("started"), what, "n", "total")


def windowed_batch(spark: SparkSession, path: str) -> DataFrame:
    """All events of a Parquet table run through the stream once, into a table that is returned. The run may meet events
    in any order, so nothing counts as late; each batch writes the windows that it changed."""
    base = new_path(spark, "stream")
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(folder)
    out = windowed(stream, late="10000 days")

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces what it wrote before
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/number={number}")

    done = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    # of a window that several batches updated, the last state
    return rows.groupBy("started", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("started", "event_type", "x.n", "x.total")


#: Columns of a file version as it arrives; ``gone`` says that the file was deleted.
VERSION = "path string, seq long, mtime timestamp, sha256 string, gone boolean, content string"
#: What a version that changed nothing, and a path without a file, are called.
CHANGED = ("new", "modified")
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Signatures(StatefulProcessor):
    """The signature of each path. A deleted path leaves a tombstone, so that a version that arrives late does not bring
    it back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", "seq long, at long, sha256 string, version long")
        self.tomb = handle.getValueState("tomb", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: r["seq"])  # one row is kept at a time, whatever the number of versions
        old = self.live.get() if self.live.exists() else None
        last = old[0] if old else self.tomb.get()[0] if self.tomb.exists() else None
        seq, at, sha = newest["seq"], newest["_at"], newest["sha256"]
        if last is not None and seq <= last:
            return
        version = old[3] if old else None
        if newest["gone"]:
            self.live.clear()
            self.tomb.update((seq,))
            if old is None:
                return
            state = "deleted"
        else:
            state = "new" if old is None else "modified" if old[2] != sha else "unmodified" if old[1] == at else "touched"
            version = seq if state in CHANGED else version
            self.live.update((seq, at, sha, version))
            if old is None and last is not None:
                self.tomb.clear()
        # what is not analysed again needs no text
        text = newest["content"] if state in CHANGED else None
        yield Row(path=newest["path"], seq=seq, _at=at, sha256=sha, gone=newest["gone"], content=text, state=state, version=version)

    def close(self) -> None:
        pass


def changed_versions(versions: DataFrame) -> DataFrame:
    """``path, seq, mtime, sha256, gone, content, state, version`` of a stream of file versions (VERSION): in each batch,
    the newest version of a path against the last one that the stream saw - new, modified, touched (another time, the same
    content), unmodified or deleted. ``version`` is the ``seq`` of the content that is now in force (of a deleted file: that
    was). A version that is not newer than the last one, and the deletion of what isn't there, give no row.

    The state is a signature a path (of a deleted one its ``seq``), in RocksDB; nothing in it expires, as a run that has
    something to expire would not end. Rows without a path or a ``seq`` are left out; of several rows with the same path
    and ``seq`` one counts.
    """
    names = [c.split()[0] for c in VERSION.split(", ")]
    rows = versions.select(*names).filter("path is not null and seq is not null")
    rows = rows.withColumn("gone", F.coalesce("gone", F.lit(False))).withColumn("_at", F.unix_micros("mtime")).drop("mtime")
    out = VERSION.replace("mtime timestamp", "_at long") + ", state string, version long"
    found = rows.groupBy("path").transformWithState(_Signatures(), out, "append", "none")
    return found.select(*[F.timestamp_micros("_at").alias("mtime") if n == "mtime" else n for n in names], "state", "version")


def keep_analysed(versions: DataFrame, analyse: Callable[[DataFrame], DataFrame], sink: str) -> StreamingQuery:
    """Analyse what is new or modified in a stream of file versions, and nothing else: runs over what there is, and goes
    on from there when it is called again.

    ``analyse`` maps rows of ``changed_versions`` to findings with ``path``. Each batch adds findings with the version of
    their file, and the versions with their states, under ``sink``; a batch that is run again replaces its own. What an old
    version gave is never sought and deleted: ``analysed`` joins findings to the versions in force.
    """
    spark = versions.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.select("path", "seq", "version", "state").write.mode("overwrite").parquet(f"{sink}/versions/batch={number}")
            fresh = batch.filter(F.col("state").isin(*CHANGED))
            analyse(fresh).join(fresh.select("path", "version"), "path").write.mode("overwrite").parquet(f"{sink}/findings/batch={number}")
        finally:
            batch.unpersist()

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, _ROCKS)  # a query takes the settings of its start
    try:
        return changed_versions(versions).writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", f"{sink}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)


def versions_in_force(spark: SparkSession, sink: str) -> DataFrame:
    """``path, seq, version, state``: the last word on each path that is there."""
    rows = spark.read.parquet(f"{sink}/versions")
    last = rows.groupBy("path").agg(F.max_by(F.struct("seq", "version", "state"), "seq").alias("x")).select("path", "x.*")
    return last.filter("state != 'deleted'")


def analysed(spark: SparkSession, sink: str) -> DataFrame:
    """The findings of the versions in force, of the whole table that ``keep_analysed`` keeps."""
    return spark.read.parquet(f"{sink}/findings").drop("batch").join(versions_in_force(spark, sink).select("path", "version"), ["path", "version"], "left_semi")
