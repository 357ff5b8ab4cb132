"""Helpers that the corpus operators share: lineage cuts, order prefixes and Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.llm import tokens
from sediment.shared import cut, delete, new_path

__all__ = ["BROADCAST_IDS", "CHUNK_CHARS", "Scratch", "Step", "bases", "cut", "delete", "kept_rows", "lean", "new_path", "shuffle_partitions", "slices", "small_batches"]

#: Characters of text that one pass over an Arrow batch works on at most (a longer text forms a pass of its own).
CHUNK_CHARS = 4_000_000


#: Bytes of the Arrow batches of steps whose rows hold whole documents or their sets.
BATCH_BYTES = 8_000_000


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Within the block, batches for Python are of about ``size`` bytes at most: a worker holds some copies of each. Only
    what is planned within the block is held to it; the session has its own setting again afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None)
    spark.conf.set(key, str(min(size, int(own)) if own and own.isdigit() and int(own) > 0 else size))
    try:
        yield
    finally:
        spark.conf.set(key, own) if own else spark.conf.unset(key)


def _given_back() -> None:
    """Memory that is free within this process goes back to the machine."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(step: Step, before: bool = True, after: bool = False) -> Step:
    """A step for ``mapInArrow`` that gives back what it took at its end. Spark keeps a Python worker for later tasks, with
    all that it holds, and lets all that it keeps take turns - more than there are cores, where earlier stages had
    several steps in one task. ``before``: the step needs no tokenizer and drops the encoder of an earlier one;
    ``after``: it drops its own, so no more workers have one than tasks run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if before:
            tokens.forget()
        try:
            yield from step(batches)
        finally:
            if after:
                tokens.forget()
            _given_back()

    return run


class Scratch:
    """Tables that cut lineage as ``cut`` does and are deleted at the end of the ``with`` block, or earlier by ``drop``.
    What is used after the block must be written elsewhere before it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n, self.paths = spark, new_path(spark, "scratch"), 0, {}

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:04d}-{tag}"
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(found)] = (found, path)
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this scratch folder that no later query reads."""
        for t in tables:
            delete(self.spark, self.paths.pop(id(t))[1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.root)


#: Ids of dropped documents that are broadcast at most (8 bytes each); more are told apart by a shuffle join.
BROADCAST_IDS = 2_000_000


def kept_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id has a kept row in ``decided`` (``doc_id, kept``). Ids that
    are not in ``decided`` stay.

    The ids to drop are broadcast where their number allows it, so that no text is moved; more of them are joined by a
    shuffle. A null id is an id of its own.
    """
    gone = decided.groupBy("doc_id").agg(F.max("kept").alias("_any")).filter(~F.col("_any")).select(F.col("doc_id").alias("_gone"))
    gone = cut(gone, "dropped")
    few = gone.count() <= BROADCAST_IDS
    null_gone = few and not gone.filter("_gone is null").isEmpty()
    match = docs[id_col].cast("long") == gone["_gone"] if few else docs[id_col].cast("long").eqNullSafe(gone["_gone"])
    kept = docs.join(F.broadcast(gone) if few else gone, match, "left_anti")
    return kept.filter(F.col(id_col).isNotNull()) if null_gone else kept


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bases(totals: DataFrame, part: str, *sums: str) -> DataFrame:
    """For each row of ``totals`` (one row a partition, so as many rows as partitions), the sums of all rows before it."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, *[F.coalesce(F.sum(s).over(before), F.lit(0)).cast("long").alias(f"{s}_base") for s in sums])


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about CHUNK_CHARS of text each, so that long texts don't add up."""
    column, start, held = batch.column(batch.schema.get_field_index(text)), 0, 0
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, n in enumerate(sizes):
        if held and held + n > CHUNK_CHARS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
