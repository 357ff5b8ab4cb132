"""Contiguous shards of near-equal byte size, by global prefix sums.

Rows are ordered by id. Each range partition adds up its bytes, the running sum of these totals (one row a partition)
gives every partition its base, and a running sum within the partition gives every row its place in the whole. The
whole is cut at equal targets: a row belongs to the shard that holds the middle of its bytes, so each shard misses its
target by half a row at either end at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.llm.common import bases, cut, shuffle_partitions


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Assign every row of ``docs`` to one of ``n_shards`` contiguous shards; other columns are ignored.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: size is the text's UTF-8 bytes plus
    ``overhead`` (a null text has no bytes and the checksum of none), slot counts from 0 within the shard in id order,
    ``law`` is ``bytes`` and ``grown_shard`` null. Null ids come first; rows with equal ids stand side by side, ordered
    by size and checksum, and each keeps a slot of its own. An empty table gives an empty result. Only id, size and
    checksum are moved, never a text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = ["doc_id", "size", "text_crc32", "_tie"]
    # the range bounds come from a sample, so the partition numbers are written down before they are used twice
    ranged = cut(narrow.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    total = max(1, totals.agg(F.sum("bytes")).first()[0] or 1)
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("bytes_base")
    row = F.count(F.lit(1)).over(within) + F.col("rows_base")
    placed = ranged.join(F.broadcast(bases(totals, "_part", "bytes", "rows")), "_part").select(
        "doc_id", "size", "text_crc32", before.alias("_before"), row.alias("_row")
    )
    middle = F.expr(f"(2 * _before + size) * {int(n_shards)}L div {2 * total}L")
    placed = placed.withColumn("shard", F.least(middle, F.lit(n_shards - 1)).cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> DataFrame:
    """Write every row of ``docs`` as Parquet under ``path``, one folder a shard, and return the assignment.

    Rows meet their shard by id (null or not), size and checksum; rows that share all three are counted off, so each is
    written once. ``shard_col`` names the folders and must not be a column of ``docs``."""
    if shard_col in docs.columns:
        raise ValueError(f"docs has a column {shard_col}; name another one for the folders")
    found = cut(shard_documents(docs, n_shards, id_col, text_col), "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = ["_id", "_size", "_crc"]
    alike = Window.partitionBy(*keys).orderBy("_size")
    own = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"))
    own = own.withColumn("_n", F.row_number().over(alike)).alias("d")
    placed = found.select(F.col("doc_id").alias("_id"), (F.col("size") - 8).alias("_size"), F.col("text_crc32").alias("_crc"), F.col("shard").alias("_shard"))
    placed = placed.withColumn("_n", F.row_number().over(alike)).alias("s")
    same = F.col("d._id").eqNullSafe(F.col("s._id"))
    for c in ("_size", "_crc", "_n"):
        same = same & (F.col(f"d.{c}") == F.col(f"s.{c}"))
    own.join(placed, same).select("d._row.*", F.col("s._shard").alias(shard_col)).write.partitionBy(shard_col).parquet(path)
    return found
