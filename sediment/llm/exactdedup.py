"""Exact deduplication by content-defined chunk recipes.

A text (white-space runs made one space) is cut where a rolling hash of its last bytes says so, hence equal texts are
cut alike wherever they stand. Each distinct chunk is moved once per task that holds it, to be compared byte by byte
with the chunks of the same hash and get a verified identifier; a document is the ordered list of its chunks'
identifiers, and documents are compared by these lists alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.llm.common import cut, lean, slices

#: Bytes that a boundary depends on; least, mean (a power of two, above the least) and most bytes of a chunk.
WINDOW, LEAST, MEAN, MOST = 16, 512, 4096, 65536
#: A random odd multiplier of the rolling hash, and the odd one that spreads bytes.
_ROLL, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def normalized(text: Column) -> Column:
    """Null as empty, and each run of the six ASCII white-space characters as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def boundaries(data: bytes) -> list[int]:
    """The ends of the chunks of ``data``; a function of its bytes alone. Empty data has no chunk."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * _SPREAD
    power, span = _ROLL, 1
    while span < WINDOW:  # the hash of 2k bytes from those of k
        h[span:] = h[span:] + h[:-span] * np.uint64(power)
        power, span = power * power % 2**64, 2 * span
    found, out, last = np.flatnonzero(h >> np.uint64(64 - MEAN.bit_length() + 1) == 0) + 1, [], 0
    for end in [*found.tolist(), n]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST or end == n and end > last:
            out.append(end)
            last = end
    return out


def _recipes(hash_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                shas, recipes = [], []
                for text in part.column(1).to_pylist():
                    data, last, ids = text.encode(), 0, []
                    for end in boundaries(data):
                        ids.append(hashlib.blake2b(data[last:end], digest_size=hash_bytes).digest())
                        last = end
                    shas.append(hashlib.sha256(data).hexdigest())
                    recipes.append(b"".join(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shas), pa.array(recipes, pa.binary())], ["doc_id", "text_sha256", "recipe"])

    return run


def _chunks(hash_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found: dict[bytes, set[bytes]] = {}
                for text in part.column(0).to_pylist():
                    data, last = text.encode(), 0
                    for end in boundaries(data):
                        chunk, last = data[last:end], end
                        found.setdefault(hashlib.blake2b(chunk, digest_size=hash_bytes).digest(), set()).add(chunk)
                pairs = [(h, c) for h, cs in found.items() for c in cs]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["hash", "chunk"])

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bytes: int = 16) -> DataFrame:
    """For every row of ``docs``, the rows of equal text: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of ASCII white space is one space; a null text is empty.
    ``keep_id`` is the smallest id of the group (null only if the group has no other), and a row is kept if it has that
    id, so rows that repeat one id are kept together. ``hash_bytes`` is the width of a chunk's hash; should two chunks
    share one, their bytes tell them apart. Other columns are ignored; an empty table gives an empty result.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalized(F.col(text_col)).alias("text"))
    recipes = cut(chosen.mapInArrow(lean(_recipes(hash_bytes)), "doc_id long, text_sha256 string, recipe binary"), "recipes")
    chunks = chosen.select("text").mapInArrow(lean(_chunks(hash_bytes)), "hash binary, chunk binary")
    # equal bytes under one hash: its identifier is verified
    clashes = cut(chunks.groupBy("hash").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).filter("low != high").select("hash"), "clashes")
    if clashes.isEmpty():
        named, names = recipes, ["recipe"]
    else:
        named, names = _numbered(chosen, recipes, clashes, hash_bytes), ["recipe", "numbers"]
    groups = cut(named.groupBy(*names).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, names).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _numbered(chosen: DataFrame, recipes: DataFrame, clashes: DataFrame, hash_bytes: int) -> DataFrame:
    """Recipes with the numbers of their clashing chunks: the distinct chunks of a clashing hash are compared in full
    and numbered, and a recipe's numbers are listed by position (none: an empty list)."""

    def at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for sha, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data, last = text.encode(), 0
                    for position, end in enumerate(boundaries(data)):
                        chunk, last = data[last:end], end
                        rows.append((sha, position, hashlib.blake2b(chunk, digest_size=hash_bytes).digest(), chunk))
                kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["text_sha256", "position", "hash", "chunk"])

    # the digest serves as a row key here; the bytes of the chunks decide
    texts = chosen.select(F.sha2("text", 256).alias("text_sha256"), "text")
    placed = cut(texts.mapInArrow(lean(at), "text_sha256 string, position int, hash binary, chunk binary").join(clashes, "hash", "left_semi").distinct(), "clashing")
    numbers = placed.select("hash", "chunk").distinct().withColumn("number", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")))
    lists = placed.join(numbers, ["hash", "chunk"]).groupBy("text_sha256").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "number"))), lambda x: x["number"].cast("string")), ",").alias("numbers")
    )
    named = recipes.join(cut(lists, "numbers"), "text_sha256", "left")
    return cut(named.withColumn("numbers", F.coalesce("numbers", F.lit(""))), "named")
