"""Best-fit packing of token sequences by hierarchical residual packing.

Every input partition packs its own pieces by best fit, longest first. Bins that no other open bin can still fill are
done; the others become items themselves and are merged over ever fewer partitions in repeated best-fit rounds, until
one partition has seen all of them or nothing fits any more. Where rounds over several partitions have stopped to help,
the root of the tree packs classes of equally full bins: it sees only how many there are of each size, so it works on
all of them at once, and bins take the places of their class by rank. So the end is the same at every size: no two open
bins fit together. Texts and ids stay where they were read: what moves is a few numbers for each open bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.llm.common import cut, lean, slices, small_batches
from sediment.llm.tokens import MEMORY, encoder

#: Pieces that a partition packs at a time, and open bins that one task of a later round takes.
BLOCK, ITEMS_PER_TASK = 200_000, 50_000
#: Where memory is scarce: bytes of a batch of texts, as both the JVM and the encoder hold some times as much, and of remembered units.
SMALL, FEW = 1_000_000, 20_000_000
#: Share of the bins that a round over several tasks may leave for another one to follow; then the root packs the rest.
WORTH = 0.98


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item, in the given order, its bin (from 0) and its offset there, and for each bin what it holds:
    longest items first, each into the fullest bin that still takes it. The free rooms that exist are the bits of one
    integer, so finding a bin costs a shift."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: dict[int, list[int]] = {}
    present, held = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = present >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                present &= ~(1 << room)
        else:
            room, b = capacity, len(held)
            held.append(0)
        bins[i], offsets[i] = b, capacity - room
        held[b] = capacity - room + n
        if left := room - n:
            rooms.setdefault(left, []).append(b)
            present |= 1 << left
    return bins, offsets, np.array(held, np.int64)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, held long"
_OPEN = "bin long, parent long, base long, held long"


def _packer(path: str, end_id: int, capacity: int, memory: int = MEMORY):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(path, memory), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        made, rows = 0, []

        def packed() -> pa.RecordBatch:
            nonlocal made
            piece, start, length, crc = (np.array(x, np.int64) for x in zip(*(r[1:] for r in rows), strict=True))
            bins, offsets, held = best_fit(length, capacity)
            out = [pa.array([r[0] for r in rows], pa.int64()), piece.astype(np.int32), start, length, crc, bins + (made + (task << 36)), offsets, held[bins]]
            made += len(held)
            rows.clear()
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], [c.split()[0] for c in _PIECES.split(", ")])

        for batch in batches:
            for part in slices(batch):
                for doc, ids in zip(part.column(0).to_pylist(), known.ids(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        one = ids[at : at + 4 * capacity]
                        rows.append((doc, piece, at // 4, len(one) // 4, zlib.crc32(one)))
                    if len(rows) >= BLOCK:
                        yield packed()
        if rows:
            yield packed()

    return pack


def _merger(capacity: int, level: int):
    def merge(frames):
        import pandas as pd

        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        items = [f for f in frames if len(f)]
        if items:
            all_ = pd.concat(items).sort_values(["held", "bin"])
            bins, offsets, held = best_fit(all_["held"].to_numpy(), capacity)
            parent = bins + ((level << 56) + (task << 36))
            yield pd.DataFrame({"bin": all_["bin"].to_numpy(), "parent": parent, "base": offsets, "held": held[bins]})

    return merge


def best_fit_classes(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit of items of which only the number of each size is known, longest first: rows ``held, first, n, bin,
    offset``, by which the items ``first`` to ``first + n - 1`` of size ``held`` go to the bins ``bin`` to
    ``bin + n - 1`` at ``offset``. Bins that are filled alike are one entry, so the work depends on the number of sizes."""
    rooms: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = {}  # free room: (bins, (size, first item, offset) of each place)
    present, full = 0, []
    for size in sorted(counts, reverse=True):
        first, left = 0, counts[size]
        while left:
            fits = present >> size
            room, n, places = capacity, left, []
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                n, places = rooms[room].pop()
            have, deep = n, room // size  # the fullest bin that takes an item takes the next one, too
            n, deep = (min(n, left // deep), deep) if left >= deep else (1, left)
            if fits:
                if n < have:
                    rooms[room].append((have - n, [(s, f + n, o) for s, f, o in places]))
                if not rooms[room]:
                    present &= ~(1 << room)
            places = [*places, *((size, first + k * n, capacity - room + k * size) for k in range(deep))]
            if room == deep * size:
                full.append((n, places))
            else:
                rooms.setdefault(room - deep * size, []).append((n, places))
                present |= 1 << (room - deep * size)
            first, left = first + deep * n, left - deep * n
    out, made = [], 0
    for n, places in [*full, *(g for gs in rooms.values() for g in gs)]:
        out += [(s, f, n, made, o) for s, f, o in places]
        made += n
    return out


def _by_classes(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """``bin, parent, base`` of all items, by best fit of their classes. What reaches the driver is a count a size; an
    item's rank in its class comes from the class's counts by partition."""
    spark = items.sparkSession
    dealt = cut(items.select("bin", "held", F.spark_partition_id().alias("part")), "items")
    counts = cut(dealt.groupBy("part", "held").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = Window.partitionBy("held").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = counts.select("part", "held", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    sizes = {r["held"]: r["n"] for r in counts.groupBy("held").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = spark.createDataFrame(best_fit_classes(sizes, capacity), "held long, first long, n long, number long, base long")
    rank = F.row_number().over(Window.partitionBy("part", "held").orderBy("bin")) - 1
    ranked = dealt.withColumn("rank", rank).join(starts, ["part", "held"]).select("bin", "held", (F.col("rank") + F.col("start")).alias("rank"))
    # some entries a size
    found = ranked.join(F.broadcast(places), "held").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    return found.select("bin", (F.col("number") + F.col("rank") - F.col("first") + F.lit(level << 56)).alias("parent"), "base")


def _mergeable(open_bins: DataFrame, capacity: int) -> DataFrame | None:
    """The open bins that some other open bin can still fill; None if there is none. The emptiest one stays, as it is
    what the others are measured by; the others are done."""
    low = open_bins.groupBy("held").count().orderBy("held").limit(2).collect()  # two sizes
    if not low:
        return None
    least = low[0]["held"]
    second = least if low[0]["count"] > 1 else low[1]["held"] if len(low) > 1 else capacity
    if least + second > capacity:
        return None
    return open_bins.filter(F.col("held") + F.lit(least) <= capacity)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Pack the token ids of every row's whole text, followed by ``end_id``, into sequences of ``capacity`` tokens.

    ``tokenizer`` is the path of a tokenizers file that every executor has. Only documents of more than ``capacity``
    tokens are cut, into full pieces and a last shorter one. Returns, a row a piece, ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset``. A null or empty text is one piece with the end id alone; repeated rows are
    packed each for itself; a null id stays null; other columns are ignored; an empty table gives no rows.
    Python workers ``keep`` the tokenizer and its memory of words for later tasks, or load it anew for each and get texts in
    small batches, for executors whose memory earlier steps have filled.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with nullcontext() if keep else small_batches(spark, SMALL):
        pieces = cut(chosen.mapInArrow(lean(_packer(tokenizer, end_id, capacity, MEMORY if keep else FEW), before=False, after=not keep), _PIECES), "pieces")
    open_bins = pieces.filter((F.col("offset") == 0) & (F.col("held") < capacity)).select("bin", "held")
    placed: DataFrame | None = None
    level, last = 1, None
    while True:
        items = _mergeable(open_bins, capacity)
        n = items.count() if items is not None else 0
        if not n:
            break
        tasks = -(-n // ITEMS_PER_TASK)
        root = tasks == 1 or last is not None and n > WORTH * last
        if tasks > 1 and root:
            step = cut(_by_classes(items, capacity, level), "root")
        else:
            merged = cut(items.repartition(tasks).mapInPandas(_merger(capacity, level), _OPEN), f"round{level}")
            step = merged.select("bin", "parent", "base")
        if placed is None:
            placed = step
        else:
            later = step.select(F.col("bin").alias("parent"), F.col("parent").alias("_parent"), F.col("base").alias("_base"))
            placed = placed.join(later, "parent", "left").select(
                "bin", F.coalesce("_parent", "parent").alias("parent"), (F.col("base") + F.coalesce("_base", F.lit(0))).alias("base")
            )
        if root:
            break
        open_bins = merged.filter((F.col("base") == 0) & (F.col("held") < capacity)).select(F.col("parent").alias("bin"), "held")
        level, last = level + 1, n
    if placed is None:
        placed = spark.createDataFrame([], "bin long, parent long, base long")
    return pieces.join(cut(placed, "places"), "bin", "left").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("parent", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
