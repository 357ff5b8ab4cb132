"""Near-duplicate documents by SimHash fingerprints, candidates by pigeonring filtering.

Two fingerprints of 64 bits that differ in at most two bits are cut into three segments on a ring. The budget of a chain
of l consecutive segments is floor(2 l / 3) differing bits: none over one, one over two, two over all three. Some segment
begins a chain that keeps every one of these budgets (else the differences around the ring would add up to more than two).
So candidates are pairs with an equal segment and at most one differing bit in the next one. As both make up the key of an
equi-join (43 of 64 bits; one side also asks with each clear bit of the second segment set), no pair of documents that only
share a segment ever meets; the full Hamming distance is the join's condition, and a pair counts at its first such chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import BROADCAST_IDS, Scratch, slices
from sediment.llm.common import cut as written
from sediment.llm.components import connected_components

#: Words of a shingle, seed of its hash, and differing bits of a link.
WORDS, SEED, BITS = 3, 42, 2
#: First bit of each segment; the fourth is the end.
_EDGES = (0, 22, 43, 64)
#: Shingles whose bits are counted at once.
_STEP = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_SEGMENT = [(1 << b) - (1 << a) for a, b in zip(_EDGES, _EDGES[1:], strict=False)]


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text in UTF-8 (unsigned): a bit is set if more than half of the shingle hashes have it."""
    found = data.lower().split()
    if not found:
        return 0
    joined, width = b" ".join(found), min(words, len(found))
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - width + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], "<u8").view(np.uint8).reshape(-1, 8)
    total = sum(np.unpackbits(h[at : at + _STEP], axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for at in range(0, len(h), _STEP))
    return int.from_bytes(np.packbits(2 * total > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = np.array([fingerprint(t or b"") for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "fp"])


def _bits(fp: Column, mask: int) -> Column:
    return fp.bitwiseAND(F.lit(_signed(mask)))


def _viable(i: int, d: Column) -> Column:
    """Whether the chain that begins at segment ``i`` keeps its budgets, given the differing bits."""
    return (_bits(d, _SEGMENT[i]) == 0) & (F.bit_count(_bits(d, _SEGMENT[(i + 1) % 3])) <= 1)


def _chains(classes: DataFrame) -> DataFrame:
    """A row for each class and start of a chain, with the bits of the first two segments as ``key``."""
    keys = [F.struct(F.lit(i).alias("start"), _bits(F.col("fp"), _SEGMENT[i] | _SEGMENT[(i + 1) % 3]).alias("key")) for i in range(3)]
    return classes.select("*", F.explode(F.array(*keys)).alias("c")).select(*classes.columns, "c.*")


def _asked(chains: DataFrame) -> DataFrame:
    """The chains with the keys to look up: their own, and those with one clear bit of the second segment set."""
    second = [[F.lit(_signed(1 << b)) for b in range(_EDGES[(i + 1) % 3], _EDGES[(i + 1) % 3 + 1])] for i in range(3)]
    ones = F.element_at(F.array(*[F.array(*x) for x in second]), F.col("start") + 1)
    flipped = F.transform(F.filter(ones, lambda b: F.col("key").bitwiseAND(b) == 0), lambda b: F.col("key").bitwiseOR(b))
    return chains.withColumn("ask", F.explode(F.concat(F.array("key"), flipped)))


def _links(chains: DataFrame) -> DataFrame:
    """Linked pairs of classes in different components (column ``component``), each once."""
    x, y = _asked(chains).alias("x"), chains.alias("y")
    d = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    first = (F.col("x.start") == 0) | ~_viable(0, d) & ((F.col("x.start") == 1) | ~_viable(1, d))
    once = (F.col("x.ask") != F.col("x.key")) | (F.col("x.fp") < F.col("y.fp"))
    on = (F.col("x.start") == F.col("y.start")) & (F.col("x.ask") == F.col("y.key")) & once
    on &= (F.col("x.component") != F.col("y.component")) & (F.bit_count(d) <= BITS) & first
    return x.join(y, on).select(F.col("x.component").alias("a"), F.col("y.component").alias("b"))


def _hung(chains: DataFrame) -> DataFrame:
    """Links of each class with the most frequent one of its own key, where they are links: a row a class and chain, so
    that near copies in thousands hang together before pairs are looked for."""
    best = chains.groupBy("start", "key").agg(F.max(F.struct("n", "fp", "id")).alias("top"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    near = (F.col("id") != F.col("top.id")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("top.fp"))) <= BITS)
    return chains.join(best, ["start", "key"]).filter(near).select(F.col("top.id").alias("a"), F.col("id").alias("b"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Words are runs of other than ASCII white space, A-Z as a-z; a text's shingles are its three-word sequences, repeats
    included (its whole sequence if it has fewer words), hashed by XXH64. Documents whose fingerprints differ in two bits
    or fewer are linked; ``component_id`` is the smallest id that links reach, itself included. A null, empty or blank
    text has the fingerprint zero and is linked like any other. Equal fingerprints form a class, of which only one row
    takes part in the search. Rows that share an id are one document, with the links of all of them; rows with a null id
    get a fingerprint, but are not linked (component null). Other columns are ignored; an empty table gives no rows.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        cut = scratch.cut
        rows = cut(chosen.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
        known = rows.filter("doc_id is not null")
        classes = cut(known.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
        repeated = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
        owners = known.join(repeated, "doc_id").join(classes.select("fp", "id"), "fp").filter("doc_id != id")
        hung = _hung(_chains(classes)).unionByName(owners.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
        first = cut(connected_components(hung, cut), "hung")
        named = cut(classes.join(first, "id", "left").withColumn("component", F.coalesce("component", "id")), "named")
        links = _links(_chains(named.select("component", "fp")))
        merged = cut(connected_components(links, cut), "merged").select(F.col("id").alias("component"), F.col("component").alias("root"))
        found = cut(named.join(merged, "component", "left").select("fp", F.coalesce("root", "component").alias("component")), "components")
        few = found.count() <= BROADCAST_IDS
        out = rows.join(F.broadcast(found) if few else found, "fp", "left")
        return written(
            out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")),
            "simhash",
        )
