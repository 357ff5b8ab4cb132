"""Near-duplicate documents by MinHash: universal hash minima, banding, signature verification, exact confirmation,
and connected components of the confirmed links.

Documents with equal shingle sets form a class with one representative from the start, so copies never meet in pairs.
Within a bucket of a band no pairs are listed at first either: all members are compared with the most central one, then
with the most central one outside the bucket's largest component, as long as such rounds find links. What is open after
that - buckets whose members are in several components - meets in a join on the bucket that only yields pairs of
different components whose long one-bit signatures allow a link, each pair in the first band that it shares. All that is
yielded is confirmed on whole sets. So two linked representatives that share a bucket are always either compared or
already in one component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import BROADCAST_IDS, Scratch, Step, lean, slices, small_batches
from sediment.llm.common import cut as written
from sediment.llm.components import connected_components

#: Words of a shingle; bands and minima of a band. At a similarity of 0.75 a link shares no bucket with a probability
#: of (1 - 0.75 ** ROWS) ** BANDS = 2.5e-7, at 0.8 of 6e-10.
WORDS, BANDS, ROWS = 5, 40, 4
MINIMA = BANDS * ROWS
#: Share of equal minima from which sets are compared: 0.55 lies 5.8 standard deviations under 0.75.
SURE = 0.55
#: Bits of the signatures of open documents, and equal bits from which sets are compared: at a similarity of 0.75 a
#: share of 0.875 is expected, 5.5 standard deviations more.
BITS = 2048
EQUAL_BITS = int(BITS * 0.875 - 5.5 * (BITS * 0.875 * 0.125) ** 0.5)
#: Rounds with one more pivot a bucket go on while a pair in so many is a link.
WORTH = 64
#: Members of an open bucket that one task compares with the others.
SALT = 4096

#: Bytes of tables of ids, or of the pivots' signatures or texts, that are broadcast at most.
BROADCAST_BYTES = 16_000_000

_rng = np.random.default_rng(20)
_LETTER = _rng.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_PLACE = _rng.integers(0, 2**64, WORDS, np.uint64) | np.uint64(1)
_A, _B = (_rng.integers(0, 2**64, MINIMA + BITS, np.uint64) for _ in range(2))
_BAND = _rng.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_STEP = np.uint64(0x5851F42D4C957F2D)
_POWERS = np.cumprod(np.full(4096, _STEP, np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word (bytes other than the six ASCII white-space ones), A-Z as a-z."""
    b = np.frombuffer(data.lower(), np.uint8)
    space = _SPACE[b]
    if not len(b) or space.all():
        return np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    # the place of each byte within its word weighs it; a word's hash is the sum over its bytes
    first = np.zeros(len(b), np.int64)
    first[starts] = starts
    place = np.arange(len(b)) - np.maximum.accumulate(first)
    long = place >= len(_POWERS)
    weight = _POWERS[np.where(long, place % len(_POWERS), place)]
    if long.any():
        weight = np.where(long, _mixed(weight + place.astype(np.uint64)), weight)
    value = np.where(space, np.uint64(0), _LETTER[b] * weight)
    return _mixed(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; a text with fewer words is one shingle, without words
    none. Two different shingles of two documents of a million words share a hash with a probability under 1e-7."""
    w = word_hashes((text or "").encode())
    if not len(w):
        return w
    if len(w) < words:
        return _mixed((w * _PLACE[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    total = w[: len(w) - words + 1] * _PLACE[0]
    for k in range(1, words):
        total = total + w[k : len(w) - words + 1 + k] * _PLACE[k]
    return np.unique(_mixed(total))


def minima(shingles: np.ndarray, first: int = 0, n: int = MINIMA) -> np.ndarray:
    """``n`` minima, each of the images of the set under another universal hash: multiply-shift, the upper half of
    a x + b modulo 2 ** 64 for random a and b and the 32-bit x of a shingle."""
    x, out = shingles >> np.uint64(32), np.full(n, 2**64 - 1, np.uint64)
    a, b = _A[first : first + n], _B[first : first + n]
    step = max(1, 65536 // n)
    for at in range(0, len(x), step):
        np.minimum(out, (np.multiply.outer(a, x[at : at + step]) + b[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def bit_signature(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of BITS further minima, as longs: two sets agree in a bit with a probability of (1 + J) / 2."""
    low = (minima(shingles, MINIMA, BITS) & np.uint32(1)).astype(np.uint8)
    return np.packbits(low).view(np.int64)


def band_keys(found: np.ndarray) -> np.ndarray:
    return _mixed((found.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


_BIT_COLUMNS = [f"b{k}" for k in range(BITS // 64)]
_FEATURES = "doc_id long, tag long, n_shingles long, set_key binary, bands array<long>, signature binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            n, keys, bands, signatures = [], [], [], []
            for text in part.column(1).to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                if not len(s):
                    keys.append(None), bands.append(None), signatures.append(None)
                    continue
                m = minima(s)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(band_keys(m))
                signatures.append((m >> np.uint32(24) ^ m & np.uint32(0xFF)).astype(np.uint8).tobytes())
            columns = [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _FEATURES.split(", ")])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = [shingle_set(t).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, shingles`` with the bit signature in place of the set."""
    for batch in batches:
        if batch.num_rows:
            found = np.array([bit_signature(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in np.ascontiguousarray(found.T)]], ["id", *_BIT_COLUMNS])


def _bits_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, text`` with the bit signature in place of the text. Two steps in a row would each have a Python worker of its
    own in every task, which Spark keeps, and would send the sets through the JVM."""
    return _bits(_sets(batches))


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose set sizes and signatures allow the similarity."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
        sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, MINIMA) for k in (4, 5))
        keep = (100 * np.minimum(na, nb) >= 75 * np.maximum(na, nb)) & ((sa == sb).mean(axis=1) >= SURE)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def _confirmed(percent: int):
    """Pairs ``a, b`` whose texts ``x, y`` have sets that are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, x = np.zeros(batch.num_rows, bool), (), None
            for k in np.argsort(batch.column(0).to_numpy(), kind="stable").tolist():
                text = batch.column(2)[k].as_py()
                if last != (text,):  # a pivot's set is made once for its pairs
                    last, x = (text,), shingle_set(text)
                y = shingle_set(batch.column(3)[k].as_py())
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _of_pivots(pairs: DataFrame, table: DataFrame, weight: str, cut) -> DataFrame:
    """The rows of ``table`` for the pivots ``a`` of the pairs: broadcast if their column ``weight`` is small in all, so
    that no pair carries a copy of it through a shuffle; joined by a shuffle if not."""
    few = cut(table.join(_small(cut(pairs.select("a").distinct(), "pivotids")), "a", "left_semi"), "pivotrows")
    size = few.agg(F.sum(F.octet_length(weight))).first()[0] or 0
    return F.broadcast(few) if size <= BROADCAST_BYTES else few


def _small(table: DataFrame) -> DataFrame:
    """A written table of two or three longs a row, broadcast if it is small, so that what it is joined with stays in place."""
    return F.broadcast(table) if 16 * table.count() <= BROADCAST_BYTES else table


def _verified(pairs: DataFrame, features: DataFrame, cut) -> DataFrame:
    """The pairs (pivot a, member b) whose sizes and signatures allow a link."""
    sig = features.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    sig_a = features.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    both = sig.join(_small(pairs), "b").join(_of_pivots(pairs, sig_a, "sa", cut), "a").select("a", "b", "na", "nb", "sa", "sb")
    return cut(both.mapInArrow(lean(_likely), "a long, b long"), "likely")


def _links(likely: DataFrame, texts: DataFrame, percent: int, cut) -> DataFrame:
    """The pairs that are links, by their whole sets. Texts are moved, as they compress and hashes of shingles don't; the
    sets are made where they meet."""
    whole = texts.select(F.col("id").alias("b"), F.col("text").alias("y")).join(_small(likely), "b")
    whole = whole.join(_of_pivots(likely, texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "x", cut), "a").select("a", "b", "x", "y")
    return cut(whole.mapInArrow(lean(_confirmed(percent)), "a long, b long"), "links")


def _merged(labels: DataFrame | None, links: DataFrame, cut) -> DataFrame:
    """``id, component`` of what is linked to another one so far: the labels, with those merged that new links join."""
    if labels is None:
        return cut(connected_components(links, cut), "labels")
    ends = links
    for end in ("a", "b"):
        named = labels.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
        ends = ends.join(named, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    found = cut(connected_components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), cut), "merged")
    moved = labels.join(found.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left")
    moved = moved.select("id", F.coalesce("root", "component").alias("component"))
    fresh = found.join(labels.select("id"), "id", "left_anti").select("id", "component")
    return cut(moved.unionByName(fresh), "labels")


_MEMBER = ["bucket", "band", "id", "weight"]


def _open(members: DataFrame, labels: DataFrame, cut) -> DataFrame:
    """The members of buckets with several components, with their ``component``, the bucket's ``size`` and whether they
    are an ``outlier``: not in its largest component."""
    named = cut(members.join(_small(labels), "id", "left").select(*_MEMBER, F.coalesce("component", "id").alias("component")), "named")
    parts = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    several = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("top"))
    several = several.filter("k > 1").select("bucket", "size", F.col("top.component").alias("largest"))
    found = named.join(_small(cut(several, "several")), "bucket").withColumn("outlier", F.col("component") != F.col("largest"))
    return cut(found.drop("largest"), "open")


def _central(members: DataFrame, cut) -> DataFrame:
    """``bucket, a``: the member of each bucket that shares most buckets with most others."""
    best = members.groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("w"), "id")).alias("m"))
    return cut(best.select("bucket", F.col("m.id").alias("a")), "pivots")


def _likely_in_buckets(members: DataFrame, features: DataFrame, sets: DataFrame, cut, step: Step = _bits) -> DataFrame:
    """The pairs of open buckets' members in different components whose sizes and bit signatures allow a link, each
    once; ``step`` makes signatures of the members' ``sets``. The members of a large bucket are dealt into parts, each of
    which meets the whole bucket in a task."""
    own = members.groupBy("id").agg(F.collect_list(F.struct("band", "bucket")).alias("own"))  # BANDS at most
    bits = sets.mapInArrow(lean(step), "id long, " + ", ".join(f"{c} long" for c in _BIT_COLUMNS))
    profile = cut(features.select("id", "n_shingles").join(bits, "id").join(own, "id"), "profiles")
    parts = F.ceil(F.col("size") / F.lit(SALT)).cast("int")
    earlier = F.transform(F.filter("own", lambda o: o["band"] < F.col("band")), lambda o: o["bucket"])
    wide = members.select("bucket", "band", "id", "component", parts.alias("parts")).join(profile, "id")
    wide = cut(wide.withColumn("earlier", earlier).drop("own", "band"), "wide")
    x = wide.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("x")
    y = wide.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    on = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.id") < F.col("y.id"))
    on &= F.col("x.component") != F.col("y.component")
    low, high = F.least("x.n_shingles", "y.n_shingles"), F.greatest("x.n_shingles", "y.n_shingles")
    unequal = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _BIT_COLUMNS), F.lit(0))
    on &= (100 * low >= 75 * high) & (unequal <= BITS - EQUAL_BITS)
    on &= ~F.arrays_overlap("x.earlier", "y.earlier")
    return cut(x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "likely")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Words are runs of other than ASCII white space, A-Z as a-z; a document's set holds its distinct five-word shingles,
    or its whole sequence if it has fewer words. Documents are linked when 100 x intersection >= ``percent`` x union
    (75 or more, for which the bands are laid out), confirmed on whole sets; ``component_id`` is the smallest id that
    links reach, and a row is kept if that is its own. A null, empty or blank text has no shingles and no links. Rows
    that share an id are one document, with the links of all of them; rows with a null id are not linked (component
    null) and kept. Other columns are ignored; an empty table gives an empty result.
    """
    if percent < 75:
        raise ValueError("the bands are laid out for similarities of 75 percent or more")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession), Scratch(docs.sparkSession) as scratch:
        cut = scratch.cut
        rows = cut(chosen.withColumn("tag", F.monotonically_increasing_id()).mapInArrow(lean(_features), _FEATURES), "features")
        linked = rows.filter("doc_id is not null and set_key is not null")
        first = F.min(F.struct(F.col("doc_id").alias("id"), "tag")).alias("f")
        classes = cut(linked.groupBy("set_key").agg(first).select("set_key", "f.id", F.col("f.tag").alias("first")), "classes")
        # copies leave, by a broadcast where their number allows it, so that no signature is moved
        copies = cut(linked.select("tag", "set_key").join(classes, "set_key").filter("tag != first").select("tag"), "copies")
        few = copies.count() <= BROADCAST_IDS
        features = linked.join(F.broadcast(copies) if few else copies, "tag", "left_anti").select(F.col("doc_id").alias("id"), "n_shingles", "signature", "bands")
        repeated = linked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
        owners = linked.select("doc_id", "set_key").join(repeated, "doc_id").join(classes, "set_key").filter("doc_id != id")
        owners = cut(owners.select(F.col("doc_id").alias("a"), F.col("id").alias("b")), "owners")

        buckets = features.select("id", F.posexplode("bands").alias("band", "bucket"))
        shared = cut(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
        sized = cut(buckets.join(F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared, "bucket"), "sized")
        weights = cut(sized.groupBy("id").agg(F.sum("n").alias("weight")), "weights")
        members = cut(sized.join(_small(weights), "id").select(*_MEMBER), "members")
        scratch.drop(sized)
        texts = cut(_texts(chosen, weights).select(F.col("doc_id").alias("id"), "text"), "texts")

        labels, pivots = None, _central(members, cut)
        met = members.join(_small(pivots), "bucket").filter("id != a")
        while True:
            pairs = cut(met.select("a", F.col("id").alias("b")).distinct(), "pairs")
            links = _links(_verified(pairs, features, cut), texts, percent, cut)
            labels = _merged(labels, links if labels is not None else links.unionByName(owners), cut)
            # a pivot has met all others of its bucket and is done with it
            done = pivots.select("bucket", F.col("a").alias("id"))
            rest = _open(members.join(_small(done), ["bucket", "id"], "left_anti"), labels, cut)
            if rest.isEmpty() or WORTH * links.count() < pairs.count():
                break
            members = rest.select(*_MEMBER)
            pivots = _central(rest.filter("outlier"), cut)
            named = rest.select("bucket", F.col("id").alias("a"), F.col("component").alias("ca")).join(pivots, ["bucket", "a"])
            met = rest.join(named, "bucket").filter("component != ca")
        if not rest.isEmpty():
            still = texts.join(_small(cut(rest.select("id").distinct(), "openids")), "id", "left_semi")
            labels = _merged(labels, _links(_likely_in_buckets(rest, features, still, cut, _bits_of_texts), texts, percent, cut), cut)

        named = cut(classes.join(labels, "id", "left").select("set_key", F.coalesce("component", "id").alias("component")), "named")
        own = F.coalesce("component", "doc_id")
        found = rows.join(named, "set_key", "left").select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
            F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
        )
        return written(found, "near")


def _texts(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """The rows of the candidate ids, which are broadcast if their number allows it, else joined by a shuffle."""
    keys = candidates.select(F.col("id").alias("doc_id"))
    return chosen.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, "doc_id", "left_semi")
