"""Document fingerprints by a homomorphic multiset hash, from SQL functions alone.

Each paragraph (the text between line breaks) is hashed to a wide vector, and a text's fingerprint is the sum of its
paragraphs' vectors: 16 lanes modulo 2 ** 32 of the paragraph as a whole and 256 lanes modulo 2 ** 16 of its pieces, each
of which adds +1 or -1 to one lane. A piece is a word with the two that follow it in the paragraph; a word is a run of at
most 24 characters that are not blank, or one character of a script that has no blanks between words. Equal multisets of
paragraphs have equal fingerprints in any order, and a paragraph is inserted or deleted by adding or subtracting its
vector. The signed lanes also measure, in texts without line breaks too: the sum of squares of a difference of two
fingerprints estimates the squared distance of the texts' counts of pieces, which gives the likeness with a standard
deviation of at most about 1/16 (a piece that occurs n times weighs n * n; a lane wraps beyond 32767).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.llm.common import shuffle_partitions

#: Lanes and their bits: the wide ones tell multisets apart, the signed ones measure.
WIDE, WIDE_BITS, SIGNED, SIGNED_BITS = 16, 32, 256, 16
#: Characters of scripts without blanks between words (Thai to Lao, Burmese, Khmer, kana, Han), and the words.
_UNSPACED = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
_WORD = rf"[{_UNSPACED}]|[^\s{_UNSPACED}]{{1,24}}"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def lanes(text: Column) -> Column:
    """The fingerprint of a text (not null) as an array of WIDE + SIGNED longs, each below its modulus."""
    zero, low = F.lit(0).cast("long"), F.lit(2**WIDE_BITS - 1)

    def wide(digests: Column) -> Column:
        """Two lanes of each of WIDE / 2 hashes of a paragraph."""

        def pair(i: Column) -> Column:
            hashes = F.transform(digests, lambda d: F.xxhash64(d, i))
            lower = lambda h: F.aggregate(h, zero, lambda a, x: a + x.bitwiseAND(low))
            upper = lambda h: F.aggregate(h, zero, lambda a, x: a + F.shiftrightunsigned(x, WIDE_BITS))
            return _let(hashes, lambda h: F.array(F.pmod(lower(h), F.lit(2**WIDE_BITS)), F.pmod(upper(h), F.lit(2**WIDE_BITS))))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(WIDE // 2 - 1)), pair))

    def pieces(words: Column) -> Column:
        """Twice the slot of each piece, from 0 to 2 * SIGNED - 1: its lane and in the lowest bit its sign. Words that
        the paragraph does not have any more are null, which the hash leaves out."""
        slot = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(2 * SIGNED - 1))
        return F.transform(words, lambda w, i: 2 * slot(w, i))

    def signed(slots: Column) -> Column:
        """Pieces with +1 less those with -1 in each lane. Sorted among an odd mark after each slot, the pieces are
        counted by how far the marks lie apart."""
        marks = F.sequence(F.lit(1).cast("long"), F.lit(4 * SIGNED - 1).cast("long"), F.lit(2).cast("long"))
        at = F.transform(F.sort_array(F.concat(slots, marks)), lambda x, i: F.when(x % 2 == 1, i))
        before = lambda at, i: F.coalesce(F.get(at, 2 * i - 1), F.lit(-1))
        lane = lambda at, i: F.pmod(F.get(at, 2 * i + 1) - 2 * F.get(at, 2 * i) + before(at, i), F.lit(2**SIGNED_BITS)).cast("long")
        return _let(F.filter(at, lambda i: i.isNotNull()), lambda at: F.transform(F.sequence(F.lit(0), F.lit(SIGNED - 1)), lambda i: lane(at, i)))

    def both(paragraphs: Column) -> Column:
        slots = F.flatten(F.transform(paragraphs, lambda p: _let(F.regexp_extract_all(p, F.lit(_WORD), F.lit(0)), pieces)))
        return F.concat(_let(F.transform(paragraphs, lambda p: F.sha2(p, 256)), wide), signed(slots))

    return _let(F.split(text, "\n"), both)


def added(x: Column, y: Column, sign: int = 1) -> Column:
    """The fingerprint of the union of two multisets of paragraphs, or with ``sign`` -1 of the first without the second."""
    return F.transform(F.arrays_zip(x.alias("x"), y.alias("y"), F.sequence(F.lit(0), F.lit(WIDE + SIGNED - 1)).alias("i")), lambda t: F.pmod(
        t["x"] + sign * t["y"], F.when(t["i"] < WIDE, F.lit(2**WIDE_BITS)).otherwise(F.lit(2**SIGNED_BITS))
    ))


def as_text(x: Column) -> Column:
    """Lanes as lower-case hexadecimal digits: 8 for each wide lane, then 4 for each signed one."""
    wide = F.transform(F.slice(x, 1, WIDE), lambda v: F.lpad(F.lower(F.hex(v)), WIDE_BITS // 4, "0"))
    signed = F.transform(F.slice(x, WIDE + 1, SIGNED), lambda v: F.lpad(F.lower(F.hex(v)), SIGNED_BITS // 4, "0"))
    return F.array_join(F.concat(wide, signed), "")


def likeness(x: Column, y: Column) -> Column:
    """1 for equal fingerprints, else one minus the estimated squared distance of the counts of pieces, as a share of
    the sum of both texts' squares (0 at least): the share of pieces in common where pieces don't recur."""
    half = 2 ** (SIGNED_BITS - 1)

    def values(v: Column) -> Column:
        return F.transform(F.slice(v, WIDE + 1, SIGNED), lambda n: F.when(n >= half, n - 2 * half).otherwise(n).cast("double"))

    def squares(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda a, n: a + n * n)

    apart = squares(F.zip_with(values(x), values(y), lambda a, b: a - b))
    both = squares(values(x)) + squares(values(y))
    return F.when(x == y, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - apart / both))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row (null text: empty)."""
    return docs.select(F.col(id_col).alias("doc_id"), as_text(lanes(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text beside an edited one and the next one: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all) of the next text in
    ascending id order, after the last one the first. Null texts are empty, null ids come first, rows with equal ids
    follow each other in the order of their texts' hashes; an empty table gives an empty result. The table is dealt
    into id ranges once, and each range also gets the first row of the next one.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    ids = rows.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    # how many bounds are below the id: a null id is in the first range
    part = F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))), F.lit(0))
    # the least id of each range that has rows: as many numbers as ranges
    firsts = sorted(ids.groupBy(part.alias("part")).agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("least")).collect())
    guests = [(firsts[k - 1]["part"], row["least"]) for k, row in enumerate(firsts)]  # the first range's follows the last
    told = [F.struct(F.lit(p).alias("part"), F.lit(i).cast("long").alias("least")) for p, i in guests]
    names = spark.range(len(told) and 1).select(F.inline(F.array(*told) if told else F.lit(None).cast("array<struct<part:int,least:bigint>>")))
    heads = rows.join(F.broadcast(names), F.coalesce("doc_id", F.lit(-(2**63))) == F.col("least")).select("part", F.lit(True).alias("guest"), "doc_id", "text")
    dealt = rows.select(part.alias("part"), F.lit(False).alias("guest"), "doc_id", "text").unionByName(heads).repartitionById(n, "part")  # a range a task
    dealt = dealt.withColumn("lanes", lanes(F.col("text")))
    order = Window.partitionBy("part").orderBy("guest", "doc_id", F.xxhash64("text"), "text")
    found = dealt.select(
        "guest", "doc_id", "text", "lanes", F.lead("text").over(order).alias("next_text"), F.lead("lanes").over(order).alias("next_lanes")
    ).filter("not guest")
    size = F.length("text")
    tail = F.floor(size / 4).cast("int")
    found = found.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), size - tail), F.substring(F.col("next_text"), F.lit(1), tail)))
    found = found.select("doc_id", size.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "lanes", "next_lanes", lanes(F.col("edited")).alias("edited_lanes"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
