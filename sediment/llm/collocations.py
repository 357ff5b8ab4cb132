"""Phrases of up to four words that occur often and stick together, mined by pivot partitioning.

An n-gram belongs to its rarest word, the pivot. Each occurrence of a word sends on the words around it that are more
frequent than it, up to the first that is not, three on either side at most; this fragment holds every n-gram that the
occurrence owns, and nothing that another word owns is read off it. Equal fragments are added up before they are sent. A
task mines the fragments of its pivots alone and emits only n-grams that contain the pivot. A pivot with very many
occurrences is dealt into parts by fragment, whose counts are added up afterwards.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.llm.common import Scratch, shuffle_partitions, slices
from sediment.llm.common import cut as written

#: Words of a phrase, its fewest occurrences, and the percentage of them that a longer one must have to stand for it.
WORDS, SEEN, COVERED = 4, 30, 80
#: Most frequent words whose order is broadcast. Rarer ones come after them, in the order of their CRC-32: any order of
#: the words gives the same counts, this one keeps fragments short.
RANKED = 200_000
#: Occurrences of a pivot that one part has at most.
PART = 200_000
#: Characters that are split at once, tokens that are handled at once, counts that a task keeps before it emits them, and
#: fragments that are mined at once (those of one pivot's part always are).
CHARS, TOKENS, KEPT, MINED = 1_000_000, 200_000, 200_000, 100_000
_ONLY_WORDS = re.compile(r"[^\x20\x09.,;:!?\x0A-\x0D]+")
_TOKEN, _BOUND = re.compile(r"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+"), re.compile(r"[\x20\x09.,;:!?\x0A-\x0D]")
_ENDS = frozenset(".,;:!?\n\x0b\x0c\r")
#: The rank of what no phrase goes across.
_STOP = np.int64(2**62)


def _tokens(data: bytes | None, kind: re.Pattern = _TOKEN) -> Iterator[list[str]]:
    """A text's words and the ends of its pieces (or words alone), in lists of about CHARS characters, A-Z as a-z."""
    text, at = (data or b"").lower().decode("utf-8", "replace"), 0
    while at < len(text):
        end = _BOUND.search(text, min(len(text), at + CHARS))
        stop = end.start() if end else len(text)
        yield kind.findall(text, at, stop)
        at = stop


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes | None]]]:
    texts: dict[str, list[bytes | None]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        texts.setdefault(lang, []).append(text)
    yield from texts.items()


def _emitted(held: dict[str, Counter], *names: str) -> Iterator[pa.RecordBatch]:
    """What is held, by language, which is empty from then on."""
    for lang, counts in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", *names])
    held.clear()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}
    for batch in batches:
        for part in slices(batch):
            for lang, texts in _by_lang(part):
                words = held.setdefault(lang, Counter())
                for text in texts:
                    for tokens in _tokens(text, _ONLY_WORDS):
                        words.update(tokens)
            if sum(map(len, held.values())) > KEPT:
                yield from _emitted(held, "phrase", "f")
    yield from _emitted(held, "phrase", "f")


def _windows(texts: list[bytes | None]) -> Iterator[tuple[list[str], int, int]]:
    """Tokens of the texts one after the other, and the range of those to handle: the others are only their neighbours."""
    held: list[str] = []
    first, reach = 0, WORDS - 1
    for text in texts:
        for tokens in _tokens(text):
            held += tokens
            if len(held) > TOKENS:
                yield held, first, len(held) - reach
                held, first = held[-2 * reach :], reach
        held.append("\n")
    yield held, first, len(held)


def _around(ranks: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that own an n-gram of several words, and how many words the fragment has before and after each: those before
    are more frequent than it, those after are not rarer (so of equal pivots the leftmost owns)."""
    reach, n = WORDS - 1, len(ranks)
    wide = np.full(n + 2 * reach, _STOP)
    wide[reach : reach + n] = ranks
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    before = after = np.ones(n, bool)
    for k in range(1, reach + 1):
        before = before & (wide[reach - k : reach - k + n] < ranks)
        after = after & (wide[reach + k : reach + k + n] <= ranks)
        left += before
        right += after
    keep = (ranks < _STOP) & (left + right > 0)
    keep[:first], keep[last:] = False, False
    at = np.flatnonzero(keep)
    return at, left[at], right[at]


def _fragments(order: dict[str, dict[str, int]], whole: bool):
    """Tasks that rewrite texts into fragments, as ``lang, key, n``: the key is the number of words before the pivot and
    the words. ``order``: by language, the ranks of words; ``whole``: no other word is frequent."""
    digits = [str(k) for k in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for part in slices(batch):
                for lang, texts in _by_lang(part):
                    ranks, found = order.get(lang, {}), held.setdefault(lang, Counter())
                    for tokens, first, last in _windows(texts):
                        if whole:
                            placed = [ranks.get(t, _STOP) for t in tokens]
                        else:
                            placed = [_STOP if t in _ENDS else ranks[t] if t in ranks else RANKED + zlib.crc32(t.encode()) for t in tokens]
                        at, left, right = _around(np.array(placed, np.int64), first, last)
                        found.update([digits[b] + " ".join(tokens[i - b : i + a + 1]) for i, b, a in zip(at.tolist(), left.tolist(), right.tolist(), strict=True)])
                if sum(map(len, held.values())) > KEPT:
                    yield from _emitted(held, "key", "n")
        yield from _emitted(held, "key", "n")

    return run


def _weighed(keys: list[str | None], n: list[int]) -> Counter:
    """Sums of ``n`` by key; most are 1."""
    found = Counter(keys)
    for key, k in zip(keys, n, strict=True):
        if k > 1:
            found[key] += k - 1
    del found[None]
    return found


def _mine(words: list[str], before: list[int], n: list[int], least: int) -> dict[str, int]:
    """Counts of the phrases with the pivot that occur ``least`` times or more in the fragments. A phrase is looked for
    only where the shorter ones with the pivot inside it do."""
    flat, sizes = " ".join(words).split(" "), [w.count(" ") + 1 for w in words]
    ends = list(accumulate(sizes))
    places = [e - s + b for e, s, b in zip(ends, sizes, before, strict=True)]
    lefts = [flat[p - 1] + " " + flat[p] if b else None for p, b in zip(places, before, strict=True)]
    rights = [flat[p] + " " + flat[p + 1] if p + 1 < e else None for p, e in zip(places, ends, strict=True)]
    two = {p: k for side in (lefts, rights) for p, k in _weighed(side, n).items() if k >= least}  # a pair has its pivot on one side
    three: dict[str, int] = defaultdict(int)
    open_ = []
    for i in [i for i, (x, y) in enumerate(zip(lefts, rights, strict=True)) if x in two or y in two]:
        p, end, b, k, left, right = places[i], ends[i], before[i], n[i], lefts[i], rights[i]
        left, right = left if left in two else None, right if right in two else None
        ll = flat[p - 2] + " " + left if left and b > 1 else None
        lr = left + " " + flat[p + 1] if left and right else None
        rr = right + " " + flat[p + 2] if right and p + 2 < end else None
        for phrase in (ll, lr, rr):
            if phrase:
                three[phrase] += k
        if ll or lr or rr:
            open_.append((p, end, b, k, ll, lr, rr))
    four: dict[str, int] = defaultdict(int)
    for p, end, b, k, ll, lr, rr in open_:
        ll, lr, rr = (x if x and three[x] >= least else None for x in (ll, lr, rr))
        if ll and b > 2:
            four[flat[p - 3] + " " + ll] += k
        if ll and lr:
            four[ll + " " + flat[p + 1]] += k
        if lr and rr:
            four[lr + " " + flat[p + 2]] += k
        if rr and p + 3 < end:
            four[rr + " " + flat[p + 3]] += k
    return two | {p: k for counts in (three, four) for p, k in counts.items() if k >= least}


def _mined(seen: int):
    """Tasks that count the phrases of several words which contain the pivot. Fragments come in the order of their pivots;
    those of several pivots are counted at once, those of one never apart, but for the parts of a large one (``split``),
    whose counts are all given on."""

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for lang in table.column("lang").unique():
            of_lang, found = table.filter(pc.equal(table.column("lang"), lang)), {}
            for split, least in ((False, seen), (True, 1)):
                own = of_lang.filter(pc.equal(of_lang.column("split"), split))
                if own.num_rows:
                    found |= _mine(*(own.column(c).to_pylist() for c in ("words", "before", "n")), least)
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= MINED:
                table = pa.Table.from_batches(held)
                ends = _changes(table.column("pivot"))
                if ends:
                    yield from counted(table.slice(0, ends[-1]))
                    held = table.slice(ends[-1]).to_batches()
                    rows = table.num_rows - ends[-1]
        if rows:
            yield from counted(pa.Table.from_batches(held))

    return run


def _changes(column: pa.ChunkedArray) -> list[int]:
    """Places whose value is another than the one before."""
    if len(column) < 2:
        return []
    return [i + 1 for i in np.flatnonzero(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy()).tolist()]


def frequent_phrases(docs: DataFrame, seen: int = SEEN, ranked: int = RANKED, part: int = PART, lang_col: str = "lang", text_col: str = "text", cut=written) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f`` of all phrases of one to WORDS words with ``seen`` occurrences or more, and ``lang, n``: the
    occurrences of all words. A null language is ``und``, a null text empty."""
    spark = docs.sparkSession
    chosen = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    words = cut(chosen.mapInArrow(_counted, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    single = words.filter(F.col("f") >= seen)
    top = single.orderBy(F.desc("f"), "lang", "phrase").limit(ranked + 1).collect()  # RANKED words at most, and one to see if there are more
    whole, top = len(top) <= ranked, top[:ranked]
    order: dict[str, dict[str, int]] = {}
    for rank, row in enumerate(top):
        order.setdefault(row["lang"], {})[row["phrase"]] = rank
    every = words.agg(F.sum("f")).first()[0] or 0
    share = max(1, min(part, every // (8 * shuffle_partitions(spark))))
    # every word with more occurrences than a part: at most 8 a shuffle partition, or one for ``part`` occurrences
    large = single.filter(F.col("f") > share).select("lang", F.col("phrase").alias("pivot"), F.ceil(F.col("f") / F.lit(share)).cast("int").alias("parts"))
    before, text = F.substring("key", 1, 1).cast("int"), F.expr("substring(key, 2)")
    found = chosen.mapInArrow(_fragments(order, whole), "lang string, key string, n long").select("lang", before.alias("before"), text.alias("words"), "n")
    found = found.withColumn("pivot", F.expr("substring_index(substring_index(words, ' ', before + 1), ' ', -1)"))
    found = found.join(F.broadcast(large) if large.count() <= 16 * shuffle_partitions(spark) else large, ["lang", "pivot"], "left")
    found = found.withColumn("part", F.coalesce(F.pmod(F.xxhash64("words"), F.col("parts")), F.lit(0))).withColumn("split", F.col("parts").isNotNull())
    dealt = found.repartition("lang", "pivot", "part").sortWithinPartitions("pivot", "lang").select("lang", "pivot", "split", "before", "words", "n")
    several = dealt.mapInArrow(_mined(seen), "lang string, phrase string, f long")
    several = several.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= seen)
    return cut(single.select("lang", "phrase", "f").unionByName(several), "phrases"), totals


def _part(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, top: int = 2000, seen: int = SEEN, ranked: int = RANKED, part: int = PART, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases.

    Texts (A-Z as a-z) are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those into words at blanks and tabs; a phrase is a
    sequence of two to four words within a piece with ``a`` >= ``seen`` occurrences, overlaps included. Its score is the
    lowest over its cuts of floor(2000000 a / (l + r)), where l and r are the occurrences of the parts (ties: the earliest
    cut). A phrase inside a longer one that has 80 percent of its occurrences is left out. Ranks go by score and a,
    descending, and then by the phrase's bytes; ``n`` counts the language's words. A null language is ``und``, a null text
    empty; every row counts, repeated ones too. Other columns are ignored; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        phrases, totals = frequent_phrases(docs, seen, ranked, part, lang_col, text_col, scratch.cut)
        words = F.split("phrase", " ")
        found = phrases.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.size(words).alias("size")).filter("size > 1")

        sub = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _part(F.col("w"), i, m)))))
        covers = found.filter("size > 2").select("lang", sub.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))

        exact = "decimal(20,0)"
        cuts = found.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("head"), _part(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
        score = F.expr(f"cast(2000000 as decimal(7,0)) * cast(a as {exact}) div (cast(l as {exact}) + cast(r as {exact}))")
        scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
        covered = F.coalesce(F.col("longer").cast(exact) * 100 >= F.col("a").cast(exact) * COVERED, F.lit(False))
        kept = scored.join(covers, ["lang", "phrase"], "left").filter(~covered).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")

        # the first of each of several parts of a language, then of those
        ahead = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        lots = shuffle_partitions(docs.sparkSession)
        dealt = kept.withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(lots)))
        few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*ahead))).filter(F.col("rank") <= top).drop("lot")
        first = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*ahead)).cast("long")).filter(F.col("rank") <= top)
        return written(first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
