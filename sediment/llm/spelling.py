"""Spelling variants: words at one inserted, deleted or replaced code point, by minimal automata in both directions.

Of two such words, either the first half of the one stands unchanged at the start of the other or its second half stands
unchanged at the end. So words are dealt by a half: forward automata hold the words that begin with it, backward automata
the reversed words that end with it; a query follows its half exactly and completes the rest with one error. A word goes to
the halves of the lengths that its neighbours can have, so a task needs only the words of its own halves, and a half with
very many words is dealt into parts, each of which all its queries visit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.automaton import Automaton
from sediment.llm.common import Scratch
from sediment.llm.common import cut as written

#: Fewest code points and occurrences of a word, and times that a form is more frequent than its variant.
LENGTH, SEEN, TIMES = 7, 2, 10
#: Words that one automaton is closed at (at the end of a half), and words of a half's part.
HELD = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, noise: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of the words with at least LENGTH code points and SEEN occurrences in all texts.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, only A-Z lower-cased. Where ``noise`` divides the CRC-32 of
    ``<id>:<run>``, the run loses the code point at that CRC modulo its length (a null id counts as the text ``null``).
    """
    text = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit("([a-z\\u00C0-\\u00FF]+)"))).alias("run"))
    runs = runs.filter(F.char_length("run") >= LENGTH).withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    found = runs.select(word.alias("word")).filter(F.char_length("word") >= LENGTH)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN)


def _dealt(words: DataFrame, held: int) -> DataFrame:
    """``side, half, part, text, word, n, holds, asks``: a word for each half that a neighbour's half may be."""
    size = F.char_length("word")

    def half(side: int, of: Column) -> Column:
        """Code points of the half that a query of so many follows exactly."""
        return F.floor((of + side) / 2).cast("int")

    def halves(side: int) -> Column:
        each = F.array_distinct(F.array(*[half(side, size + d) for d in (-1, 0, 1)]))
        return F.transform(each, lambda h: F.struct(F.lit(side).alias("side"), h.alias("half"), (h == half(side, size)).alias("asks")))

    rows = words.select("word", "n", F.explode(F.concat(halves(0), halves(1))).alias("x")).select("word", "n", "x.*")
    rows = rows.withColumn("text", F.when(F.col("side") == 1, F.reverse("word")).otherwise(F.col("word")))
    rows = rows.withColumn("start", F.substring(F.col("text"), F.lit(1), F.col("half")))
    # at most one row for each ``held`` words
    large = rows.groupBy("side", "half", "start").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > held)
    large = large.withColumn("parts", F.ceil(F.col("size") / F.lit(held)).cast("int")).drop("size")
    rows = rows.join(large, ["side", "half", "start"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("holds", F.col("own") == F.col("part")).filter("holds or asks")
    return rows.select("side", "half", "part", "start", "text", "word", "n", "holds", "asks")


_ANSWER = "word string, n_near long, top_n long, top string"


def _answers(chunk: list[tuple]) -> pa.RecordBatch:
    """For each query of whole halves, in order: how many words are near, and the most frequent of them."""
    held = [x for x in chunk if x[6]]
    heads = {x[:3]: f"{x[0]}.{x[1]:09d}.{x[2]:09d}." for x in chunk}
    found = Automaton(heads[x[:3]] + x[3] for x in held)
    out: list[tuple] = []
    for side, half, part, text, word, _, _, asks in chunk:
        if not asks:
            continue
        near = [held[k] for k in found.one_error(heads[side, half, part] + text[:half], text[half:])]
        if side:  # what begins with the first half was found forward
            first = word[: len(word) // 2]
            near = [x for x in near if not x[4].startswith(first)]
        if near:
            top = min(near, key=lambda x: (-x[5], x[4]))
            out.append((word, len(near), top[5], top[4]))
    names = [c.split()[0] for c in _ANSWER.split(", ")]
    return pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("top_n", pa.int64()), ("top", pa.string())]))


def _searched(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(chunk) >= held and (row[:3] != chunk[-1][:3] or row[3][: row[1]] != chunk[-1][3][: row[1]]):
                    yield _answers(chunk)
                    chunk = []
                chunk.append(row)
        if chunk:
            yield _answers(chunk)

    return run


def near_words(words: DataFrame, held: int = HELD) -> DataFrame:
    """``word, n_near, top_n, top`` of the words (``word, n``; distinct) that have near ones: their number, and the most
    frequent of them with its ``n`` (ties: the smallest in code-point order)."""
    rows = _dealt(words, held).repartition("side", "half", "part", "start").sortWithinPartitions("side", "half", "part", "text").drop("start")
    found = rows.mapInArrow(_searched(held), _ANSWER)
    best = F.min(F.struct((-F.col("top_n")).alias("down"), "top")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.down")).alias("top_n"), F.col("best.top").alias("top"))


def spelling_forms(docs: DataFrame, noise: int = 31, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word that ``word_counts`` has of ``docs``.

    ``n_near`` is the number of words at exactly one inserted, deleted or replaced code point; ``form`` the most frequent
    of them (ties: the smallest in code-point order) if it is TIMES times as frequent as the word, with its count
    ``form_n``, else null; ``root`` is where forms lead in the end, the word itself if it has none. Null and empty texts
    have no words; rows are counted each, also those that share or lack an id. Other columns are ignored; an empty table
    gives no rows. Counts grow tenfold along forms, so there are few steps.
    """
    with Scratch(docs.sparkSession) as scratch:
        words = scratch.cut(word_counts(docs, noise, id_col, text_col), "words")
        near = scratch.cut(near_words(words, held), "near")
        formed = words.join(near, "word", "left").withColumn("formed", F.col("top_n") >= TIMES * F.col("n"))
        formed = scratch.cut(
            formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("formed"), F.col("top")).alias("form"), F.when(F.col("formed"), F.col("top_n")).alias("form_n")), "formed"
        )
        roots = scratch.cut(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
        while True:  # every step doubles how far a root is followed
            beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
            stepped = scratch.cut(roots.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "stepped")
            roots = stepped.select("word", "root")
            if stepped.filter("moved").isEmpty():
                break
        found = formed.join(roots, "word", "left")
        return written(found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling")
