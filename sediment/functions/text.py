"""Column functions on names, paths and source text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends: a carriage return with line feed, or any single character that ends a line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines_of(text: Column, end: str = LINE_END) -> Column:
    """The lines of a text as an array, without an empty last one; ``end`` is a pattern of what ends a line."""
    parts = F.split(text, end)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether the text contains one of ``words``."""
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """A group of the first match of ``pattern``; null if it doesn't match or the group took no part."""
    return F.when(text.rlike(pattern), F.nullif(F.regexp_extract(text, pattern, index), F.lit("")))


def groups(text: Column, pattern: str, index: int = 1) -> Column:
    """A group of every match of ``pattern``, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(index))


def capitalized(word: Column) -> Column:
    """First letter upper, the rest lower case."""
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, 2, 1 << 20)))


def plurals(word: Column) -> Column:
    """A word, with s, with es, and with a final y as ies."""
    return F.array_distinct(F.array(word, F.concat(word, F.lit("s")), F.concat(word, F.lit("es")), F.regexp_replace(word, "y$", "ies")))


def singulars(word: Column) -> Column:
    """A word, and without a plural ending: ies as y, es, s (but not ss)."""
    forms = [
        word,
        F.when(F.lower(word).endswith("ies"), F.regexp_replace(word, "(?i)ies$", "y")),
        F.when(F.lower(word).endswith("es"), F.regexp_replace(word, "(?i)es$", "")),
        F.when(F.lower(word).endswith("s") & ~F.lower(word).endswith("ss"), F.regexp_replace(word, "(?i)s$", "")),
    ]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def identifier(name: Column, prefix: str = "E_") -> Column:
    """A name for diagrams: other characters as underscores, a prefix where it begins with no letter."""
    safe = F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9_]", "_")
    return F.when(safe == "", F.lit(f"{prefix}UNKNOWN")).when(safe.rlike("^[A-Za-z]"), safe).otherwise(F.concat(F.lit(prefix), safe))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folders(path: Column) -> Column:
    """The folders that lead to a file, as an array."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def extension(name: Column) -> Column:
    """From the last dot on, in lower case; none for names whose only dot comes first."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def normalized_path(parts: Column) -> Column:
    """A path from its parts, ``.`` and ``..`` resolved; null if it would leave the root."""
    step = F.aggregate(
        parts,
        F.array(F.lit("")),
        lambda acc, p: F.when(acc.isNull() | ((p == "..") & (F.size(acc) <= 1)), F.lit(None).cast("array<string>"))
        .when(p.isin("", "."), acc)
        .when(p == "..", F.slice(acc, 1, F.size(acc) - 1))
        .otherwise(F.array_append(acc, p)),
    )
    return F.array_join(F.slice(step, 2, F.size(step)), "/")


def estimated_tokens(text: Column) -> Column:
    """3.5 characters a token, rounded up."""
    return F.ceil(F.length(text) / F.lit(3.5)).cast("long")


def grade(score: Column, steps: Sequence[tuple[float, str]], rest: str) -> Column:
    """The name of the first step (score at least, name) that the score reaches."""
    out = F.lit(rest)
    for least, name in reversed(list(steps)):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out
