"""Debt markers in comments, and their statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.text import extension, file_name, grade, group
from sediment.operators.lines import explode_lines

#: Markers in the order in which they count, and the comment sign of each extension.
MARKERS = ("TODO", "FIXME", "HACK", "XXX", "BUG")
COMMENTS = {
    "#": (".py", ".rb", ".sh", ".bash"),
    "//": (".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cpp", ".h", ".hpp", ".go", ".rs", ".swift", ".kt", ".scala", ".cs", ".dart", ".php"),
    "--": (".lua",),
}
WEIGHTS = {"BUG": 5, "FIXME": 3, "HACK": 3, "XXX": 2, "TODO": 1}


def first_marker(text: Column, patterns: Mapping[str, str], scope: int = 2, message: int = 3, hints: Mapping[str, Column] | None = None) -> Column:
    """The first of ``patterns`` (name: regular expression) in order that matches, as a struct ``type, scope, message``
    of the name and two groups of its match; null if none does. Order decides, not position in the text.
    ``hints`` are conditions that hold wherever a pattern matches: plain searches, which spare most texts the pattern."""
    found, hints = F.lit(None), hints or {}
    for name, pattern in reversed(list(patterns.items())):
        hit = F.struct(F.lit(name).alias("type"), group(text, pattern, scope).alias("scope"), F.trim(F.regexp_extract(text, pattern, message)).alias("message"))
        hits = text.rlike(pattern)
        found = F.when(hints[name] & hits if name in hints else hits, hit).otherwise(found)
    return found


def debt_markers(files: DataFrame) -> DataFrame:
    """``path, file, line, type, scope, message`` of the debt comments in files (path, content) of known extensions;
    at most one a line, by the order of MARKERS. ``file`` is the bare name."""
    known = files.withColumn("ext", extension(file_name(F.col("path")))).filter(F.col("ext").isin([e for es in COMMENTS.values() for e in es]))
    lines = explode_lines(known, "content", ("path", "ext")).withColumn("text", F.trim("text"))
    hit = F.lit(None)
    for sign, extensions in COMMENTS.items():
        patterns = {m: rf"(?i)({sign})\s*{m}(?:\(([^)]*)\))?:?\s+(.+)" for m in MARKERS}
        hit = F.when(F.col("ext").isin(list(extensions)), first_marker(F.col("text"), patterns)).otherwise(hit)
    found = lines.withColumn("hit", hit).filter("hit is not null")
    return found.select("path", file_name(F.col("path")).alias("file"), "line", "hit.*")


def marker_statistics(found: DataFrame, types: Sequence[str] = MARKERS, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by type and by type and scope, a row each (scope null: the type's total); every type has its total, 0 if
    need be, in each group that has any marker (without groups: always)."""
    sets = found.filter(F.col("type").isin(list(types))).select(*by, "type", "scope")
    named = sets.filter("scope is not null").groupBy(*by, "type", "scope").count()
    # every type is counted at once, so that the texts are looked at once
    counts = sets.groupBy(*by).agg(*[F.count(F.when(F.col("type") == t, 1)).alias(f"_n{i}") for i, t in enumerate(types)])
    each = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(None).cast("string").alias("scope"), F.col(f"_n{i}").alias("count")) for i, t in enumerate(types)])
    filled = counts.select(*by, F.inline(each))
    return filled.unionByName(named.select(*by, "type", "scope", "count"))


def debt_level(count: Column) -> Column:
    """EXCELLENT for none, LOW up to 5, MODERATE up to 15, HIGH up to 30, CRITICAL above."""
    return grade(-count, [(0, "EXCELLENT"), (-5, "LOW"), (-15, "MODERATE"), (-30, "HIGH")], "CRITICAL")


def debt_score(found: DataFrame) -> DataFrame:
    """One row: 100 less the weights of all markers, 0 at least."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return found.agg(F.greatest(F.lit(0), 100 - F.coalesce(F.sum(F.coalesce(weight[F.col("type")], F.lit(0))), F.lit(0))).cast("long").alias("score"))
