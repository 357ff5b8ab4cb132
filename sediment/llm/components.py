"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import cut as written


def _forest(edges: DataFrame) -> bool:
    """Whether every vertex with an edge hangs on one root, which itself hangs on none (edges are distinct)."""
    parents = edges.groupBy("u").count().filter("count > 1").select("u")
    chained = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi")
    return parents.unionByName(chained).isEmpty()


def connected_components(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """``id, component`` of every vertex that ``edges`` (columns ``a``, ``b``: longs) link to another one; component is
    the smallest id that it reaches. Loops and null ends are ignored, repeated edges count once.

    A large-star step hangs each vertex's larger neighbours on its least one, a small-star step the smaller ones; the
    minimum of a neighbourhood is aggregated before it is joined back, so a vertex with very many neighbours is never
    gathered in one place. Each step's edges are written down with ``cut``. The steps end when the edges are stars.
    """
    pairs = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = cut(pairs.distinct(), "edges")
    while not _forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    rooted = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = rooted.select(F.col("component").alias("id"), "component").distinct()
    return rooted.unionByName(roots)
