"""Reachability over edge tables, and the merge of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.shared import cut, joined

KINDS = ("CLASS", "INTERFACE", "ENTITY", "ENDPOINT", "MODULE", "PACKAGE", "SERVICE")
EDGE_KINDS = ("INHERITS", "IMPLEMENTS", "HAS_ONE", "HAS_MANY", "BELONGS_TO", "MANY_TO_MANY", "DEPENDS_ON", "CALLS", "ROUTES_TO")


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``start, vertex, depth`` of what follows ``edges`` (src, dst) from ``starts`` (start), the start itself left out,
    at the least depth. A frontier moves on by joins until it finds nothing new, or for ``max_depth`` steps; each step
    is written down, so a lost executor costs no earlier step. No step is broadcast: edges compress well, and what is small
    on disk need not be small on the driver."""
    links = cut(edges.select("src", "dst").distinct(), "links")
    frontier = cut(starts.select("start", F.col("start").alias("vertex"), F.lit(0).alias("depth")).distinct(), "starts")
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = joined(frontier.withColumnRenamed("vertex", "src"), links, ["src"]).select("start", F.col("dst").alias("vertex")).distinct()
        frontier = cut(joined(found, seen, ["start", "vertex"], "left_anti").withColumn("depth", F.lit(depth)), f"hop{depth}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def blast_radius(edges: DataFrame, changed: str, max_depth: int | None = None) -> DataFrame:
    """``vertex, depth`` of the files that import the changed one, directly or not, nearest first."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = edges.sparkSession.range(1).select(F.lit(changed).alias("start"))
    return reach(back, start, max_depth).select("vertex", "depth").orderBy("depth", "vertex")


def merged_vertices(vertices: DataFrame) -> DataFrame:
    """Vertices (ord, id, name, kind, module, attributes, methods, metadata) by id: name, kind and module of the first;
    attributes and methods by name, the first of each name; metadata by key, the last one."""
    first = vertices.groupBy("id").agg(F.min(F.struct("ord", "name", "kind", "module")).alias("f"))

    def union_of(column: str) -> DataFrame:
        each = vertices.select("id", "ord", F.posexplode(column).alias("_at", "x")).withColumn("_name", F.col("x.name"))
        once = each.groupBy("id", "_name").agg(F.min(F.struct("ord", "_at", "x")).alias("m"))
        return once.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["x"]).alias(column))

    entries = vertices.select("id", "ord", F.explode("metadata").alias("_key", "_value"))
    latest = entries.groupBy("id", "_key").agg(F.max_by("_value", "ord").alias("_value"))
    metadata = latest.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_key", "_value")))).alias("metadata"))
    out = first.select("id", "f.*")
    for part in (union_of("attributes"), union_of("methods"), metadata):
        out = out.join(part, "id", "left")
    empty = {c: vertices.schema[c].dataType for c in ("attributes", "methods")}
    for c, t in empty.items():
        out = out.withColumn(c, F.coalesce(c, F.array().cast(t)))
    return out.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges (ord, src, dst, kind, label) once each, the first of equal ones."""
    return edges.groupBy("src", "dst", "kind", "label").agg(F.min("ord").alias("ord")).select("ord", "src", "dst", "kind", "label")


def numbered(rows: DataFrame, order: list, prefix: str = "", name: str = "alias") -> DataFrame:
    """Aliases in order, for diagrams, from 0; rows that are equal in ``order`` share one (diagram tables are small: one
    window over all rows)."""
    return rows.withColumn(name, F.concat(F.lit(prefix), (F.dense_rank().over(Window.orderBy(*order)) - 1).cast("string")))
