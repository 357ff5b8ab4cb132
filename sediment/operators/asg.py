"""One graph of classes, entities and routes, as vertex and edge tables, and its text forms."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.functions.text import identifier
from sediment.operators.graph import EDGE_KINDS, KINDS, distinct_edges, merged_vertices, numbered

_ATTRIBUTES = "array<struct<name:string,type:string,is_primary_key:boolean>>"
_METHODS = "array<struct<name:string,parameters:string,visibility:string>>"


def class_vertices(classes: DataFrame, order: int = 0) -> DataFrame:
    attribute = lambda a: F.struct(F.regexp_extract(a, r"(\w+)\s*(?::|$)", 1).alias("name"), F.trim(F.regexp_replace(a, r"^\w+\s*:", "")).alias("type"), F.lit(False).alias("is_primary_key"))
    method = lambda m: F.struct(F.regexp_extract(m, r"^(\w+)", 1).alias("name"), F.regexp_extract(m, r"\((.*)\)", 1).alias("parameters"), F.when(m.startswith("_"), "private").otherwise("public").alias("visibility"))
    return classes.select(
        F.lit(order).alias("ord"), F.concat_ws(".", "module", "name").alias("id"), "name", F.when(F.col("is_interface"), "INTERFACE").otherwise("CLASS").alias("kind"), "module",
        F.transform("attributes", attribute).cast(_ATTRIBUTES).alias("attributes"), F.transform("methods", method).cast(_METHODS).alias("methods"), F.create_map(F.lit("language"), F.col("language")).alias("metadata"),
    )


def class_links(classes: DataFrame, order: int = 0) -> DataFrame:
    """Inheritance; targets are ids where the name is known, else the name as it stands."""
    known = classes.groupBy("name").agg(F.min(F.concat_ws(".", "module", "name")).alias("_id"))
    each = classes.select(F.concat_ws(".", "module", "name").alias("src"), "is_interface", F.explode("bases").alias("base"))
    each = each.withColumn("_n", F.element_at(F.split("base", r"[.\\]"), -1)).join(known.withColumnRenamed("name", "_n"), "_n", "left")
    return each.select(F.lit(order).alias("ord"), "src", F.coalesce("_id", "base").alias("dst"), F.when(F.col("is_interface"), "IMPLEMENTS").otherwise("INHERITS").alias("kind"), F.lit(None).cast("string").alias("label"))


def entity_vertices(entities: DataFrame, order: int = 1) -> DataFrame:
    attributes = F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"), c["is_pk"].alias("is_primary_key")))
    return entities.select(
        F.lit(order).alias("ord"), F.col("name").alias("id"), "name", F.lit("ENTITY").alias("kind"), F.lit("database").alias("module"),
        attributes.cast(_ATTRIBUTES).alias("attributes"), F.array().cast(_METHODS).alias("methods"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


def entity_links(resolved: DataFrame, order: int = 1) -> DataFrame:
    kind = F.when(F.col("symbol") == "||--o{", "HAS_MANY").when(F.col("symbol") == "}o--o{", "MANY_TO_MANY").when(F.col("symbol") == "||--||", "HAS_ONE").otherwise("BELONGS_TO")
    return resolved.select(F.lit(order).alias("ord"), F.col("name").alias("src"), F.coalesce("resolved", "target").alias("dst"), kind.alias("kind"), "label")


def route_vertices(routes: DataFrame, order: int = 2) -> DataFrame:
    return routes.select(
        F.lit(order).alias("ord"), F.concat_ws(" ", "method", "route").alias("id"), F.concat_ws(" ", "method", "route").alias("name"), F.lit("ENDPOINT").alias("kind"), F.col("path").alias("module"),
        F.array().cast(_ATTRIBUTES).alias("attributes"), F.array().cast(_METHODS).alias("methods"), F.create_map(F.lit("handler"), F.coalesce("handler", F.lit(""))).alias("metadata"),
    )


def route_links(contracts: DataFrame, order: int = 2) -> DataFrame:
    served = contracts.filter("entity is not null")
    return served.select(F.lit(order).alias("ord"), F.concat_ws(" ", "method", "route").alias("src"), F.col("entity").alias("dst"), F.lit("ROUTES_TO").alias("kind"), F.lit(None).cast("string").alias("label"))


def build(classes: DataFrame, entities: DataFrame, resolved: DataFrame, contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices merged by id and distinct edges."""
    vertices = class_vertices(classes).unionByName(entity_vertices(entities)).unionByName(route_vertices(contracts))
    edges = class_links(classes).unionByName(entity_links(resolved)).unionByName(route_links(contracts))
    return merged_vertices(vertices), distinct_edges(edges)


def outgoing(edges: DataFrame, vertex: str) -> DataFrame:
    return edges.filter(F.col("src") == vertex)


def incoming(edges: DataFrame, vertex: str) -> DataFrame:
    return edges.filter(F.col("dst") == vertex)


def of_kind(vertices: DataFrame, kind: str) -> DataFrame:
    return vertices.filter(F.col("kind") == kind)


def as_json(vertices: DataFrame, edges: DataFrame) -> str:
    """A graph as JSON text; graphs of one repository fit the driver."""
    nodes = [json.loads(r[0]) for r in vertices.orderBy("id").select(F.to_json(F.struct("*"))).collect()]
    links = [json.loads(r[0]) for r in edges.orderBy("src", "dst", "kind", "label").select(F.to_json(F.struct("*"))).collect()]
    return json.dumps({"nodes": nodes, "edges": links}, sort_keys=True)


def from_json(spark, text: str, vertex_schema, edge_schema) -> tuple[DataFrame, DataFrame]:
    """The tables of a JSON graph; unknown kinds become CLASS and DEPENDS_ON."""
    data = json.loads(text)
    rows = lambda key, schema: spark.createDataFrame([(json.dumps(x),) for x in data[key]], "value string").select(F.from_json("value", schema.simpleString()).alias("x")).select("x.*")
    v = rows("nodes", vertex_schema).withColumn("kind", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("CLASS"))
    return v, rows("edges", edge_schema).withColumn("kind", F.when(F.col("kind").isin(*EDGE_KINDS), F.col("kind")).otherwise("DEPENDS_ON"))


def mermaid_classes(vertices: DataFrame, edges: DataFrame) -> str:
    sign = {"private": "-", "public": "+", "protected": "#"}
    out = ["classDiagram"]
    for r in vertices.filter(F.col("kind").isin("CLASS", "INTERFACE", "SERVICE")).withColumn("safe", identifier(F.col("name"))).orderBy("id").collect():
        out.append(f"    class {r['safe']} {{")
        out += ["        <<interface>>"] * (r["kind"] == "INTERFACE")
        out += [f"        +{a['name'] or a['type']} {a['type'] or ''}".rstrip() for a in r["attributes"]]
        out += [f"        {sign.get(m['visibility'], '~')}{m['name']}({m['parameters']})" for m in r["methods"]]
        out.append("    }")
    arrows = {"INHERITS": "<|--", "IMPLEMENTS": "<|..", "DEPENDS_ON": "<.."}
    last = lambda c: identifier(F.element_at(F.split(c, r"\."), -1))
    for r in edges.filter(F.col("kind").isin(*arrows)).select(last("src").alias("s"), last("dst").alias("d"), "kind").distinct().orderBy("s", "d").collect():
        out.append(f"    {r['d']} {arrows[r['kind']]} {r['s']}")
    return "\n".join(out)


def mermaid_entities(entities: DataFrame, resolved: DataFrame) -> str:
    """Entities and the relations whose targets are known."""
    out = ["erDiagram"]
    for r in entities.withColumn("safe", identifier(F.col("name"))).orderBy("ord").collect():
        out += [f"    {r['safe']} {{", *[f"        {(c['type'] or 'any').split('(')[0]} {c['name']}{' PK' if c['is_pk'] else ''}" for c in r["columns"]], "    }"]
    for r in resolved.filter("resolved is not null").select(identifier(F.col("name")).alias("s"), "symbol", identifier(F.col("resolved")).alias("d"), "label").distinct().orderBy("s", "d", "label").collect():
        out.append(f'    {r["s"]} {r["symbol"]} {r["d"]} : "{r["label"]}"')
    return "\n".join(out)


def mermaid_routes(routes: DataFrame) -> str:
    """A call and a response for each route; files are participants by order of their paths."""
    rows = numbered(routes, ["path"], "P").orderBy("path", "line", "method").select("path", "method", "route", "alias").collect()
    names = {r["path"]: r["alias"] for r in rows}
    out = ["sequenceDiagram", "    participant Client", *[f"    participant {a} as {p}" for p, a in names.items()]]
    for r in rows:
        out += [f"    Client->>{names[r['path']]}: {r['method']} {r['route']}", f"    {names[r['path']]}-->>Client: response"]
    return "\n".join(out)


def mermaid_graph(edges: DataFrame, cylinders: set[str] = frozenset()) -> str:
    """Distinct edges (src, dst) with ids by first appearance."""
    ids: dict[str, str] = {}
    out = ["graph TD"]
    for r in edges.select("src", "dst").distinct().orderBy("src", "dst").collect():
        ends = []
        for x in (r["src"], r["dst"]):
            fresh = x not in ids
            ids.setdefault(x, f"N{len(ids)}")
            ends.append(ids[x] + ((f'[("{x}")]' if x in cylinders else f'["{x}"]') if fresh else ""))
        out.append(f"    {ends[0]} --> {ends[1]}")
    return "\n".join(out)
