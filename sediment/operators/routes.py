"""API routes of several frameworks, and the entity that each serves."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.text import group, plurals
from sediment.operators.lines import explode_lines

SCHEMA = "method string, route string, handler string, path string, line int, is_async boolean, calls array<string>"
VERBS = ("get", "post", "put", "delete", "patch", "options", "head")
LAYERS = ("service", "model", "repository")


def _constant(node: ast.AST | None, rest: str) -> str:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else rest


def _python_routes(source: str) -> Iterator[tuple]:
    """Decorated handlers and the layers that they call."""
    tree = ast.parse(source)
    imported = {a.asname or a.name.split(".")[0] for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}
    for f in ast.walk(tree):
        if not isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        calls: dict[str, None] = {}  # in the order of the text
        for c in sorted((c for s in f.body for c in ast.walk(s) if isinstance(c, ast.Call)), key=lambda c: (c.func.lineno, c.func.col_offset)):
            what = c.func
            name = what.id if isinstance(what, ast.Name) else what.value.id if isinstance(what, ast.Attribute) and isinstance(what.value, ast.Name) else getattr(what, "attr", "")
            if name in imported or any(w in name.lower() for w in LAYERS):
                calls[name] = None
        for d in f.decorator_list:
            if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute)):
                continue
            verb, route = d.func.attr, _constant(d.args[0] if d.args else None, "unknown")
            if verb == "route":
                named = next((k.value.elts for k in d.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple))), [])
                methods = [_constant(e, "GET").upper() for e in named] or ["GET"]
            else:
                methods = [verb.upper()] if verb in VERBS else []
            for m in methods:
                yield m, route, f.name, f.lineno, isinstance(f, ast.AsyncFunctionDef), list(calls)


def python_routes(files: DataFrame) -> DataFrame:
    """Routes of Python files by their decorators, async handlers too; a file that doesn't parse has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(m, r, h, path, n, a, c) for m, r, h, n, a, c in _python_routes(content)]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.filter(F.col("ext") == ".py").select("path", "content").mapInPandas(run, SCHEMA)


def _rows(lines: DataFrame, method: Column, route: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return lines.select(method.alias("method"), route.alias("route"), none.alias("handler"), "path", "line", F.lit(False).alias("is_async"), F.array().cast("array<string>").alias("calls"))


def script_routes(files: DataFrame) -> DataFrame:
    """Express calls and Nest decorators in JavaScript and TypeScript files, and the files of Next.js routers."""
    lines = explode_lines(files.filter(F.col("ext").isin(".js", ".ts")))
    express = r"""\b(?:app|router)\.(get|post|put|delete|patch)\(\s*['"`]([^'"`]+)['"`]"""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(express), F.lit(1)).alias("m"), F.regexp_extract_all("text", F.lit(express), F.lit(2)).alias("r"))
    found = lines.withColumn("p", F.explode(pairs))
    nest = r"""(?i)@(get|post|put|delete|patch|options|head)\(\s*(?:['"`]([^'"`]*)['"`])?\s*\)"""
    decorated = lines.filter(F.col("text").rlike(nest))
    path = F.coalesce(group(F.col("text"), nest, 2), F.lit("/"))
    out = _rows(found, F.upper("p.m"), F.col("p.r")).unionByName(_rows(decorated, F.upper(F.regexp_extract("text", nest, 1)), path))
    pages = files.filter(F.col("ext").isin(".js", ".jsx", ".ts", ".tsx")).withColumn("line", F.lit(1))
    parts = F.when(F.element_at("folders", 1) == "src", F.slice("folders", 2, F.size("folders"))).otherwise(F.col("folders"))
    pages = pages.withColumn("_root", F.element_at(parts, 1)).withColumn("_rest", F.slice(parts, 2, F.size(parts)))
    shown = F.filter("_rest", lambda p: ~p.rlike(r"^\(.*\)$"))
    app_path = F.concat(F.lit("/"), F.array_join(shown, "/"))
    exported = F.regexp_extract_all("content", F.lit(r"export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"), F.lit(1))
    verbs = F.when(F.col("stem") == "page", F.array(F.lit("GET"))).when(F.size(exported) > 0, F.array_distinct(exported)).otherwise(F.array(F.lit("GET")))
    app = pages.filter((F.col("_root") == "app") & F.col("stem").isin("page", "route")).withColumn("_verb", F.explode(verbs))
    leaf = F.when(F.col("stem") == "index", F.col("_rest")).otherwise(F.array_append("_rest", F.col("stem")))
    old = pages.filter((F.col("_root") == "pages") & ~F.col("stem").startswith("_"))
    old = old.withColumn("_verb", F.explode(F.when(F.array_contains("_rest", "api"), F.array(F.lit("GET"), F.lit("POST"))).otherwise(F.array(F.lit("GET")))))
    return out.unionByName(_rows(app, F.col("_verb"), app_path)).unionByName(_rows(old, F.col("_verb"), F.concat(F.lit("/"), F.array_join(leaf, "/"))))


def routes(files: DataFrame) -> DataFrame:
    """``method, route, handler, path, line, is_async, calls`` of all routes."""
    return python_routes(files).unionByName(script_routes(files))


def first_served(words: DataFrame, keys: list[str], entities: DataFrame) -> DataFrame:
    """For each key the first entity (ord, entity) of which a word (lower case) is the name or its plural; an equi-join
    on all forms, whose least ``ord`` is aggregated."""
    forms = entities.select("ord", "entity", F.explode(plurals(F.lower("entity"))).alias("word"))
    return words.join(forms, "word").groupBy(*keys).agg(F.min(F.struct("ord", "entity")).alias("_e")).select(*keys, "_e.entity")


def contracts(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Routes with the entity (null: none) that a segment of the route or a part of its file's name names."""
    segments = F.split(F.lower("route"), "[/{}:<>?]+")
    names = F.split(F.lower(F.element_at(F.split("path", "/"), -1)), r"\.")
    keys = ["method", "route", "path", "line"]
    words = found.select(*keys, F.explode(F.array_distinct(F.concat(segments, names, F.array(F.lower(F.coalesce("handler", F.lit(""))))))).alias("word")).filter("word != ''")
    return found.join(first_served(words, keys, entities), keys, "left")


def traces(found: DataFrame) -> DataFrame:
    """``method, route, handler, path, call`` of what handlers call."""
    return found.select("method", "route", "handler", "path", F.explode("calls").alias("call"))
