"""Which definition a call means: Python's definitions, imports and calls as tables, joined through aliases, re-exports,
modules and base classes, and what every route reaches through them."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.operators.graph import reach
from sediment.operators.imports import candidates, first_candidate, heat_class
from sediment.shared import cut, joined

#: A row is a definition (``name`` in full, ``head`` its kind), a base of a class, an import (``name`` is the alias,
#: ``head`` the module, ``tail`` what is taken from it) or a call of ``head`` or of its member ``tail``, by ``scope``.
SCHEMA = "path string, what string, scope string, name string, head string, tail string, ord int, line int"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _dotted(node: ast.AST | None) -> str | None:
    """``a.b.c`` of names and attributes; a call of a name stands for what is called."""
    parts = []
    while node is not None:
        if isinstance(node, ast.Name):
            return ".".join([node.id, *reversed(parts)])
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call) and (not parts or isinstance(node.func, ast.Name)):
            node = node.func
        else:
            return None
    return None


class _Reader(ast.NodeVisitor):
    """Rows of one file in the order of its text. A name that was assigned a call, or is a parameter with a type, stands
    for what was called, or for the type; an attribute of ``self`` for what any method of the class assigned to it."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.outer: list[str] = []  # names of the definitions around
        self.scope = ""  # the outermost function or method
        self.types: dict[str, str] = {}
        self.owner, self.members = "", {}

    def add(self, what: str, name: str | None, head: str | None, tail: str | None, node: ast.AST) -> None:
        self.rows.append((what, self.scope, name, head, tail, len(self.rows), getattr(node, "lineno", 0)))

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", a.asname or a.name, a.name, None, node)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add("import", a.asname or a.name, "." * node.level + (node.module or ""), a.name, node)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        name = ".".join([*self.outer, node.name])
        self.add("def", name, "class", None, node)
        for b in node.bases:
            head = _dotted(b.value if isinstance(b, ast.Subscript) else b)
            if head:
                self.add("base", name, head, None, node)
        before = self.outer, self.owner, self.members
        self.outer, self.owner, self.members = [*self.outer, node.name], name, {}
        for f in ast.walk(node):
            if isinstance(f, (ast.Assign, ast.AnnAssign)):
                made = f.annotation if isinstance(f, ast.AnnAssign) else f.value if isinstance(f.value, ast.Call) else None
                for t in [f.target] if isinstance(f, ast.AnnAssign) else f.targets:
                    if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self" and _dotted(made):
                        self.members.setdefault(t.attr, _dotted(made))
        for child in node.body:
            self.visit(child)
        self.outer, self.owner, self.members = before

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        name = ".".join([*self.outer, node.name])
        self.add("def", name, "method" if self.owner and self.outer and self.owner == ".".join(self.outer) else "function", None, node)
        before = self.outer, self.scope, self.types, self.owner
        self.types = dict(self.types)
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            self.types.pop(a.arg, None)
            if _dotted(a.annotation):
                self.types[a.arg] = _dotted(a.annotation)
        self.scope, self.outer = self.scope or name, [*self.outer, node.name]
        for child in [*node.args.defaults, *[d for d in node.args.kw_defaults if d], *node.body]:
            self.visit(child)
        self.outer, self.scope, self.types, self.owner = before

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Assign(self, node: ast.Assign) -> None:
        self.generic_visit(node)
        for t in node.targets:
            if isinstance(t, ast.Name):
                self.types.pop(t.id, None)
                made = self.meant(_dotted(node.value)) if isinstance(node.value, ast.Call) else None
                if made:
                    self.types[t.id] = made

    def meant(self, dotted: str | None) -> str | None:
        if not dotted:
            return None
        first, _, rest = dotted.partition(".")
        if first == "self" and self.owner:
            member, _, more = rest.partition(".")
            if more and member in self.members:
                return f"{self.members[member]}.{more}"
            return ".".join(x for x in (self.owner, rest) if x)
        kind = self.types.get(first)
        return ".".join(x for x in (kind, rest) if x) if kind and kind != first else dotted

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Name) and f.value.func.id == "super":
            self.add("call", None, self.owner, "super." + f.attr, node)
        else:
            dotted = self.meant(_dotted(f))
            if dotted:
                head, _, tail = dotted.rpartition(".")
                self.add("call", None, head or tail, tail if head else None, node)
        self.generic_visit(node)


def statements(files: DataFrame) -> DataFrame:
    """SCHEMA of Python files, in the order of the text; a file that doesn't parse has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    reader = _Reader()
                    reader.visit(ast.parse(content))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += [(path, *r) for r in reader.rows]
            yield pd.DataFrame(rows, columns=_NAMES).astype({"ord": "int32", "line": "int32"})

    return files.filter((F.col("ext") == ".py") & F.col("content").isNotNull()).select("path", "content").mapInPandas(run, SCHEMA)


def key(path: Column, name: Column) -> Column:
    """A symbol as one text: its file and its name in that file; without a name, the file as a module."""
    return F.concat(path, F.lit("#"), F.coalesce(name, F.lit("")))


def _imported(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``src, dst``: what an alias stands for. ``from m import x`` means x in m, or else the file m/x."""
    found = rows.filter("what = 'import'").select("path", "name", "head", "tail")
    named = files.select(F.col("path").alias("file"))
    ids = ["path", "name", "head", "tail"]
    found = found.withColumn("tail", F.coalesce("tail", F.lit("")))
    whole = first_candidate(found, ids, candidates(F.col("path"), F.col("head")), named, "file")
    within = found.filter("tail != ''")
    deeper = F.when(F.col("head").rlike(r"^\.+$"), F.concat("head", "tail")).otherwise(F.concat_ws(".", "head", "tail"))
    part = first_candidate(within, ids, candidates(F.col("path"), deeper), named, "file")
    src = key(F.col("path"), F.col("name")).alias("src")
    inside = whole.select(src, key(F.col("file"), F.col("tail")).alias("dst"))
    return inside.unionByName(part.select(src, key(F.col("file"), F.lit(None)).alias("dst"))).distinct()


def _meant(wanted: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """``start, vertex``: the definition or module that each wanted symbol (start) is or stands for, the nearest one; a
    definition goes before a module."""
    wanted = cut(wanted.distinct(), "wanted")
    every = wanted.select("start", F.col("start").alias("vertex"), F.lit(0).alias("depth")).unionByName(reach(links, wanted))
    hits = joined(every, known.select(F.col("id").alias("vertex"), "kind"), ["vertex"])
    order = F.struct((F.col("kind") == "module").alias("m"), "depth", "vertex")
    return hits.groupBy("start").agg(F.min(order).alias("x")).select("start", "x.vertex")


def resolved_calls(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``src, ord, line, call, dst, kind``: the calls of functions and methods (src, a symbol's ``key``; of a file's own
    text, the file) in the order of the text, with the definition that is meant (class, function or method; null where none
    of the repository is). Names go through aliases, re-exports over any number of files, imported modules, types of
    variables and parameters, and base classes in the order of their distance."""
    rows = cut(statements(files), "statements") if rows is None else rows
    defined = rows.filter("what = 'def'").select(key(F.col("path"), F.col("name")).alias("id"), F.col("head").alias("kind")).groupBy("id").agg(F.max("kind").alias("kind"))
    modules = files.filter(F.col("ext") == ".py").select(key(F.col("path"), F.lit(None)).alias("id"), F.lit("module").alias("kind"))
    known = cut(defined.unionByName(modules), "known")
    links = cut(_imported(rows, files), "aliases")
    calls = rows.filter("what in ('call', 'base')").withColumn("_up", F.coalesce(F.col("tail").startswith("super."), F.lit(False)))
    calls = calls.withColumn("tail", F.regexp_replace("tail", r"^super\.", ""))
    calls = calls.withColumn("head", F.when((F.col("what") == "base") | F.col("_up"), F.col("head")).otherwise(F.concat_ws(".", "head", "tail")))
    # the longest beginning of a dotted name that is known by itself, and what follows it
    words = F.split("head", r"\.")
    cuts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.struct(F.array_join(F.slice(words, 1, i), ".").alias("own"), F.array_join(F.slice(words, i + 1, F.size(words)), ".").alias("rest")))
    parts = calls.select("path", "ord", F.explode(cuts).alias("c")).select("path", "ord", key(F.col("path"), F.col("c.own")).alias("start"), F.length("c.own").alias("_n"), "c.rest")
    own = cut(_meant(parts.select("start"), links, known), "heads")
    first = joined(parts, own, ["start"]).groupBy("path", "ord").agg(F.max_by(F.struct("vertex", "rest"), "_n").alias("x")).select("path", "ord", "x.*")
    # members: of a module by its own names and aliases, of a class by its methods and those of its bases
    first = cut(joined(first, known.select(F.col("id").alias("vertex"), "kind"), ["vertex"]), "first")
    inner = first.filter("kind = 'module' and rest != ''").withColumn("_rest", F.split("rest", r"\."))
    depth = F.transform(F.sequence(F.lit(1), F.size("_rest")), lambda i: F.struct(F.array_join(F.slice("_rest", 1, i), ".").alias("own"), F.array_join(F.slice("_rest", i + 1, F.size("_rest")), ".").alias("rest")))
    inner = inner.select("path", "ord", "vertex", F.explode(depth).alias("c")).select("path", "ord", F.concat("vertex", "c.own").alias("start"), F.length("c.own").alias("_n"), "c.rest")
    within = joined(inner, _meant(inner.select("start"), links, known), ["start"]).groupBy("path", "ord").agg(F.max_by(F.struct("vertex", "rest"), "_n").alias("x")).select("path", "ord", "x.*")
    within = joined(within, known.select(F.col("id").alias("vertex"), "kind"), ["vertex"])
    found = cut(first.filter("kind != 'module'").unionByName(within, allowMissingColumns=True).filter("kind != 'module'"), "found")
    places = calls.select("path", "ord", "what", "name", "_up", "tail")
    bases = joined(found, places.filter("what = 'base'"), ["path", "ord"]).filter("kind = 'class' and rest = ''")
    bases = cut(bases.select(key(F.col("path"), F.col("name")).alias("src"), F.col("vertex").alias("dst")), "bases")
    members = joined(found, places.filter("what = 'call'"), ["path", "ord"]).filter("kind = 'class'")
    member = F.when(F.col("_up"), F.col("tail")).otherwise(F.when(F.col("rest").rlike(r"^[^.]+$"), F.col("rest")))
    members = cut(members.select("path", "ord", "vertex", "_up", member.alias("member")), "members")
    asked = members.filter("member is not null")
    above = reach(bases, asked.select(F.col("vertex").alias("start")))
    line = above.select("start", F.col("vertex").alias("owner"), "depth").unionByName(asked.filter("not _up").select(F.col("vertex").alias("start"), F.col("vertex").alias("owner"), F.lit(0).alias("depth")).distinct())
    hits = joined(asked.withColumnRenamed("vertex", "start"), line, ["start"]).filter("depth > 0 or not _up").select("path", "ord", "depth", F.concat("owner", F.lit("."), "member").alias("id"))
    hits = joined(hits, known, ["id"])
    methods = hits.groupBy("path", "ord").agg(F.min(F.struct("depth", "id", "kind")).alias("x")).select("path", "ord", F.col("x.id").alias("_method"), F.col("x.kind").alias("_kind"))
    # what a function gives has no known members
    plain = found.filter("kind = 'class' or rest = ''").withColumnRenamed("vertex", "_first").withColumnRenamed("kind", "_first_kind").drop("rest")
    out = joined(joined(calls.filter("what = 'call'"), plain, ["path", "ord"], "left"), methods, ["path", "ord"], "left")
    up = F.col("_up") & F.col("_method").isNull()  # what no base in the repository has
    return out.select(
        key(F.col("path"), F.when(F.col("scope") != "", F.col("scope"))).alias("src"),
        "ord",
        "line",
        F.when(F.col("_up"), F.concat(F.lit("super."), "tail")).otherwise(F.col("head")).alias("call"),
        F.when(~up, F.coalesce("_method", "_first")).alias("dst"),
        F.when(~up, F.coalesce("_kind", "_first_kind")).alias("kind"),
    )


def route_reach(found: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``method, route, start, vertex, depth, risk``: every definition that the handler of a route (of ``routes``) gets to
    by ``resolved_calls``, over any number of calls, at the least depth, and how many files import the one it is in (as a
    class of ``heatmap``; edges of files)."""
    links = calls.filter("dst is not null").select("src", "dst")
    starts = found.filter("handler is not null").select("method", "route", key(F.col("path"), F.col("handler")).alias("start"))
    got = reach(links, starts.select("start"))
    degree = edges.groupBy(F.col("dst").alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    got = joined(got.withColumn("_file", F.substring_index("vertex", "#", 1)), degree, ["_file"], "left")
    got = got.select("start", "vertex", "depth", heat_class(F.coalesce("_n", F.lit(0))).alias("risk"))
    return joined(starts.distinct(), got, ["start"]).select("method", "route", "start", "vertex", "depth", "risk")
