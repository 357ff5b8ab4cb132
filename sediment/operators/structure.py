"""Classes and their members: of brace languages from their statements (``tokens``), of Python by its own parser.

A declaration is one statement, whatever lines it takes. Its tokens outside angle brackets, joined by blanks, are its flat
form, in which generics of any depth are gone and a pair of brackets holds nothing; small patterns on it tell what is
declared. The members of a class are the statements of its body's block. Types and parameters are cut from the source
without comments.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Sequence
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.operators.tokens import masked_files, nested, parts_of, scanned_size, statements, tokens
from sediment.shared import dealt, delete, joined, new_path

SCHEMA = "path string, language string, module string, name string, bases array<string>, attributes array<string>, methods array<string>, is_interface boolean, line int"
LANGUAGES = ("java", "csharp", "php", "script", "go", "rust")
#: Words before a declaration that are no part of it.
MODIFIERS = (
    "public private protected internal static final abstract sealed partial readonly async override virtual export default declare non-sealed strictfp const var let unsafe"
    " transient volatile synchronized native required extern new ref file accessor get set pub crate"
).split()
_MOD = "|".join(MODIFIERS)
_LEAD = rf"^(?:@\S+(?: \( \))? |# \[ \] |\[ \] |non - sealed |(?:{_MOD}) (?:\( \) )?)*"
#: By language: a class's head in its flat form: kind, name and what follows.
_HEADS = {
    "java": rf"{_LEAD}(class|interface|enum|record) (\w+)(?: \( \))?(.*)$",
    "csharp": rf"{_LEAD}(class|interface|enum|record(?: struct| class)?|struct) (\w+)(?: \( \))?(.*)$",
    "php": rf"{_LEAD}(class|interface|trait|enum) (\w+)(?: : \??\w+)?(.*)$",
    "script": rf"{_LEAD}(class|interface|enum|type) (\w+)(.*)$",
    "go": r"^(?:type )?(\w+)(?: \[ \])? (struct|interface)()$",
    "rust": rf"{_LEAD}(struct|enum|trait|union) (\w+)(?: \( \))?(.*)$",
}
_IMPL = r"^(?:# \[ \] )*(?:unsafe )?impl (?:.* for )?(?:\w+ :: )*(\w+)(?: where .*)?$"
_HANDLERS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
#: Script functions that stand as classes: components by their capital, handlers by their name.
_FUNCTION = r"^(?:(?:export|default|async) )*function (?:\* )?([A-Z]\w*) \( \)"
_ARROW = r"^(?:(?:export|default) )*(?:const|let|var) ([A-Z]\w*)(?: : .*?)? = (?:async )?(?:\( \)(?: : .*?)? =>|\w+ =>|function (?:\w+ )?\( \))"


def _texts(t: Column) -> Column:
    return F.array_join(F.transform(F.filter(t, lambda x: (x["angle"] == 0) & ~((x["kind"] == "sign") & x["text"].isin("<", ">"))), lambda x: F.when(x["kind"] == "string", F.lit('""')).otherwise(x["text"])), " ")


def _first(t: Column, found) -> Column:
    """Place (from 1) of the first token that ``found`` is true of, 0 if there is none."""
    return F.array_position(F.transform(t, lambda x: F.coalesce(found(x), F.lit(False))), True).cast("int")


def _is(x: Column, *signs: str) -> Column:
    return (x["kind"] == "sign") & (x["angle"] == 0) & x["text"].isin(*signs)


def declarations(files: DataFrame, parts: int | None = None) -> DataFrame:
    """The statements of all files in brace languages with ``flat``, the form before the first brace, semicolon or, of a
    member, its value; ``body``, the brace block that they open (null: none)."""
    rows = statements(nested(tokens(files, parts)))
    t = F.col("t")
    brace = _first(t, lambda x: _is(x, "{"))
    stop = _first(t, lambda x: _is(x, "{", ";"))
    rows = rows.withColumn("stop", F.when(stop > 0, stop).otherwise(F.size(t) + 1)).withColumn("brace", brace)
    return rows.withColumn("flat", _texts(F.slice(t, F.lit(1), F.col("stop") - 1))).withColumn("body", F.when(brace > 0, F.element_at(t, brace)["i"]))


class Parsed:
    """What the operators on brace languages share: the files, their statements and declared types, their bytes without
    comments, and the annotated members of classes. Each is written to the shared folder at its first use, so that the many
    plans that read it begin there."""

    def __init__(self, files: DataFrame):
        self.files, self.root = files, new_path(files.sparkSession, "parsed")

    def _written(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.root}/{name}")

    @cached_property
    def parts(self) -> int:
        """The number of tasks for a table of tokens, by the bytes of the files."""
        return dealt(scanned_size(self.files), self.files.sparkSession.sparkContext.defaultParallelism)

    @cached_property
    def rows(self) -> DataFrame:
        return self._written("rows", declarations(self.files, self.parts))

    @cached_property
    def source(self) -> DataFrame:
        plain = masked_files(self.files, literals=False)
        return self._written("source", plain.select("path", "language", F.col("content").cast("binary").alias("source")))

    @cached_property
    def heads(self) -> DataFrame:
        return self._written("heads", _heads(self.rows, self.parts))

    @cached_property
    def members(self) -> DataFrame:
        return self._written("members", annotated_members(self.rows, self.heads, self.source.select("path", "source"), self.parts))

    def delete(self) -> None:
        """Delete what was written; nothing that was made of it can be computed again."""
        delete(self.files.sparkSession, self.root)


def parsed(files: DataFrame | Parsed) -> Parsed:
    """The files as they are parsed; what is parsed stays as it is."""
    return files if isinstance(files, Parsed) else Parsed(files)


def _one_of(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("^(?:" + "|".join(map(re.escape, words)) + ")$")


def _module(path: Column) -> Column:
    """The folder that a file lies in."""
    folders = F.split(path, "/")
    return F.coalesce(F.get(folders, F.size(folders) - 2), F.lit("Root"))


def _cut(source: Column, a: Column, b: Column) -> Column:
    """The source between two places in its bytes, in one line."""
    return F.trim(F.regexp_replace(F.substring(source, a + 1, b - a).cast("string"), r"\s+", " "))


def _heads(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """``path, language, name, kind, rest, line, body, listed``: declared types; ``listed`` is the block of the parameters
    in the head."""
    flat, language = F.col("flat"), F.col("language")
    which = lambda k: reduce(lambda out, x: F.when(language == x, F.regexp_extract(flat, _HEADS[x], k)).otherwise(out), LANGUAGES, F.lit(""))
    go = language == "go"
    # types of a Go group stand without their word in the group's block
    groups = rows.filter(go & (flat == "type ( )")).select("path", F.element_at("t", 2)["i"].alias("block"), F.lit(True).alias("_grouped"))
    found = joined(rows, groups, ["path", "block"], "left", parts).filter(~go | flat.startswith("type ") | F.col("_grouped"))
    kind, name = F.when(go, which(2)).otherwise(which(1)), F.when(go, which(1)).otherwise(which(2))
    paren = _first(F.col("t"), lambda x: _is(x, "("))
    named = _first(F.col("t"), lambda x: (x["text"] == F.col("name")) & (x["kind"] == "word"))
    # the first list behind the name and its generics
    behind = F.slice("t", F.col("at_name") + 1, F.size("t"))
    listed = F.filter(F.transform(behind, lambda x: F.when(_is(x, "("), x["i"])), lambda i: i.isNotNull())
    found = found.withColumns({"name": name, "kind": kind, "rest": which(3)}).filter("name <> ''").withColumn("at_name", named)
    typed = (F.col("kind") == "type") & ~F.col("rest").rlike("^ =")
    found = found.filter(~typed & (F.col("body").isNotNull() | F.col("kind").isin("record", "record struct", "record class", "type") | language.isin("rust", "csharp")))
    head_list = F.when((F.col("kind") != "type") & F.col("flat").contains(" ( )") & (paren > 0) & (language != "php"), F.get(listed, F.lit(0)))
    # the list must stand in the head, not in the body's statement
    return found.select("path", "language", "name", "kind", "rest", F.element_at("t", F.greatest("at_name", F.lit(1)))["line"].alias("line"), "body", F.when(F.col("flat").rlike(r"\w \( \)"), head_list).alias("listed"))


def _bases(rest: Column) -> Column:
    """The names that a head extends, implements or lists behind a colon, without generics, arguments and conditions."""
    plain = F.regexp_replace(F.regexp_replace(rest, r" (?:where|permits|throws) .*$|^ = ?.*$", ""), r" ?\( \)", "")
    names = F.split(F.regexp_replace(plain, r"\b(?:extends|implements|with)\b|(?<!:):(?!:)", ","), ",")
    return F.filter(F.transform(names, lambda b: F.regexp_replace(b, " ", "")), lambda b: b.rlike(r"^[\w\\.]+$"))


def brace_classes(files: DataFrame | Parsed, language: str | None = None) -> DataFrame:
    """Classes (see SCHEMA) of the brace languages, or of one; Rust's impl blocks and Go's receivers join their types.

    The module is the folder (``Root`` without one), or the namespace that a C# or PHP file declares for all it holds.
    Fields are written ``type name`` (``name: type`` in scripts and Rust), methods ``name(parameters)``, in Go and Rust
    with what they return. A C# class lists its properties, a script's class also members without a type; components and
    handlers of scripts stand as classes of one method.
    """
    of = parsed(files)
    chosen = F.col("language").isin(*([language] if language else LANGUAGES))
    rows, heads, source = of.rows.filter(chosen), of.heads.filter(chosen), of.source.select("path", "source")
    spaces = rows.filter((F.col("block") == -1) & F.col("flat").rlike(r"^namespace ") & (F.col("language").isin("php") | (F.col("language") == "csharp") & F.col("body").isNull()))
    spaces = spaces.groupBy("path").agg(F.first(F.regexp_replace(F.regexp_replace("flat", "^namespace ", ""), r" ?\. ?", ".")).alias("space"))

    owners = heads.filter("body is not null").select("path", "name", "kind", F.col("line").alias("owner_line"), F.col("body").alias("block"))
    impls = rows.filter((F.col("language") == "rust") & F.col("flat").rlike(_IMPL)).select("path", F.regexp_extract("flat", _IMPL, 1).alias("name"), F.lit("impl").alias("kind"), F.element_at("t", 1)["line"].alias("owner_line"), F.col("body").alias("block"))
    inner = joined(rows, owners.unionByName(impls), ["path", "block"], parts=of.parts).filter(~_declares())
    members = joined(inner, source, ["path"], parts=of.parts)
    parts = _methods(members).unionByName(_fields(members)).unionByName(_listed(heads, rows, source, of.parts)).unionByName(_receivers(rows, source, of.parts)).unionByName(_functions(rows, source, of.parts))
    none, strings = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    found = heads.select("path", "language", "name", "kind", "line", _bases(F.col("rest")).alias("bases"), none.alias("field"), none.alias("method"), F.lit(-1).alias("at"))
    found = found.unionByName(impls.select("path", F.lit("rust").alias("language"), "name", "kind", F.col("owner_line").alias("line"), strings.alias("bases"), none.alias("field"), none.alias("method"), F.lit(-1).alias("at")))
    found = found.unionByName(parts.select("path", "language", "name", "kind", "line", strings.alias("bases"), "field", "method", "at"))
    found = joined(found, spaces, ["path"], "left", of.parts).withColumn("module", F.coalesce("space", _module(F.col("path"))))
    # one package's files make up a Go or Rust type together, other classes are their file's
    own = F.when(~F.col("language").isin("go", "rust"), F.col("path"))
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("path", "at", F.col(c).alias("v"))))), lambda x: x["v"]))
    # lists of members are gathered in as many tasks as the source asks for, not as their compressed bytes do
    out = found.withColumn("own", own).repartition(of.parts, "language", "own", "module", "name").groupBy("language", "own", "module", "name").agg(
        F.min("path").alias("path"),
        F.array_distinct(F.flatten(F.collect_list("bases"))).alias("bases"),
        ordered("field").alias("attributes"),
        ordered("method").alias("methods"),
        F.max(F.col("kind").isin("interface", "trait")).alias("is_interface"),
        F.min("line").alias("line"),
    )
    return out.select("path", "language", "module", "name", "bases", "attributes", "methods", "is_interface", "line")


def _declares() -> Column:
    """Whether a statement declares a type of its own."""
    flat, language = F.col("flat"), F.col("language")
    return reduce(lambda out, x: out | (language == x) & flat.rlike(_HEADS[x]), [x for x in LANGUAGES if x != "go"], F.lit(False))


def _signature(t: Column, at: Column, name: Column, suffix: Column) -> Column:
    """``name(parameters)suffix`` of the list that opens at place ``at``."""
    return F.concat(name, F.lit("("), _cut(F.col("source"), F.element_at(t, at)["until"], F.element_at(t, at + 1)["at"]), F.lit(")"), suffix)


def _methods(members: DataFrame) -> DataFrame:
    """The functions among the statements of a body: a list right behind a word or the generics of one, before any value."""
    t, language = F.col("t"), F.col("language")
    value = _first(t, lambda x: _is(x, "=", "=>", "{", ";"))
    head = F.slice(t, F.lit(1), F.when(value > 0, value - 1).otherwise(F.size(t)))
    called = lambda x, y: _is(x, "(") & ((y["kind"] == "word") & ~y["text"].startswith("@") & ~_one_of(y["text"], (*MODIFIERS, "if", "for", "while", "switch", "return", "catch", "case")) | (y["kind"] == "sign") & (y["text"] == ">") | (y["text"] == "?"))
    # a list of an accessor word's own name (get(), set()) is a method of that name
    own = lambda x, y, n: _is(x, "(") & y["text"].isin("get", "set", "new", "default", "file", "ref") & (n == 1) & language.isin("script", "go", "rust")
    hits = F.transform(head, lambda x, n: F.when((n > 0) & F.coalesce(called(x, F.get(head, n - 1)) | own(x, F.get(head, n - 1), n), F.lit(False)), n + 1))
    place = F.get(F.filter(hits, lambda n: n.isNotNull()), F.lit(0))
    rows = members.withColumn("paren", place.cast("int")).filter("paren is not null")
    words = F.filter(F.slice(t, F.lit(1), F.col("paren") - 1), lambda x: (x["angle"] == 0) & (x["kind"] == "word"))
    rows = rows.withColumn("method_name", F.element_at(words, -1)["text"])
    constructor = language.isin("java", "csharp") & (F.col("method_name") == F.col("name"))
    callable_ = ~language.isin("php") | F.col("flat").rlike(r"\bfunction\b")
    rows = rows.filter(~constructor & callable_ & ~F.col("flat").rlike(r"^(?:[\w@]+ )*(?:delegate|event|case) ") & ((language != "rust") | F.col("flat").rlike(r"\bfn ")))
    # constants of an enumeration may have arguments
    rows = rows.filter(~((F.col("kind") == "enum") & language.isin("java", "csharp") & (F.col("part") == 0)))
    stop = F.when(F.col("stop") <= F.size(t), F.element_at(t, F.least(F.col("stop"), F.size(t)))["at"]).otherwise(F.element_at(t, -1)["until"])
    after = _cut(F.col("source"), F.element_at(t, F.col("paren") + 1)["until"], stop)
    shown = language.isin("go", "rust") | (language == "script") & F.col("kind").isin("interface", "type")
    suffix = F.when(shown & (after != ""), F.concat(F.when(after.startswith(":"), F.lit("")).otherwise(F.lit(" ")), F.regexp_replace(after, "[,;]$", ""))).otherwise(F.lit(""))
    return rows.select("path", "language", "name", "kind", F.col("owner_line").alias("line"), F.lit(None).cast("string").alias("field"), _signature(t, F.col("paren"), F.col("method_name"), suffix).alias("method"), F.element_at(t, 1)["i"].alias("at"))


def _lead(t: Column, language: Column) -> Column:
    """Place of the first token that is no modifier, annotation or attribute (from 1)."""
    listed = lambda x: (x["kind"] == "sign") & x["text"].isin("(", ")")
    attribute = lambda x: (x["kind"] == "sign") & x["text"].isin("[", "]", "#")
    skipped = lambda x: (x["kind"] == "word") & x["text"].rlike(rf"^(?:(?:{_MOD})$|@)") | ((language != "php") & listed(x)) | (language.isin("csharp", "php", "rust") & attribute(x))
    return _first(t, lambda x: ~skipped(x))


def _fields(members: DataFrame) -> DataFrame:
    """What a class holds, by its language."""
    language, source = F.col("language"), F.col("source")
    # members of scripts' types, of enumerations and of Rust structs may be parted by commas
    commas = (language == "rust") & F.col("kind").isin("struct", "union", "enum") | (language == "script") & F.col("kind").isin("interface", "type")
    each = members.filter(F.col("kind") != "impl").select("path", "language", "name", "kind", "owner_line", "source", "stop", "brace", F.explode(F.when(commas, parts_of(F.col("t"))).otherwise(F.array("t"))).alias("t"))
    t = F.col("t")
    end = _first(t, lambda x: _is(x, "=", "{", ";", "=>") | _is(x, ",") & ~(language == "go"))
    rows = each.withColumn("end", F.when(end > 0, end).otherwise(F.size(t) + 1)).withColumn("lead", _lead(t, language)).filter("lead > 0")
    rows = rows.withColumn("head", F.slice(t, F.lit(1), F.col("end") - 1)).withColumn("h", _texts(F.col("head")))
    words = F.filter(F.slice("head", F.col("lead"), F.size("head")), lambda x: (x["angle"] == 0) & (x["kind"] == "word"))
    place = lambda x: _first(F.col("head"), lambda y: y["i"] == x["i"])
    text = lambda a, b: _cut(source, F.element_at(t, a)["at"], F.element_at(t, b)["until"])
    out = rows.select("*", F.element_at(t, 1)["i"].alias("at"))

    final = out.withColumn("last", F.when(F.size(words) > 0, F.element_at(words, -1)))
    final = final.withColumn("n", F.when(F.col("last").isNotNull(), place(F.col("last"))))
    called = F.col("h").rlike(r"\w \( \)") & ((language == "csharp") | F.col("h").rlike(r"\w \( \)(?! \w)"))
    plain = (F.col("kind") != "enum") & ~called & ~F.col("h").rlike(r"^(?:[\w@]+ )*(?:delegate|event|this|return|package|import|using|throw) ") & (F.col("n") > F.col("lead"))
    ended = F.get(t, F.col("end") - 1)["text"]
    typed = final.filter(language.isin("java") & plain & ended.isin(";", "=", ",")).withColumn("field", F.concat(text(F.col("lead"), F.col("n") - 1), F.lit(" "), F.col("last.text")))
    property_ = final.filter((language == "csharp") & plain & ended.isin("{", "=>")).withColumn("field", F.concat(text(F.col("lead"), F.col("n") - 1), F.lit(" "), F.col("last.text")))

    dollar = _first(F.col("head"), lambda x: (x["kind"] == "word") & x["text"].startswith("$"))
    php = out.filter((language == "php") & ~F.col("h").rlike(r"\bfunction\b|^case ")).withColumn("n", dollar).filter(F.col("n") > 0)
    php = php.withColumn("type", F.when(F.col("n") > F.col("lead"), F.concat(text(F.col("lead"), F.col("n") - 1), F.lit(" "))).otherwise(F.lit("")))
    several = F.transform(parts_of(t), lambda p: F.get(F.filter(p, lambda x: (x["kind"] == "word") & x["text"].startswith("$")), F.lit(0)))
    php = php.select("*", F.explode(F.array_compact(several)).alias("v")).withColumn("at", F.col("v.i")).withColumn("field", F.concat("type", "v.text"))

    first = F.element_at("head", F.col("lead"))
    named = out.filter((language == "script") & (F.col("kind") != "enum") & (F.col("lead") <= F.size("head"))).withColumn("x", first)
    callable_ = F.col("h").rlike(rf"{_LEAD}[\w$#]+(?: \?)? \( \)")
    named = named.filter((F.col("x.kind") == "word") & ~callable_ & ~F.col("x.text").isin("static", "constructor"))
    colon = _first(F.col("head"), lambda x: _is(x, ":"))
    # a type that is an object literal ends the head at its brace
    kind = F.when(colon == F.size("head"), F.lit("object")).when(colon > 0, text(colon + 1, F.size("head")))
    named = named.withColumn("field", F.concat(F.col("x.text"), F.coalesce(F.concat(F.lit(": "), kind), F.lit(""))))

    go = out.filter((language == "go") & (F.col("kind") == "struct"))
    bare = F.filter(t, lambda x: (x["kind"] != "string") & ~_is(x, ";"))
    go = go.withColumn("b", bare).withColumn("g", _texts(F.col("b"))).filter("size(b) > 0")
    names = F.regexp_extract("g", r"^(\w+(?: , \w+)*) [^.]", 1)
    count = F.when(names == "", 0).otherwise(2 * F.size(F.split(names, " , ")) - 1)
    go = go.withColumn("skip", count).withColumn("type", _cut(source, F.element_at("b", F.col("skip") + 1)["at"], F.element_at("b", -1)["until"]))
    each = F.when(names == "", F.array("type")).otherwise(F.transform(F.split(names, " , "), lambda v: F.concat(F.col("type"), F.lit(" "), v)))
    go = go.select("*", F.posexplode(each).alias("k", "field")).withColumn("at", F.col("at") + F.col("k"))
    embedded = out.filter((language == "go") & (F.col("kind") == "interface") & ~F.col("h").contains("( )")).withColumn("method", text(F.lit(1), F.col("end") - 1))

    rust = out.filter(language == "rust")
    variants = rust.filter((F.col("kind") == "enum") & (first["kind"] == "word")).withColumn("field", F.concat(F.lit("variant "), first["text"]))
    colon = F.col("lead") + 1
    fields = rust.filter(F.col("kind").isin("struct", "union") & (F.col("lead") + 2 <= F.size("head")) & _is(F.element_at("head", F.least(colon, F.size("head"))), ":"))
    fields = fields.withColumn("field", F.concat(first["text"], F.lit(": "), text(colon + 1, F.size("head"))))

    none = F.lit(None).cast("string")
    keep = lambda df, m=None: df.select("path", "language", "name", "kind", F.col("owner_line").alias("line"), (none if m else F.col("field")).alias("field"), (F.col(m) if m else none).alias("method"), "at")
    return reduce(DataFrame.unionByName, [keep(typed), keep(property_), keep(php), keep(named), keep(go), keep(embedded, "method"), keep(variants), keep(fields)])


def annotated_members(rows: DataFrame, heads: DataFrame, source: DataFrame, parts: int | None = None) -> DataFrame:
    """``path, language, owner, owner_notes, at, notes, type, name``: the fields of Java classes, the properties of C# classes
    or the typed members of scripts' classes, and what their records list, with the annotations, attributes or decorators
    before them and before their class."""
    annotated = F.col("language").isin("java", "csharp", "script")
    rows, heads, t = rows.filter(annotated), heads.filter(annotated), F.col("t")
    place = F.greatest(_first(t, lambda x: (x["line"] == F.col("line")) & (x["text"] == F.col("name"))), F.lit(1))
    told = joined(heads.withColumn("i", F.coalesce("body", "listed")), rows.select("path", "t", F.explode(F.transform("t", lambda x: x["i"])).alias("i")), ["path", "i"], parts=parts)
    told = joined(told, source, ["path"], parts=parts)
    told = told.select("path", "name", "kind", "body", "listed", _cut(F.col("source"), F.element_at(t, 1)["at"], F.element_at(t, place)["at"]).alias("owner_notes"))
    blocks = told.select("path", F.col("name").alias("owner"), "owner_notes", F.explode(F.array_compact(F.array("body", "listed"))).alias("block"), "listed", "kind")
    inner = joined(rows, blocks.filter("kind != 'enum'"), ["path", "block"], parts=parts).filter(~_declares() | (F.col("block") == F.col("listed")))
    inner = joined(inner, source, ["path"], parts=parts)
    listed = F.coalesce(F.col("block") == F.col("listed"), F.lit(False))
    each = inner.select("path", "language", "owner", "owner_notes", "source", listed.alias("listed"), F.explode(F.when(listed, parts_of(t)).otherwise(F.array("t"))).alias("t"))
    language = F.col("language")
    end = _first(t, lambda x: _is(x, "=", "{", ";", "=>", ","))
    each = each.withColumn("end", F.when(end > 0, end).otherwise(F.size(t) + 1)).withColumn("lead", _lead(t, language)).filter("lead > 0 and lead < end")
    each = each.withColumn("head", F.slice("t", F.lit(1), F.col("end") - 1)).withColumn("h", _texts(F.slice("t", F.col("lead"), F.col("end") - F.col("lead"))))
    text = lambda a, b: _cut(F.col("source"), F.element_at(t, a)["at"], F.element_at(t, b)["until"])
    ended = F.get(t, F.col("end") - 1)["text"]
    last = F.element_at(F.filter("head", lambda x: (x["angle"] == 0) & (x["kind"] == "word")), -1)
    n = _first(F.col("head"), lambda x: x["i"] == last["i"])
    typed = (n > F.col("lead")) & ~F.col("h").rlike(r"\( \)|^(?:delegate|event|return|package|import|using|throw) ")
    fits = F.col("listed") | (language == "java") & ended.isin(";", "=", ",") | (language == "csharp") & ended.isin("{", "=>")
    colon = _first(F.col("head"), lambda x: _is(x, ":"))
    script = (language == "script") & (colon > F.col("lead")) & F.col("h").rlike(r"^[\w$#]+(?: [?!])? :")
    notes = F.when(F.col("lead") > 1, text(F.lit(1), F.col("lead") - 1)).otherwise(F.lit(""))
    out = each.filter(F.when(language == "script", script & (colon < F.size("head"))).otherwise(typed & fits))
    kind = F.when(language == "script", text(colon + 1, F.size("head"))).otherwise(text(F.col("lead"), n - 1))
    name = F.when(language == "script", F.element_at("head", F.col("lead"))["text"]).otherwise(last["text"])
    return out.select("path", "language", "owner", "owner_notes", F.element_at(t, 1)["i"].alias("at"), notes.alias("notes"), kind.alias("type"), name.alias("name"))


def entries(rows: DataFrame, opened: DataFrame, source: DataFrame, angles: bool = False, parts: int | None = None) -> DataFrame:
    """The comma-parted entries of blocks: ``opened`` has ``path, block`` and what else is known of a block; ``text`` is an
    entry's source in one line, ``at`` its place, ``t`` its tokens."""
    inner = joined(rows.select("path", "block", "t"), opened, ["path", "block"], parts=parts)
    each = joined(inner.select(*opened.columns, F.explode(parts_of(F.col("t"), angles=angles)).alias("t")), source, ["path"], parts=parts)
    t = F.col("t")
    return each.select(*opened.columns, F.element_at(t, 1)["i"].alias("at"), _cut(F.col("source"), F.element_at(t, 1)["at"], F.element_at(t, -1)["until"]).alias("text"), "t", "source")


def _listed(heads: DataFrame, rows: DataFrame, source: DataFrame, parts: int) -> DataFrame:
    """Members among parameters: those of a record or primary constructor, of a tuple struct by their place, and those of a
    constructor with a modifier."""
    primary = heads.filter("listed is not null").filter(F.col("language").isin("java", "csharp", "rust")).select("path", "name", "kind", F.col("line").alias("owner_line"), F.col("listed").alias("block"), F.lit(True).alias("primary"))
    owners = heads.filter("body is not null").filter(F.col("language").isin("php", "script")).select("path", "name", "kind", F.col("line").alias("owner_line"), F.col("body").alias("block"))
    calls = joined(rows, owners, ["path", "block"], parts=parts).filter(F.col("flat").rlike(r"\b(?:__construct|constructor) \( \)"))
    paren = _first(F.col("t"), lambda x: _is(x, "("))
    inner = calls.select("path", "name", "kind", "owner_line", F.element_at("t", paren)["i"].alias("block"), F.lit(False).alias("primary"))
    given = joined(joined(rows, primary.unionByName(inner), ["path", "block"], parts=parts), source, ["path"], parts=parts)
    each = given.select("path", "language", "name", "kind", "owner_line", "source", "primary", F.posexplode(parts_of(F.col("t"))).alias("n", "t"))
    t, language = F.col("t"), F.col("language")
    promoted = F.exists(t, lambda x: (x["kind"] == "word") & x["text"].isin("public", "private", "protected", "readonly"))
    value = _first(t, lambda x: _is(x, "="))
    each = each.filter(F.col("primary") | promoted).withColumn("lead", _lead(t, language)).withColumn("end", F.when(value > 0, value - 1).otherwise(F.size(t))).filter("lead > 0")
    head = F.slice("t", F.lit(1), F.col("end"))
    words = F.filter(head, lambda x: (x["angle"] == 0) & (x["kind"] == "word"))
    last = F.element_at(words, -1)
    n = _first(t, lambda x: x["i"] == last["i"])
    text = lambda a, b: _cut(F.col("source"), F.element_at(t, a)["at"], F.element_at(t, b)["until"])
    typed = F.when(n > F.col("lead"), F.concat(text(F.col("lead"), n - 1), F.lit(" "), last["text"])).otherwise(last["text"])
    colon = _first(t, lambda x: _is(x, ":"))
    named = F.element_at(t, F.col("lead"))["text"]
    script = F.when(colon > 0, F.concat(named, F.lit(": "), text(colon + 1, F.col("end")))).otherwise(named)
    field = F.when(language == "rust", F.concat(F.col("n").cast("string"), F.lit(": "), text(F.col("lead"), F.col("end")))).when(language == "script", script).otherwise(typed)
    return each.select("path", "language", "name", "kind", F.col("owner_line").alias("line"), field.alias("field"), F.lit(None).cast("string").alias("method"), F.element_at(t, 1)["i"].alias("at"))


def _receivers(rows: DataFrame, source: DataFrame, parts: int) -> DataFrame:
    """Go's functions of a receiver, as methods of its type."""
    shape = r"^func \( \) (\w+) \( \)"
    t = F.col("t")
    called = rows.filter((F.col("language") == "go") & F.col("flat").rlike(shape)).select("path", "language", "t", "stop", "flat", F.element_at("t", 2)["i"].alias("block"), F.element_at("t", 1)["line"].alias("line"))
    types = rows.filter("language = 'go'").select("path", "block", F.element_at(F.filter("t", lambda x: x["kind"] == "word"), -1)["text"].alias("name"))
    found = joined(joined(called, types, ["path", "block"], parts=parts), source, ["path"], parts=parts)
    stop = F.when(F.col("stop") <= F.size(t), F.element_at(t, F.least(F.col("stop"), F.size(t)))["at"]).otherwise(F.element_at(t, -1)["until"])
    after = _cut(F.col("source"), F.element_at(t, 6)["until"], stop)
    suffix = F.when(after != "", F.concat(F.lit(" "), after)).otherwise(F.lit(""))
    method = _signature(t, F.lit(5), F.regexp_extract("flat", shape, 1), suffix)
    return found.select("path", "language", "name", F.lit("struct").alias("kind"), "line", F.lit(None).cast("string").alias("field"), method.alias("method"), F.element_at(t, 1)["i"].alias("at"))


def _functions(rows: DataFrame, source: DataFrame, parts: int) -> DataFrame:
    """Components and handlers of scripts at the top of their file: what they take, as one method."""
    flat = F.col("flat")
    tops = rows.filter((F.col("language") == "script") & (F.col("block") == -1) & flat.rlike(f"{_FUNCTION}|{_ARROW}"))
    tops = joined(tops, source, ["path"], parts=parts)
    function = flat.rlike(_FUNCTION)
    name = F.when(function, F.regexp_extract(flat, _FUNCTION, 1)).otherwise(F.regexp_extract(flat, _ARROW, 1))
    t = F.col("t")
    equals = _first(t, lambda x: _is(x, "="))
    after = F.when(function, F.lit(0)).otherwise(equals)
    lists = F.filter(F.transform(t, lambda x, n: F.when(_is(x, "(") & (n >= after), n + 1)), lambda n: n.isNotNull())
    found = tops.withColumns({"name": name, "paren": F.get(lists, F.lit(0)).cast("int")})
    bare = F.concat(F.lit("("), F.get(F.filter(t, lambda x: (x["kind"] == "word") & (x["i"] > F.element_at(t, F.greatest(equals, F.lit(1)))["i"]) & (x["text"] != "async")), F.lit(0))["text"], F.lit(")"))
    arrow = _first(t, lambda x: _is(x, "=>"))
    told = F.when(F.col("name").isin(*_HANDLERS), F.lit("handler")).otherwise(F.lit("render"))
    method = F.when((F.col("paren").isNull()) | ~function & (arrow > 0) & (F.col("paren") > arrow), F.concat(told, bare)).otherwise(_signature(t, F.greatest(F.coalesce("paren", F.lit(1)), F.lit(1)), told, F.lit("")))
    return found.select("path", "language", "name", F.lit("function").alias("kind"), F.element_at(t, 1)["line"].alias("line"), F.lit(None).cast("string").alias("field"), method.alias("method"), F.element_at(t, 1)["i"].alias("at"))


def _python_classes(source: str) -> Iterator[tuple]:
    def named(b: ast.expr) -> str | None:
        return b.id if isinstance(b, ast.Name) else f"{named(b.value)}.{b.attr}" if isinstance(b, ast.Attribute) else None

    for c in ast.walk(ast.parse(source)):
        if isinstance(c, ast.ClassDef):
            methods = [f"{f.name}({', '.join(a.arg for a in f.args.args if a.arg != 'self')})" for f in c.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))]
            typed = [f"{a.target.id}: {ast.unparse(a.annotation)}" for a in c.body if isinstance(a, ast.AnnAssign) and isinstance(a.target, ast.Name)]
            plain = [t.id for a in c.body if isinstance(a, ast.Assign) for t in a.targets if isinstance(t, ast.Name)]
            own = [n.attr for f in c.body if isinstance(f, ast.FunctionDef) and f.name == "__init__" for a in ast.walk(f) if isinstance(a, ast.Assign) for n in a.targets if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self"]
            yield c.name, [b for b in map(named, c.bases) if b], list(dict.fromkeys(typed + plain + own)), methods, c.lineno


def python_classes(files: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, "python", path.removesuffix(".py").replace("/", "."), n, b, a, m, False, at) for n, b, a, m, at in _python_classes(content)]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.filter(F.col("ext") == ".py").select("path", "content").mapInPandas(run, SCHEMA)


def classes(files: DataFrame | Parsed) -> DataFrame:
    """Classes of all languages."""
    of = parsed(files)
    return python_classes(of.files).unionByName(brace_classes(of))


def class_edges(found: DataFrame) -> DataFrame:
    """``src, dst, kind``: inheritance between known classes; association to classes that attributes name; a weaker
    dependency on those that only methods name; factories to what they make. The last definition of a name counts."""
    names = found.groupBy("name").agg(F.max("path").alias("_p")).select(F.col("name").alias("dst"))
    base = found.select(F.col("name").alias("src"), F.explode("bases").alias("b")).select("src", F.element_at(F.split("b", r"[.\\]"), -1).alias("dst"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.array_join(c, " "), F.lit(r"\b([A-Z]\w*)\b"), F.lit(1)))
    strong = found.select(F.col("name").alias("src"), F.explode(words("attributes")).alias("dst")).filter("src != dst").join(names, "dst", "left_semi").distinct()
    weak = found.select(F.col("name").alias("src"), F.explode(words("methods")).alias("dst")).filter("src != dst").join(names, "dst", "left_semi").distinct()
    weak = weak.join(strong, ["src", "dst"], "left_anti")
    made = found.filter(F.col("name").rlike("^.+Factory$")).select(F.col("name").alias("src"), F.regexp_replace("name", "Factory$", "").alias("dst")).join(names, "dst", "left_semi").distinct()
    kinds = ((base.join(names, "dst", "left_semi").distinct(), "INHERITS"), (strong, "ASSOCIATION"), (weak, "DEPENDS_ON"), (made, "GENERATES"))
    out = None
    for edges, kind in kinds:
        part = edges.select("src", "dst", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out
