"""JSON within bounds, as column expressions: how deep and how large a text is, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of brackets, values and keys.
DEPTH, NODES = 64, 10_000
_STRING = r'"(?:[^"\\]|\\.)*+"'


def _bare(text: Column) -> Column:
    """The text with every string as one quotation mark, so that brackets in strings don't count."""
    return F.regexp_replace(text, _STRING, '"')


def json_depth(text: Column) -> Column:
    """``depth`` and ``ends``: the most brackets that are open at a time, and how often none is open any more; a closing
    bracket too many doesn't count. Brackets are what counts, so it also holds for a text that is not JSON."""
    brackets = F.regexp_extract_all(_bare(text), F.lit(r"[\[\]{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("depth"), F.lit(0).alias("ends"))

    def step(s: Column, b: Column) -> Column:
        now = F.when(b.isin("[", "{"), s["now"] + 1).otherwise(F.greatest(s["now"] - 1, F.lit(0)))
        return F.struct(now.alias("now"), F.greatest(s["depth"], now).alias("depth"), (s["ends"] + (now == 0).cast("int")).alias("ends"))

    return F.aggregate(brackets, start, step, lambda s: F.struct(s["depth"].alias("depth"), s["ends"].alias("ends")))


def json_nodes(text: Column) -> Column:
    """How many values and keys a JSON text has: strings (keys are strings too), numbers, true, false, null, brackets."""
    return F.regexp_count(_bare(text), F.lit(r'"|[\[{]|[^\s\[\]{}",:]+'))


def json_problem(text: Column, depth: int = DEPTH, nodes: int = NODES) -> Column:
    """Null for a JSON object or array within the bounds, else JSON_DEPTH, INVALID_JSON (also numbers that aren't finite,
    single quotes, text behind the value), JSON_DUPLICATE_KEY (of any object, escapes resolved) or JSON_NODES."""
    found = json_depth(text)
    strict = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    one = text.rlike(r"(?s)^\s*[\[{].*[\]}]\s*$") & (found["ends"] == 1)
    # a variant has no place for repeated keys; a map of one object, or an array of values, has
    read = F.coalesce(F.from_json(text, "map<string,string>", strict).isNotNull(), F.lit(False)) | F.coalesce(F.from_json(text, "array<string>", strict).isNotNull() & text.rlike(r"^\s*\["), F.lit(False))
    broken = F.try_parse_json(text).isNull()
    return (
        F.when(text.isNull(), "INVALID_JSON")
        .when(found["depth"] > depth, "JSON_DEPTH")
        .when(~one | (broken & ~read), "INVALID_JSON")
        .when(broken, "JSON_DUPLICATE_KEY")
        .when(json_nodes(text) > nodes, "JSON_NODES")
    )


def shape_problem(text: Column, objects: tuple[str, ...] = (), lists: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> Column:
    """SCHEMA_INVALID where a JSON text is no object, a member of ``objects`` is there and no object, one of ``lists`` no
    list of objects, or one of ``texts`` no list of strings; null otherwise, for what isn't JSON too."""
    whole = F.try_parse_json(text)
    kind = lambda v: F.schema_of_variant(v)
    at = lambda name: kind(F.try_variant_get(whole, f"$.{name}", "variant"))

    def all_are(name: str, what: str) -> Column:
        each = F.try_variant_get(whole, f"$.{name}", "array<variant>")
        return at(name).isNull() | (at(name).startswith("ARRAY<") & F.coalesce(F.forall(each, lambda x: F.coalesce(kind(x).startswith(what), F.lit(False))), F.lit(False)))

    right = kind(whole).startswith("OBJECT<")
    for name in objects:
        right = right & (at(name).isNull() | at(name).startswith("OBJECT<"))
    for names, what in ((lists, "OBJECT<"), (texts, "STRING")):
        for name in names:
            right = right & all_are(name, what)
    return F.when(whole.isNotNull() & ~right, "SCHEMA_INVALID")
