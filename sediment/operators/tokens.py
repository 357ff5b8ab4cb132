"""Source texts as tables of tokens, brackets and statements.

A small scanner finds where literals and comments end, which no regular expression can say (comments and templates nest,
raw strings choose their own end); all structure is computed on its table by window functions over one file: the depth of
a token is a running sum, its block the last bracket that opened one level up, its statement a running count of ends
within the block. Nothing has a depth or length of its own at which it stops.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Extensions of the languages that are scanned.
EXTENSIONS = {
    "java": (".java",),
    "csharp": (".cs",),
    "php": (".php",),
    "script": (".js", ".jsx", ".ts", ".tsx", ".mjs"),
    "go": (".go",),
    "rust": (".rs",),
    "sql": (".sql",),
    "prisma": (".prisma",),
}
#: Languages whose statements may end with their line.
LINE_ENDED = ("script", "go", "prisma")

_LINE, _BLOCK, _QUOTED = r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\Z)", r"\"(?:[^\"\\\n]|\\(?s:.))*\"?|'(?:[^'\\\n]|\\(?s:.))*'?"
_WORD, _NUMBER = r"[^\W\d]\w*", r"\d[\w.]*"
_SIGN = r"=>|->|::|:=|\.\.\.|\?\.|\?\?|&&|\|\||[=!]==?|[<>]=|[^\w\s]"
_TEMPLATE = r"`"
#: By language: comments, strings, what the scanner itself has to find the end of, and words.
_RULES = {
    "java": (rf"{_LINE}|{_BLOCK}", rf'"""(?s:.*?)(?:(?<!\\)"""|\Z)|{_QUOTED}', None, rf"@?{_WORD}(?:(?<=@interface))?"),
    "csharp": (rf"{_LINE}|{_BLOCK}|^[ \t]*#[^\n]*", rf'\$?@\$?"(?:[^"]|"")*"?|\$?(?:{_QUOTED})', r'\$*"{3,}', rf"@?{_WORD}"),
    "php": (rf"\A(?s:.*?)<\?(?:php\b|=)?|\?>(?s:.*?)(?:<\?(?:php\b|=)?|\Z)|//(?:(?!\?>)[^\n])*|{_BLOCK}|#(?!\[)(?:(?!\?>)[^\n])*", r"\"(?:[^\"\\]|\\(?s:.))*\"?|'(?:[^'\\]|\\(?s:.))*'?", r"<<<[ \t]*['\"]?(?P<label>\w+)['\"]?[^\n]*\n", rf"\$?{_WORD}(?:\\{_WORD})*|\\{_WORD}(?:\\{_WORD})*"),
    "script": (rf"{_LINE}|{_BLOCK}", _QUOTED, _TEMPLATE, rf"@{_WORD}(?:\.{_WORD})*|#?[^\W\d$]?[\w$]+"),
    "go": (rf"{_LINE}|{_BLOCK}", rf"`[^`]*`?|{_QUOTED}", None, _WORD),
    "rust": (_LINE, r"b?\"(?:[^\"\\]|\\(?s:.))*\"?|b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|.)[^']*)'", r"/\*|b?r#*\"", rf"'?{_WORD}!?"),
    "sql": (rf"--[^\n]*|{_BLOCK}", r"'(?:[^']|'')*'?", None, rf"\"[^\"]*\"|`[^`]*`|\[{_WORD}\]|{_WORD}"),
    "prisma": (_LINE, _QUOTED, None, rf"@{{0,2}}{_WORD}(?:\.{_WORD})*"),
}
_SCANNERS = {
    language: re.compile("|".join(f"(?P<{kind}>{rule})" for kind, rule in (("comment", comment), ("open", begins), ("string", string), ("number", _NUMBER), ("word", word), ("sign", _SIGN)) if rule), re.MULTILINE)
    for language, (comment, string, begins, word) in _RULES.items()
}
#: After these a slash begins a regular expression of a script.
_BEFORE_PATTERN = frozenset("( [ { } , ; : = => == === != !== && || ?? ? ! & | + - * % < > return typeof case in of do else void delete yield await".split())
_PATTERN = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_HOLE = re.compile(r"\\(?s:.)|`|\$\{")


def _template_end(source: str, at: int) -> int:
    """The end of the template literal that begins at ``at``: what its holes hold is scanned as well."""
    scan, depth, length = _SCANNERS["script"], [0], len(source)  # a number a template: braces open in its hole, or -1
    depth[-1], at = -1, at + 1
    while depth and at < length:
        if depth[-1] < 0:
            m = _HOLE.search(source, at)
            if not m:
                return length
            at = m.end()
            if m[0] == "`":
                depth.pop()
            elif m[0] == "${":
                depth[-1] = 0
            continue
        m = scan.search(source, at)
        if not m:
            return length
        at = m.end()
        if m[0] == "`":
            depth.append(-1)
        elif m[0] == "{":
            depth[-1] += 1
        elif m[0] == "}":
            depth[-1] -= 1  # the hole's own end leaves -1: the template goes on
    return at


def _end(source: str, m: re.Match, language: str) -> tuple[str, int]:
    """Kind and end of what the scanner has to follow itself."""
    at = m.end()
    if language == "script":
        return "string", _template_end(source, m.start())
    if language == "csharp":
        close = source.find('"' * m[0].count('"'), at)
        return "string", len(source) if close < 0 else close + m[0].count('"')
    if language == "php":
        close = re.compile(rf"^[ \t]*{m['label']}\b", re.MULTILINE).search(source, at)
        return "string", close.end() if close else len(source)
    if m[0] == "/*":
        open_, edge = 1, re.compile(r"/\*|\*/")
        while open_ and (e := edge.search(source, at)):
            open_, at = open_ + (1 if e[0] == "/*" else -1), e.end()
        return "comment", len(source) if open_ else at
    tail = '"' + "#" * m[0].count("#")
    close = source.find(tail, at)
    return "string", len(source) if close < 0 else close + len(tail)


def scanned(source: str, language: str) -> Iterator[tuple[str, int, int]]:
    """Kind (comment, string, number, word, sign), start and end of all that is no white space."""
    scan, at, last = _SCANNERS[language], 0, None
    while m := scan.search(source, at):
        kind, end = m.lastgroup, m.end()
        if kind in ("open", "label"):
            kind, end = _end(source, m, language)
        elif language == "script" and m[0] == "/" and (last is None or last in _BEFORE_PATTERN) and (p := _PATTERN.match(source, m.start())):
            kind, end = "string", p.end()
        yield kind, m.start(), end
        if kind != "comment":
            last = source[m.start() : end]
        at = end


def masked(source: str, language: str, literals: bool = True) -> str:
    """The source with its comments, and its literals unless said otherwise, as blanks; line ends and places stay."""
    out, at = [], 0
    for kind, a, b in scanned(source, language):
        if kind == "comment" or literals and kind == "string":
            out += [source[at:a], re.sub(r"[^\r\n]", " ", source[a:b])]
            at = b
    return "".join([*out, source[at:]])


#: By extension, its language.
_LANGUAGE = {ext: language for language, exts in EXTENSIONS.items() for ext in exts}
_FILE = "path string, language string, content string"


def masked_files(files: DataFrame, literals: bool = True) -> DataFrame:
    """``path, language, content`` of the files in a known language, with comments (and literals) as blanks."""
    return _scanned_files(files).mapInArrow(partial(_mask, literals=literals), _FILE)


def _scanned_files(files: DataFrame) -> DataFrame:
    known = F.create_map(*[F.lit(x) for pair in _LANGUAGE.items() for x in pair])
    return files.select("path", known[F.col("ext")].alias("language"), F.coalesce("content", F.lit("")).alias("content")).filter("language is not null")


def _mask(batches: Iterator[pa.RecordBatch], literals: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain = [masked(t, x, literals) for x, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(plain, pa.string())], ["path", "language", "content"])


_TOKEN = "path string, language string, i int, line int, at int, until int, kind string, text string"
#: Tokens that a task gives on at once.
_HELD = 50_000


def tokens(files: DataFrame, parts: int | None = None) -> DataFrame:
    """``path, language, i, line, at, until, kind, text``: the tokens of the files in a known language without comments;
    ``i`` counts them, ``at`` and ``until`` are places in the UTF-8 bytes. Files without a content have none. With ``parts``
    they are dealt by path to as many tasks; tokens compress so well that by their size in a shuffle few tasks got all."""
    found = _scanned_files(files).mapInArrow(_tokenize, _TOKEN)
    return found.repartition(parts, "path") if parts else found


def scanned_size(files: DataFrame) -> int:
    """The bytes of all files in a known language."""
    return _scanned_files(files).agg(F.sum(F.octet_length("content"))).first()[0] or 0


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _TOKEN.split(", ")]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows: list[tuple] = []
    for batch in batches:
        for path, language, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            line, seen, i, place = 1, 0, 0, 0
            for kind, a, b in scanned(source, language):
                line, place, seen = line + source.count("\n", seen, a), place + len(source[seen:a].encode()), a
                if kind != "comment":
                    rows.append((path, language, i, line, place, place + len(source[a:b].encode()), kind, source[a:b]))
                    i += 1
                if len(rows) >= _HELD:
                    yield packed(rows)
                    rows = []
    if rows:
        yield packed(rows)


def nested(found: DataFrame) -> DataFrame:
    """The tokens with ``depth`` (brackets open around them) and ``block`` (the innermost of these, by its ``i``; -1 at the
    top). A bracket is as deep as what stands around it; kinds of brackets are not told apart."""
    sign = F.col("kind") == "sign"
    opens, closes = sign & F.col("text").isin("(", "[", "{"), sign & F.col("text").isin(")", "]", "}")
    order = Window.partitionBy("path").orderBy("i")
    open_ = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order)
    deep = found.withColumn("depth", (open_ - opens.cast("int")).cast("int")).withColumn("opens", opens)
    # an opening bracket stands once more at the level of what it holds, before it
    own = F.struct("depth", F.lit(None).cast("int").alias("head"))
    places = F.when(F.col("opens"), F.array(F.struct((F.col("depth") + 1).alias("depth"), F.col("i").alias("head")), own)).otherwise(F.array(own))
    level = Window.partitionBy("path", "depth").orderBy("i", F.col("head").isNull())
    held = deep.select(*found.columns, F.inline(places)).withColumn("block", F.coalesce(F.last("head", ignorenulls=True).over(level), F.lit(-1)))
    return held.filter("head is null").drop("head")


#: What goes on with the statement of a closed brace, and what a new line doesn't end a statement before or after.
_GOES_ON = (",", ";", ".", "?.", ")", "]", "=", ":", "?", "&&", "||", "??", "as", "satisfies", "from", "instanceof")
_OPERATORS = (",", ".", "?.", "=", "+", "-", "*", "/", "%", "&&", "||", "??", "&", "|", "=>", "==", "===", "!=", "!==", "?", ":", "<", ">", "<=", ">=", "(", "[", "{", "...", "->", ":=", "::")
_LEADS_ON = (".", "?.", "=", "+", "-", "/", "%", "&&", "||", "??", "&", "|", "=>", "==", "===", "!=", "!==", "?", ":", "<", ">", "<=", ">=", ")", "]", "}", "{", "(", ",", ";", "extends", "implements", "as", "satisfies", "from")



def _one_of(text: Column | str, words: tuple[str, ...]) -> Column:
    quoted = ", ".join(f"'{w}'" for w in words)
    return F.expr(f"{text} in ({quoted})") if isinstance(text, str) else text.rlike("^(?:" + "|".join(map(re.escape, words)) + ")$")


def statements(deep: DataFrame) -> DataFrame:
    """``path, language, block, part, t``: the tokens that stand directly in each block, cut into parts after a semicolon,
    after a closed brace that nothing goes on, and where a line ends a statement. ``t`` has ``i, at, until, line, kind,
    text, angle`` of each, in order; a bracket's inside is not among them, so an opening one stands right before its
    closing one. ``angle`` counts the angle brackets open around a token within its part."""
    order = Window.partitionBy("path", "block").orderBy("i")
    before = lambda c, n=1: F.lag(c, n).over(order)
    text, last, kind, script = F.col("text"), before("text"), before("kind"), F.col("language") == "script"
    was_sign = kind == "sign"
    ends = was_sign & (last == ";") | was_sign & (last == "}") & (~_one_of("text", _GOES_ON) | script & (text == "["))
    # a decorator, with or without its list, goes on to what it stands before
    note = script & (last.startswith("@") & (kind == "word") | (last == ")") & before("text", 3).startswith("@") & (before("kind", 3) == "word"))
    operator = was_sign & _one_of(last, _OPERATORS) | last.isin("extends", "implements", "return", "new")
    led = F.when(script, _one_of("text", _LEADS_ON)).otherwise(text.isin("{", ")", "}", "]", ",", ";"))
    ends = ends | (F.col("language") == "sql") & (F.lower(text) == "create")
    line_ended = F.col("language").isin(*LINE_ENDED) & (F.col("line") > before("line")) & ~F.coalesce(note, F.lit(False)) & ~operator & ~led
    parted = deep.withColumn("part", F.sum(F.coalesce(ends | line_ended, F.lit(False)).cast("int")).over(order))
    within = Window.partitionBy("path", "block", "part").orderBy("i")
    sign = F.col("kind") == "sign"
    sharp = F.when(sign & (text == "<"), 1).when(sign & (text == ">"), -1).otherwise(0)
    angle = F.sum(sharp).over(within) - F.when(sign & (text == "<"), 1).otherwise(0)
    gathered = F.array_sort(F.collect_list(F.struct("i", "at", "until", "line", "kind", "text", "angle")))
    return parted.withColumn("angle", angle.cast("int")).groupBy("path", "block", "part").agg(F.first("language").alias("language"), gathered.alias("t"))


def parts_of(t: Column, separator: str = ",", angles: bool = True) -> Column:
    """Arrays of tokens between the separators, of types those outside angle brackets (empty ones left out)."""
    last = lambda acc: F.element_at(acc, -1)
    none = F.array(F.filter(t, lambda _: F.lit(False)))
    cut = F.aggregate(t, none, lambda acc, x: F.when((x["kind"] == "sign") & (x["text"] == separator) & ((x["angle"] == 0) | F.lit(not angles)), F.concat(acc, none)).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last(acc), F.array(x))))))
    return F.filter(cut, lambda p: F.size(p) > 0)
