"""Surrogates for personal data: keyed, type-consistent replacements that keep gender, script and format.

Entities are detected in every text and brought to a canonical form, so that two spellings of one number are one
entity. A keyed hash of type and canonical form draws the surrogate, hence an entity has the same one wherever it
occurs. All distinct entities are then checked against each other, numbers of all kinds together and names too: of
several with one surrogate only the first keeps it, and a surrogate that is itself an entity of the corpus goes too; the
others draw again until all are distinct. A form that leaves little room grows after some draws, so that this ends: names
by a syllable, mail addresses by letters, numbers by a digit. Domains are entities of their own, settled before the
addresses. Entities are detected once, and written beside the texts; of the surrogates only those of entities that drew
again travel to them, all others follow from the key.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import cut, slices

#: Entities that drew again and may be sent to all tasks at once; more are joined to their documents.
BROADCAST_REDRAWN = 100_000

#: Draws in the entity's own form before it grows.
DRAWS = 4
#: Country codes of one and of two digits; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Titles by gender, and name syllables by script.
TITLES = {
    "F": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Mlle", "Mademoiselle", "Госпожа", "Г-жа", "Κυρία"),
    "M": ("Mr", "Mister", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Г-н", "Κύριος"),
    "U": ("Dr", "Dra", "Prof", "Doctor", "Professor"),
}
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fi", "ga", "ka", "ke", "la", "le", "li", "ma", "me", "mi", "na", "ne", "no", "ra", "re", "ri", "sa", "se", "ta", "te", "to", "va", "vi"),
    "cyrillic": ("ба", "бе", "бо", "да", "де", "до", "га", "ка", "ке", "ла", "ле", "ли", "ма", "ме", "ми", "на", "не", "но", "ра", "ре", "ри", "са", "се", "та", "те", "то", "ва", "ви"),
    "greek": ("βα", "βε", "βο", "δα", "δε", "δο", "γα", "κα", "κε", "λα", "λε", "λι", "μα", "με", "μι", "να", "νε", "νο", "ρα", "ρε", "ρι", "σα", "σε", "τα", "τε", "το"),
}
ENDINGS = {
    "latin": {"F": "lina", "M": "ron", "U": "sen"},
    "cyrillic": {"F": "лина", "M": "рон", "U": "сен"},
    "greek": {"F": "λινα", "M": "ρος", "U": "σεν"},
}

_GENDER = {t.casefold(): g for g, ts in TITLES.items() for t in ts}
_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
_NAME = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
_ONE_TITLE = re.compile(_TITLE, re.IGNORECASE)
_POSSESSIVE = re.compile(r"['’]s$", re.IGNORECASE)
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PART = re.compile(r"[^\W\d_]+")
_FOUND = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+[^\W\d_]{2,})"
    r"|(?P<secret>\b(?:token|secret|password|passwd|api[_-]?key)\b\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9+/_-]{16,})[\"']?)"
    r"|(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d))"
    r"|(?P<ip6>(?<![\w:.])(?:[0-9a-f]{1,4}:){2,7}(?::?[0-9a-f]{1,4}|:)(?::[0-9a-f]{1,4}){0,6}(?![\w:]))"
    r"|(?P<phone>(?<![\w.])(?:\+[1-9]\d{7,14}|\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{2,4}(?:[ .-]\d{2,4}){1,3})|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4})(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.])\d{4}(?:[ -]?\d{4}){3}(?!\w))"
    rf"|(?P<person>\b(?P<titles>(?:{_TITLE})\.?[  ](?:(?:{_TITLE})\.?[  ])*)(?:[^\W\d_]\.[  ]?){{0,3}}(?P<names>{_NAME}(?:[  ]{_NAME}){{0,2}}))",
    re.IGNORECASE,
)
#: Texts without any of these, case folded, and without a digit or @, have no entity. A title is followed by one of three.
_HINTS = tuple(sorted({t.casefold() + e for t in _GENDER for e in (".", " ", "\u00a0")} | {"token", "secret", "password", "passwd", "api"}))
_DIGIT = re.compile(r"[\d@]")


def _folded(text: str) -> str:
    """Case folded as far as _FOUND ignores case: it takes both Turkish i for i."""
    return text.casefold().replace("ı", "i").replace("\u0307", "")


def _hinted(text: str) -> bool:
    if _DIGIT.search(text):
        return True
    folded = _folded(text)
    return any(h in folded for h in _HINTS)


def _script(word: str) -> str:
    return "greek" if any("Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" for c in word) else "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


@dataclass(frozen=True)
class Span:
    """``start`` to ``end`` in code points holds an entity: of ``kind``, as it stands and in canonical form."""

    start: int
    end: int
    kind: str
    text: str
    canonical: str


def detect(text: str | None) -> list[Span]:
    """The entities of a text in order, without overlap. A name is an entity a word, as first names and surnames occur
    alone too; its kind holds gender (by the title) and script. A word that is named behind a title is an entity wherever else the
    text has it capitalised, of the kind of its first naming; a title without gender takes that of another naming."""
    out: list[Span] = []
    if not text or not _hinted(text):
        return out
    pos = 0
    while m := _FOUND.search(text, pos):
        pos = m.end()
        kind = m.lastgroup if m.lastgroup in ("email", "ip", "ip6", "phone", "ssn", "card") else "secret" if m["secret"] else "person"
        if kind == "ip6" and (address := _address(m["ip6"])) is None:
            continue
        if kind == "person":
            titles = (_GENDER[t[0].casefold()] for t in _ONE_TITLE.finditer(_folded(m["titles"])))
            gender = next((g for g in titles if g != "U"), "U")
            words = list(re.finditer(_NAME, m["names"]))
            taken = []
            for w in words:  # capitalised words only
                if not w[0][0].isupper():
                    break
                taken.append(w)
            pos = m.start("names") + (taken[-1].end() if taken else 0)
            for k, w in enumerate(taken):
                role = f"given_{gender}" if k < len(taken) - 1 else "surname"
                at, name = m.start("names") + w.start(), _POSSESSIVE.sub("", w[0])
                out.append(Span(at, at + len(name), f"{role}_{_script(name)}", name, name.lower()))
            continue
        a, b = m.span("value") if kind == "secret" else m.span(kind)
        one = text[a:b]
        canonical = address if kind == "ip6" else one.lower() if kind == "email" else re.sub(r"\D", "", one) if kind in ("phone", "ssn", "card") else one
        if kind in ("phone", "card", "ssn"):
            kind += str(len(canonical))
        if kind.startswith("phone") and one.startswith("+"):
            kind += f"c{next((n for n in (1, 2) if canonical[:n] in SHORT_CODES), 3)}"  # the country code stays
        out.append(Span(a, b, kind, one, canonical))
    return _with_mentions(text, out)


def _address(text: str) -> str | None:
    """A version 6 address in full; None if it is none, or so short that it may be a name in a program."""
    try:
        found = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return found.exploded if len(re.findall(r"\w+", text)) > 2 else None


def _with_mentions(text: str, spans: list[Span]) -> list[Span]:
    """``spans`` and the other capitalised mentions of the words that are named in them, in order."""
    gendered: dict[str, str] = {}
    for s in spans:
        if s.kind.startswith(("given_F", "given_M")):
            gendered.setdefault(s.canonical, s.kind)
    spans = [replace(s, kind=gendered.get(s.canonical, s.kind)) if s.kind.startswith("given_U") else s for s in spans]
    named: dict[str, str] = {}
    for s in spans:
        if s.kind.startswith(("given_", "surname_")):
            named.setdefault(s.canonical, s.kind)
    if not named:
        return spans
    found, k = [], 0
    for m in _WORDS.finditer(text):
        parts, i = list(_PART.finditer(m[0])), 0
        while i < len(parts):
            for j in range(len(parts), i, -1):  # the longest run of parts that is a name
                a, b = m.start() + parts[i].start(), m.start() + parts[j - 1].end()
                if text[a].isupper() and text[a:b].lower() in named:
                    while k < len(spans) and spans[k].end <= a:
                        k += 1
                    if k == len(spans) or spans[k].start >= b:
                        found.append(Span(a, b, named[text[a:b].lower()], text[a:b], text[a:b].lower()))
                    i = j - 1
                    break
            i += 1
    return sorted(spans + found, key=lambda s: s.start)


class _Draw:
    """A stream of numbers that key, kind, entity and attempt decide."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.seed, self.block, self.n, self.key = f"{kind}\0{canonical}\0{attempt}".encode(), 0, 0, key

    def below(self, n: int) -> int:
        if self.n < 1 << 32:
            self.block += 1
            digest = hmac.new(self.key, self.block.to_bytes(4, "big") + self.seed, hashlib.sha256).digest()
            self.value, self.n = int.from_bytes(digest, "big"), 1 << 256
        self.value, r = divmod(self.value, n)
        self.n //= n
        return r


def _like(text: str, draw: _Draw) -> str:
    """Each letter and digit replaced by one of its sort."""
    out = []
    for c in text:
        if "0" <= c <= "9":
            out.append(str(draw.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + draw.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + draw.below(26)))
        elif c.isalpha():
            syllables = SYLLABLES[_script(c)]
            letter = syllables[draw.below(len(syllables))][0]
            out.append(letter.upper() if c.isupper() else letter)
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0, inner: int = 0) -> str:
    """The canonical form of the entity's surrogate at this attempt; ``inner`` is the attempt of a mail address's domain.
    Later attempts have a larger space: every DRAWS ones, the form grows."""
    draw, more = _Draw(key, kind, canonical, attempt), attempt // DRAWS
    digits = lambda n: "".join(str(draw.below(10)) for _ in range(n))
    if kind == "email":
        local, _, domain = canonical.partition("@")
        return f"{_like(local + 'x' * more, draw)}@{surrogate(key, 'domain', domain, inner)}"
    if kind == "domain":  # under a name that is reserved for examples
        return f"{_like(canonical.rpartition('.')[0] + 'x' * more, draw)}.example"
    if kind == "ip":
        first = 1 + draw.below(222)
        return ".".join(map(str, (first if first < 127 else first + 1, draw.below(256), draw.below(256), draw.below(256))))
    if kind == "ip6":  # in the range that is reserved for documents
        return ":".join(["2001", "0db8", *(f"{draw.below(65536):04x}" for _ in range(6))])
    if kind.startswith("card"):
        number = canonical[0] + digits(len(canonical) - 2 + more)
        check = next(d for d in "0123456789" if (_luhn(number + d) == 0))
        if _luhn(canonical) != 0:  # one that was not valid stays so
            check = str((int(check) + 1 + draw.below(9)) % 10)
        return number + check
    if kind.startswith(("phone", "ssn")):
        kept = int(kind.partition("c")[2] or 0)
        return canonical[:kept] + digits(len(canonical) - kept + more)
    if kind == "secret":
        hexadecimal = all(c in "0123456789abcdef" for c in canonical)
        return "".join("0123456789abcdef"[draw.below(16)] for _ in canonical) if hexadecimal else _like(canonical, draw)
    role, script = kind.rsplit("_", 1)
    syllables, gender = SYLLABLES[script], role[-1] if role.startswith("given") else "U"
    return "".join(syllables[draw.below(len(syllables))] for _ in range(3 + more)) + ENDINGS[script][gender]


def rendered(kind: str, text: str, form: str) -> str:
    """A canonical surrogate in the format of the occurrence ``text``: its separators, its capitals. Digits that the form
    has more come last."""
    if kind.startswith(("phone", "card", "ssn")):
        digits = iter(form)
        return "".join(next(digits) if c.isdigit() else c for c in text) + "".join(digits)
    if kind == "ip6":
        short = ipaddress.IPv6Address(form).compressed
        return short.upper() if text.isupper() else short
    if kind == "email":
        return form.upper() if text.isupper() else form
    if kind in ("ip", "secret"):
        return form
    return form.upper() if text.isupper() and len(text) > 1 else form[0].upper() + form[1:]


def _domain(kind: str, canonical: str) -> tuple[str, str]:
    return ("domain", canonical.partition("@")[2]) if kind == "email" else ("", "")


def with_forms(text: str | None, spans: list[tuple[int, int, str, str]], key: bytes, redrawn: dict[tuple[str, str], int]) -> str | None:
    """The text with its spans (start, end, kind, canonical) replaced. ``redrawn`` has the attempts of entities that drew
    again."""
    out, at = [], 0
    for start, end, kind, canonical in spans:
        form = surrogate(key, kind, canonical, redrawn.get((kind, canonical), 0), redrawn.get(_domain(kind, canonical), 0))
        out += [text[at:start], rendered(kind, text[start:end], form)]
        at = end
    return "".join(out) + text[at:] if spans else text


def replaced(text: str | None, key: bytes, redrawn: dict[tuple[str, str], int]) -> tuple[str | None, list[Span]]:
    """The text with all entities replaced, and its spans."""
    spans = detect(text)
    return with_forms(text, [(s.start, s.end, s.kind, s.canonical) for s in spans], key, redrawn), spans


_SPANS = "array<struct<start:int,end:int,kind:string,canonical:string>>"
_ROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("canonical", pa.string())]))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, spans`` of every row: what its whole text names, by position (code points), kind and canonical
    form. A null text has no spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                spans = [[{"start": s.start, "end": s.end, "kind": s.kind, "canonical": s.canonical} for s in detect(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, _ROW_SPANS)], ["doc_id", "text", "spans"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id long, text string, spans {_SPANS}")


def entities(found: DataFrame) -> DataFrame:
    """``doc_id, kind, canonical`` of the distinct entities of marked rows, the domains of mail addresses among them."""
    each = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.kind", "s.canonical").distinct()
    domains = each.filter("kind = 'email'").select("doc_id", F.lit("domain").alias("kind"), F.substring_index("canonical", "@", -1).alias("canonical"))
    return each.unionByName(domains.distinct())


def distinct_surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, canonical, attempt, form`` of every distinct entity of ``found``, with no form twice among the numbers, the
    names, or another kind, and none that is an entity there. Each round's rows are written down; as forms grow, the
    rounds end."""
    schema = "kind string, canonical string, attempt int, inner int, form string"

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [surrogate(key, *row) for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(forms, pa.string())], [c.split()[0] for c in schema.split(", ")])

    kind = F.col("kind")
    space = F.when(kind.rlike("^(phone|ssn|card)"), "number").when(kind.rlike("^(given|surname)_"), "name").otherwise(kind).alias("space")

    def settled(entities: DataFrame) -> DataFrame:
        """``entities``: kind, canonical, inner."""
        state = cut(entities.select("kind", "canonical", F.lit(0).alias("attempt"), "inner").mapInArrow(drawn, schema), "drawn")
        names = entities.select(space, F.col("canonical").alias("form"), F.lit(True).alias("real")).distinct()
        while True:
            placed = state.withColumn("space", space)
            first = placed.groupBy("space", "form").agg(F.min(F.struct("attempt", "canonical", "kind")).alias("first"))
            judged = placed.join(first, ["space", "form"]).join(names, ["space", "form"], "left")
            lost = (F.col("first.canonical") != F.col("canonical")) | (F.col("first.kind") != kind) | F.coalesce("real", F.lit(False))
            judged = cut(judged.select("kind", "canonical", "attempt", "inner", "form", lost.alias("lost")), "judged")
            again = judged.filter("lost")
            if again.isEmpty():
                return judged.drop("lost")
            again = again.select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"), "inner").mapInArrow(drawn, schema)
            state = cut(judged.filter("not lost").drop("lost").unionByName(again), "drawn")

    every = cut(found.select("kind", "canonical").distinct(), "entities")
    others = settled(every.filter("kind <> 'email'").withColumn("inner", F.lit(0)))
    inner = others.filter("kind = 'domain'").select(F.col("canonical").alias("_domain"), F.col("attempt").alias("inner"))
    mails = every.filter("kind = 'email'").join(inner, F.substring_index("canonical", "@", -1) == F.col("_domain"), "left")
    mails = settled(mails.select("kind", "canonical", F.coalesce("inner", F.lit(0)).alias("inner")))
    return others.unionByName(mails).drop("inner")


def with_surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_entities, kinds`` for every row of ``docs``: the text with surrogates, how many entities it
    had and their distinct kinds (sorted). Texts without entities come back as they are, a null text as null with no
    entities; a null id keeps its row; repeated rows come out alike; other columns are ignored; an empty table gives an
    empty result."""
    spark = docs.sparkSession
    rows = cut(marked(docs, id_col, text_col), "marked")
    occurrences = entities(rows)
    redrawn = cut(distinct_surrogates(occurrences, key).filter("attempt > 0").select("kind", "canonical", "attempt"), "redrawn")
    few: dict[tuple[str, str], int] = {}
    if redrawn.count() <= BROADCAST_REDRAWN:
        few = {(r["kind"], r["canonical"]): r["attempt"] for r in redrawn.collect()}
    else:
        own = occurrences.join(redrawn, ["kind", "canonical"]).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("own"))
        own = cut(own, "ownredrawn")
        rows = rows.alias("d").join(own.alias("o"), F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")), "left").select("d.doc_id", "d.text", "d.spans", "o.own")
    shared = spark.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                owns = part.column(3).to_pylist() if part.num_columns > 3 else [None] * part.num_rows
                texts, counts, kinds = [], [], []
                for text, spans, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), owns, strict=True):
                    attempts = {(o["kind"], o["canonical"]): o["attempt"] for o in own} if own else shared.value
                    texts.append(with_forms(text, [(s["start"], s["end"], s["kind"], s["canonical"]) for s in spans], key, attempts))
                    counts.append(len(spans))
                    kinds.append(sorted({re.sub(r"(?<!ip)\d+(c\d+)?$", "", s["kind"]) for s in spans}))
                columns = [part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(kinds, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_entities", "kinds"])

    return rows.mapInArrow(run, "doc_id long, text string, n_entities int, kinds array<string>")
