"""Credentials and addresses in text: findings, redaction, exposure of sensitive entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.functions.text import any_of, extension, file_name, grade
from sediment.operators.lines import explode_lines

MARK = "***REDACTED***"

#: Provider formats as (name, severity, pattern).
RAW_RULES = (
    ("AWS Access Key", "CRITICAL", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("GitHub Token", "CRITICAL", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("GitLab Token", "CRITICAL", r"\bglpat-[A-Za-z0-9_-]{16,}"),
    ("Stripe Secret", "CRITICAL", r"\b(?:sk|rk)_live_[A-Za-z0-9]{16,}\b"),
    ("Stripe Test Key", "WARNING", r"\b(?:sk|rk)_test_[A-Za-z0-9]{16,}\b"),
    ("Stripe Webhook Secret", "CRITICAL", r"\bwhsec_[A-Za-z0-9]{16,}\b"),
    ("Model Provider Key", "CRITICAL", r"\bsk-(?:proj-|svcacct-|ant-)?[A-Za-z0-9_-]{20,}"),
    ("SendGrid Key", "CRITICAL", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    ("Twilio Key", "CRITICAL", r"\bSK[0-9a-f]{32}\b"),
    ("Slack Token", "CRITICAL", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("NPM Token", "CRITICAL", r"\bnpm_[A-Za-z0-9]{30,}\b"),
    ("Mailchimp Key", "CRITICAL", r"\b[0-9a-f]{32}-us[0-9]{1,2}\b"),
    ("JWT Hardcoded", "HIGH", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
KEY_WORDS = "password|passwd|pwd|secret|client_secret|secret_key|api_?key|access_?key|private_?key|auth_?token|access_?token|refresh_?token|token|credential"
KEY_VALUE = rf"""(?i)(?<![A-Za-z0-9])([A-Za-z0-9_.-]*?(?:{KEY_WORDS}))(["']?)(\s*(?::=|=>|=|:)\s*)(?:"([^"\r\n]*)"|'([^'\r\n]*)'|([^\s"',;#]+))"""
URI = r"(?i)\b([a-z][a-z0-9+.-]*://[^\s:/@]*:)([^\s/@]+)(@)"
BEARER = r"(?i)\b(bearer\s+)([A-Za-z0-9._~+/=-]{16,})"
PEM = r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)"
PEM_HEADER = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
IPV4 = r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"
#: What a line must hold for any of the rules to find something in it.
HINT = (
    r"(?i)AKIA|ASIA|gh[pousr]_|glpat-|[sr]k_(?:live|test)_|whsec_|sk-|SG\.|SK[0-9a-f]{8}|xox[abprs]-|npm_|-us[0-9]|eyJ|"
    + KEY_WORDS
    + r"|://[^\s/]*@|bearer\s|PRIVATE KEY|[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"
)
ENV_READS = ("os.getenv", "os.environ", "getenv", "process.env", "System.getenv", "$_ENV", "$_SERVER")
SCANNED = (".py", ".js", ".ts", ".json", ".yml", ".yaml", ".xml", ".sh", ".go", ".rs", ".cs", ".java", ".php", ".rb")
CONFIG_NAMES = (".env", ".env.local")
CONFIG_EXTENSIONS = (".yml", ".yaml", ".json", ".properties", ".ini", ".conf")
UNSAFE_FILES = (".env", ".env.local", "secrets.json", "credentials.json")
PLACEHOLDERS = ("test", "example", "dummy", "xxx", "changeme", "mysecret", "secret_key")
PLACEHOLDER_PARTS = ("your_key_here", "your_token_here", "placeholder")
SENSITIVE = ("password", "passwd", "secret", "token", "credit_card", "card_number", "cvv", "ssn", "social_security", "pin")
EXPOSING = (".py", ".js", ".ts", ".cs", ".java", ".php", ".rb")
WEIGHTS = {"CRITICAL": 20, "HIGH": 10, "WARNING": 3}


def guarded(text: Column, longest: int = 500, reads: Sequence[str] = ENV_READS) -> Column:
    """Whether a line is worth scanning: not too long, no comment, no read of an environment variable, no sample."""
    bare = F.trim(text)
    plain = (F.length(text) <= longest) & ~bare.startswith("#") & ~bare.startswith("//")
    return plain & ~any_of(text, reads) & ~any_of(F.upper(text), ("EXAMPLE", "TEMPLATE"))


def real_value(value: Column, key: Column, quoted: Column, config: Column) -> Column:
    """Whether a value found beside a key is a secret rather than a name, a placeholder or a reference."""
    low = F.lower(value)
    name_like = value.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$") | low.isin("true", "false", "none", "null", "undefined") | value.contains("(") | value.contains(")")
    sample = low.isin(*PLACEHOLDERS) | any_of(low, PLACEHOLDER_PARTS) | value.rlike(r"^<.*>$") | value.rlike(r"^\$\{.*\}$") | (value.contains("%") & value.endswith("s"))
    return (value != "") & (value != MARK) & (low != F.lower(key)) & ~(~config & ~quoted & name_like) & ~sample


def key_severity(key: Column) -> Column:
    low = F.lower(key)
    return F.when(low.rlike("pass|pwd"), F.lit("HIGH")).when(low.rlike("secret|private|access|api_?key"), F.lit("CRITICAL")).otherwise(F.lit("HIGH"))


def key_name(key: Column) -> Column:
    low = F.lower(key)
    return F.when(low.rlike("pass|pwd"), F.lit("Database Password")).when(low.rlike("api_?key|access_?key"), F.lit("API Key")).when(low.contains("token"), F.lit("Access Token")).otherwise(F.lit("Hardcoded Secret"))


def _finding(kind: Column, severity: Column, category: str, value: Column) -> Column:
    return F.struct(kind.alias("type"), severity.alias("severity"), F.lit(category).alias("category"), value.alias("_value"))


def _each(values: Column, kind: Column, severity: Column, category: str) -> Column:
    return F.transform(values, lambda v: _finding(kind, severity, category, v))


def findings_of(text: Column, config: Column | None = None) -> Column:
    """The distinct findings of a line as an array of structs ``type, severity, category, _value`` (the value must not
    come out); empty where the line is not worth scanning. One look for any hint spares most lines the rules."""
    config = F.lit(False) if config is None else config
    found = []
    for name, severity, pattern in RAW_RULES:
        kind = (F.lit(name), F.lit(severity), "Secrets")
        found.append(_each(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), *kind))
    # of each pair the key, and the value in double, in single or without quotes
    pairs = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(KEY_VALUE), F.lit(k)).alias(f"g{k}") for k in (1, 4, 5, 6)])

    def judged(p: Column) -> Column:
        value = F.coalesce(F.nullif(p["g4"], F.lit("")), F.nullif(p["g5"], F.lit("")), p["g6"])
        quoted = (p["g4"] != "") | (p["g5"] != "")
        return F.when(real_value(value, p["g1"], quoted, config), _finding(key_name(p["g1"]), key_severity(p["g1"]), "Secrets", value))

    found.append(F.array_compact(F.transform(pairs, judged)))
    found.append(F.transform(F.regexp_extract_all(text, F.lit(URI), F.lit(2)), lambda v: _finding(F.lit("Credentials in URI"), F.lit("CRITICAL"), "Secrets", v)))
    found.append(F.transform(F.regexp_extract_all(text, F.lit(BEARER), F.lit(2)), lambda v: _finding(F.lit("Bearer Token"), F.lit("CRITICAL"), "Secrets", v)))
    found.append(F.transform(F.regexp_extract_all(text, F.lit(PEM_HEADER), F.lit(0)), lambda v: _finding(F.lit("Private Key"), F.lit("CRITICAL"), "Secrets", v)))
    public = F.filter(F.regexp_extract_all(text, F.lit(IPV4), F.lit(1)), lambda v: ~v.startswith("127.") & (v != "0.0.0.0"))
    found.append(F.transform(public, lambda v: _finding(F.lit("Hardcoded IP"), F.lit("WARNING"), "Config", v)))
    every = F.filter(F.array_distinct(F.concat(*found)), lambda f: f["_value"] != MARK)
    return F.when(guarded(text) & text.rlike(HINT), every)


def chosen_findings(text: Column, rules: Sequence[tuple[str, str, str, str]], hint: Column, worth: Column) -> Column:
    """What ``findings_of`` gives, for rules of one's own: (type, severity, category, pattern), of which group 1 is the value.
    Only lines for which ``hint`` and then ``worth`` hold are looked at; local addresses are none."""
    found = [_each(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(kind), F.lit(severity), category) for kind, severity, category, pattern in rules]
    local = lambda f: (f["type"] == "Hardcoded IP") & (f["_value"].startswith("127.") | (f["_value"] == "0.0.0.0"))
    return F.when(hint & worth, F.filter(F.array_distinct(F.concat(*found)), lambda f: ~local(f)))


def line_findings(lines: DataFrame, keys: tuple[str, ...] = ("path",), config: Column | None = None, found: Column | None = None) -> DataFrame:
    """The key columns, ``line, type, severity, category, message`` of the credentials and addresses in lines (``line``,
    ``text``): those of all rules, or ``found``. All rules look at a line in one projection; equal findings of one line count
    once. Values never come out."""
    rows = lines.select(*keys, "line", F.explode(findings_of(F.col("text"), config) if found is None else found).alias("f"))
    return rows.select(*keys, "line", "f.type", "f.severity", "f.category", F.lit(f"Match: {MARK}").alias("message"))


def file_findings(files: DataFrame) -> DataFrame:
    """``path, line, type, severity, category, message`` for files (path, content): the findings of scanned files, and
    unsafe configuration files at the root (line 0)."""
    name = file_name(F.col("path"))
    scanned = files.withColumn("ext", extension(name)).filter(F.col("ext").isin(*SCANNED) | name.isin(*CONFIG_NAMES))
    config = F.col("ext").isin(*CONFIG_EXTENSIONS) | file_name(F.col("path")).isin(*CONFIG_NAMES)
    found = line_findings(explode_lines(scanned, "content", ("path", "ext")), ("path", "ext"), config).drop("ext")
    unsafe = files.filter(F.col("path").isin(*UNSAFE_FILES)).select(
        "path",
        F.lit(0).alias("line"),
        F.lit("Unsafe Configuration File").alias("type"),
        F.lit("HIGH").alias("severity"),
        F.lit("Config").alias("category"),
        F.lit("Sensitive configuration file found (ensure it is git-ignored)").alias("message"),
    )
    return unsafe.unionByName(found)


def redacted(text: Column) -> Column:
    """The text with all credentials as a mark: keys in PEM blocks, URIs, bearer tokens, values beside keys, provider
    formats, in this order. Redacting twice changes nothing more."""
    out = F.regexp_replace(text, PEM, MARK)
    out = F.regexp_replace(out, URI, f"$1{MARK}$3")
    out = F.regexp_replace(out, BEARER, f"$1{MARK}")
    quoted = rf"""(?i)(?<![A-Za-z0-9])([A-Za-z0-9_.-]*?(?:{KEY_WORDS})["']?\s*(?::=|=>|=|:)\s*)(?:"[^"\r\n]+"|'[^'\r\n]+')"""
    out = F.regexp_replace(out, quoted, f'$1"{MARK}"')
    bare = rf"""(?i)(?<![A-Za-z0-9])([A-Za-z0-9_.-]*?(?:{KEY_WORDS})["']?\s*(?::=|=>|=)\s*)(?![*"'])(?=[^\s"',;#]*[0-9])[^\s"',;#()]+(?![^\s"',;#]*\()"""
    out = F.regexp_replace(out, bare, f"$1{MARK}")
    for _, _, pattern in RAW_RULES:
        out = F.regexp_replace(out, pattern, MARK)
    return out


def risk_summary(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Findings by severity and the overall level, a row for each group."""
    count = lambda s: F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).cast("long")
    counts = found.groupBy(*by).agg(count("CRITICAL").alias("critical"), count("HIGH").alias("high"), count("WARNING").alias("warning"))
    level = F.when(F.col("critical") > 0, "CRITICAL").when(F.col("high") > 0, "HIGH").when(F.col("warning") > 3, "MEDIUM").when(F.col("warning") > 0, "LOW").otherwise("CLEAN")
    return counts.select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("critical", "high", "warning")], level.alias("level"))


def security_score(found: DataFrame) -> DataFrame:
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return found.agg(F.greatest(F.lit(0), 100 - F.coalesce(F.sum(F.coalesce(weight[F.col("severity")], F.lit(0))), F.lit(0))).cast("long").alias("score"))


def severity_order(column: str = "severity") -> list[Column]:
    rank = F.when(F.col(column) == "CRITICAL", 0).when(F.col(column) == "HIGH", 1).when(F.col(column) == "WARNING", 2).otherwise(3)
    return [rank]


def health(debt: DataFrame, risks: DataFrame, excluded: Column | None = None) -> DataFrame:
    """One row ``critical, high, warning, bugs, todos, score, grade`` of debt (path, type) and risks (path, severity),
    without the paths for which ``excluded`` (a condition on ``path``) holds; a warning also counts as high."""
    keep = ~excluded if excluded is not None else F.lit(True)
    r = risks.filter(keep).agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(a) for s, a in (("CRITICAL", "critical"), ("HIGH", "high"), ("WARNING", "warning"))])
    d = debt.filter(keep).agg(F.count(F.when(F.col("type").isin("FIXME", "BUG", "XXX"), 1)).alias("bugs"), F.count(F.when(F.col("type").isin("TODO", "HACK"), 1)).alias("todos"))
    both = r.withColumn("_one", F.lit(1)).join(d.withColumn("_one", F.lit(1)), "_one").drop("_one")  # two rows of one
    return both.withColumn("score", health_score()).withColumn("grade", health_grade(F.col("score")))


def health_score() -> Column:
    """From ``critical, high, warning, bugs, todos``: 100 less 25, 10, 10, 3 and 1 for each, from 0 to 100."""
    score = 100 - 25 * F.col("critical") - 10 * (F.col("high") + F.col("warning")) - 3 * F.col("bugs") - F.col("todos")
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long")


def health_grade(score: Column) -> Column:
    return grade(score, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F")


def sensitive_entities(entities: DataFrame) -> DataFrame:
    """``ord, entity, columns`` of the entities (ord, name, columns of structs with a name) that have sensitive columns."""
    picked = F.filter(F.transform("columns", lambda c: c["name"]), lambda n: any_of(F.lower(n), SENSITIVE))
    return entities.select("ord", F.col("name").alias("entity"), picked.alias("columns")).filter(F.size("columns") > 0)


def exposures(lines: DataFrame, entities: DataFrame) -> DataFrame:
    """``path, line, entity, columns, how`` of lines (path, line, text) that hand out a sensitive entity; the first
    entity by ``ord`` for each line. The words of a line are joined to the entities' names, so no line meets an entity
    that it doesn't mention."""
    text = F.col("text")
    bare = F.trim(text)
    telling = text.rlike(r"(?i)\b(response_model|schema|return|jsonify)\b") & ~any_of(text, ("import ", "from ", "require("))
    kept = lines.filter((F.length(text) <= 500) & ~bare.startswith("#") & ~bare.startswith("//") & telling)
    kept = kept.filter(extension(file_name(F.col("path"))).isin(*EXPOSING))
    names = entities.select("ord", "entity", "columns", F.lower("entity").alias("_low"))
    words = kept.withColumn("_low", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0)))))
    by_word = words.join(names, "_low").withColumn(
        "how",
        F.when(F.expr(r"text rlike concat('(?i)\\breturn\\s+[^;]*?\\b\\Q', _low, '\\E\\b')"), "return variable").when(
            F.expr(r"text rlike concat('(?i)\\bjsonify\\(\\s*[^)]*?\\b\\Q', _low, '\\E\\b')"), "jsonify call"
        ),
    )
    # a schema's name may have the entity's within it: all stretches of capitalised words in it
    schemas = kept.withColumn("_schema", F.explode(F.regexp_extract_all(text, F.lit(r"\b(?:response_model|schema)\s*=\s*(\w+)"), F.lit(1))))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("_schema")), lambda i: F.transform(F.sequence(F.lit(1), F.length("_schema") - i + 1), lambda n: F.substring(F.col("_schema"), i, n))))
    by_schema = schemas.withColumn("entity", F.explode(F.array_distinct(parts))).join(names, "entity").withColumn("how", F.lit("schema/model reference"))
    cols = ["path", "line", "ord", "entity", "columns", "how"]
    both = by_schema.select(*cols, F.lit(0).alias("_rank")).unionByName(by_word.filter("how is not null").select(*cols, F.lit(1).alias("_rank")))
    first = Window.partitionBy("path", "line").orderBy("ord", "_rank", "entity")
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("path", "line", "entity", F.array_join("columns", ", ").alias("columns"), "how")
