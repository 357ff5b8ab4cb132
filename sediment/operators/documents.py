"""Requirement specifications and product documents as tables, and the checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.functions.bounded import json_problem, shape_problem
from sediment.functions.text import group
from sediment.operators import relational

#: Statuses, limits, section names.
STORY_STATUS = ("TODO", "IN_PROGRESS", "TESTING", "DONE", "BLOCKED")
PRODUCT_STATUS = ("DRAFT", "REVIEW", "APPROVED", "SHIPPED", "ARCHIVED")
FILE_BYTES, FILES, TOTAL_BYTES, PRODUCT_FILES = 1 << 20, 512, 8 << 20, 128
SECTIONS = ("Problem Statement", "Target Users", "Goals", "Non-Goals", "Success Metrics", "Scope", "Risks", "Rollout Plan", "Open Questions")
NO_QUESTIONS = ("none", "n/a", "na", "no open questions")
#: Codes that stay whatever part of a repository is looked at.
GLOBAL_CODES = ("PRD_PARSE_ERROR", "PRD_ID_DUPLICATE", "PRD_REQUIREMENT_ORPHAN", "PRD_APPLIES_TO_INVALID", "PRD_COLLECTION_LIMIT")
#: The folder of a repository that holds requirements and product documents, if nothing else is said.
HOME = ".project"
STORY = "struct<id:string,title:string,role:string,want:string,benefit:string,status:string>"
SPEC = (
    f"story {STORY}, id string, title string, role string, want string, benefit string, status string, "
    "business_rules array<struct<id:string,description:string>>, acceptance_criteria array<struct<id:string,given:string,when:string,then:string>>, "
    "required_data array<map<string,string>>, validations array<map<string,string>>, exceptions array<map<string,string>>, open_questions array<string>, _corrupt string"
)


def _status(c: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(c)), F.lit("")), F.lit("TODO"))


def _section(text: Column, names: str) -> Column:
    """The body of the first ``##`` section of one of ``names`` (alternatives)."""
    return group(text, rf"(?ims)^##\s*(?:{names})\s*$\n(.*?)(?=^##\s|\z)", 1)


def _items(body: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?m)^\s*[-*]\s+(.+)$"), F.lit(1))


def _numbered(items: Column, prefix: str) -> Column:
    """Items with their own id (``ID: text``) or the next default one."""
    own = r"^\**([A-Z]+-?[0-9]+)\**\s*[:.-]\s*(.+)$"
    return F.transform(items, lambda x, i: F.struct(F.coalesce(group(x, own, 1), F.format_string(f"{prefix}%02d", i + 1)).alias("id"), F.coalesce(group(x, own, 2), x).alias("description")))


#: Words in the headings of sections, in the order in which they are tried.
_HEADINGS = {"business_rules": "business rule|regla", "acceptance_criteria": "acceptance|aceptaci|criterio", "required_data": "data|dato", "validations": "validation|validaci", "exceptions": "exception|excepci"}
#: Names of what stands before and behind the colon in a line of a section, and what counts if there is none.
_PAIRS = {"required_data": ("field", "type", "string"), "validations": ("field", "rule", "custom"), "exceptions": ("code", "description", "EXCEPTION")}
_MAPS = "array<map<string,string>>"


def _pairs(text: Column, section: str) -> Column:
    """The lines ``name: value`` of all sections of a kind as maps. A line of another form is a name of its own; in
    exceptions, a description."""
    names = list(_HEADINGS)
    before = "|".join(_HEADINGS[n] for n in names[: names.index(section)])
    title = rf"(?![^\n]*(?:{before}))[^\n]*(?:{_HEADINGS[section]})[^\n]*"
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    bodies = F.regexp_extract_all(plain, F.lit(rf"(?ims)^##[ \t]{title}$\n(.*?)(?=^##?\s|\z)"), F.lit(1))
    lines = F.transform(F.split(F.array_join(bodies, "\n"), r"\R"), lambda x: F.regexp_replace(F.trim(x), r"^[-*\s]+", ""))
    name, value, rest = _PAIRS[section]
    form = r"^`?([A-Za-z0-9_$]+)`?\s*[-:]\s*(\S.*)$"

    def pair(x: Column) -> Column:
        alone = (F.lit(rest), x) if section == "exceptions" else (x, F.lit(rest))
        a, b = (F.when(x.rlike(form), F.trim(F.regexp_extract(x, form, k))).otherwise(alone[k - 1]) for k in (1, 2))
        return F.create_map(F.lit(name), a, F.lit(value), b)

    return F.transform(F.filter(lines, lambda x: x != ""), pair)


def _within(files: DataFrame, home: str, part: str, kinds: str) -> DataFrame:
    return files.filter(F.col("path").rlike(rf"(^|/)\Q{home}\E/{part}/[^/]+\.({kinds})$"))


def _limited(rows: DataFrame, root: Column, most: int) -> DataFrame:
    """``rows`` (path, content, ...) with ``_over``: whether the collection under its ``root`` has more than ``most``
    files or TOTAL_BYTES up to this one, by path. A collection is one folder of one repository."""
    order = Window.partitionBy(root).orderBy("path")
    held = F.sum(F.octet_length("content")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_over", (F.row_number().over(order) > most) | (held > TOTAL_BYTES))


def requirements(files: DataFrame, home: str = HOME) -> DataFrame:
    """``path, id, title, role, want, benefit, status, business_rules, acceptance_criteria, required_data, validations,
    exceptions, open_questions, problem`` of the specifications under ``home``/requirements (JSON, or Markdown in English or Spanish); ``problem`` says why one
    can't be read, or that its collection exceeds a limit."""
    within = _within(files, home, "requirements", "json|md|markdown")
    within = _limited(within, F.regexp_extract("path", r"^(.*)/[^/]+$", 1), FILES)
    js = within.filter(F.col("ext") == ".json").withColumn("x", F.from_json("content", SPEC, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    one = lambda c: F.coalesce(F.col(f"x.story.{c}"), F.col(f"x.{c}"))
    shape = shape_problem(F.col("content"), ("story",), ("business_rules", "acceptance_criteria", *_PAIRS), ("open_questions",))
    bound = F.when(F.octet_length("content") <= FILE_BYTES, F.coalesce(json_problem(F.col("content")), shape))  # larger ones are not looked into
    bad = F.when(bound.isNotNull(), bound).when(F.col("x").isNull() | F.col("x._corrupt").isNotNull() | F.trim("content").startswith("["), "INVALID_JSON").when(one("id").isNull(), "MISSING_ID").when(F.octet_length("content") > FILE_BYTES, "TOO_LARGE").when(F.col("_over"), "COLLECTION_LIMIT")
    criteria = "array<struct<id:string,given:string,when:string,then:string>>"
    rules = "array<struct<id:string,description:string>>"
    out = js.select("path", *[one(c).alias(c) for c in ("id", "title", "role", "want", "benefit")], _status(one("status")).alias("status"), F.coalesce("x.business_rules", F.array().cast(rules)).alias("business_rules"), F.coalesce("x.acceptance_criteria", F.array().cast(criteria)).alias("acceptance_criteria"), *[F.coalesce(f"x.{c}", F.array().cast(_MAPS)).alias(c) for c in _PAIRS], F.coalesce("x.open_questions", F.array().cast("array<string>")).alias("open_questions"), bad.alias("problem"))
    md = within.filter(F.col("ext") != ".json")
    text, head = F.col("content"), r"(?m)^#\s+([\w-]+)\s*(?:\[([^\]]*)\])?\s*[-:–]?\s*(.*)$"
    field = lambda names: group(text, rf"(?im)^\s*[-*]?\s*\**(?:{names})\**\s*:\s*\**\s*(.+)$", 1)
    given = r"(?is)(?:given|dado)\b\**:?\s*(.*?),?\s*(?:when|cuando)\b\**:?\s*(.*?),?\s*(?:then|entonces)\b\**:?\s*(.*)$"
    accepted = F.transform(_numbered(_items(_section(text, "Acceptance Criteria|Criterios de Aceptaci[oó]n")), "AC"), lambda a: F.struct(a["id"].alias("id"), *[F.trim(F.regexp_extract(a["description"], given, k)).alias(n) for k, n in ((1, "given"), (2, "when"), (3, "then"))]))
    # a field says more than the heading
    own, title = F.trim(F.coalesce(field("ID|Story ID|Identificador"), group(text, head, 1))), F.trim(F.coalesce(field("Title|T[ií]tulo"), F.regexp_extract(text, head, 3)))
    parsed = md.select(
        "path", own.alias("id"), title.alias("title"), field("Role|As a|Como").alias("role"), field("Want|I want|Quiero|Deseo").alias("want"), field("Benefit|So that|Para|Para que").alias("benefit"),
        _status(F.coalesce(field("Status|Estado"), F.regexp_extract(text, head, 2))).alias("status"), _numbered(_items(_section(text, "Business Rules|Reglas de Negocio")), "BR").cast(rules).alias("business_rules"), accepted.cast(criteria).alias("acceptance_criteria"), *[_pairs(text, c).cast(_MAPS).alias(c) for c in _PAIRS],
        _items(_section(text, "Open Questions|Preguntas Abiertas")).alias("open_questions"), F.when(own.isNull(), "MISSING_ID").when(F.octet_length(text) > FILE_BYTES, "TOO_LARGE").when(F.col("_over"), "COLLECTION_LIMIT").alias("problem"),
    )
    return out.unionByName(parsed)


def collection(found: DataFrame) -> DataFrame:
    """The specifications if none has a problem, else none; of several with one id the first path's."""
    bad = found.filter("problem is not null").limit(1).select(F.lit(1).alias("_one"))
    kept = found.withColumn("_one", F.lit(1)).join(F.broadcast(bad), "_one", "left_anti").drop("_one", "problem")
    first = Window.partitionBy(F.lower("id")).orderBy("path")
    return kept.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def requirement_totals(specs: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    return specs.agg(F.count(F.lit(1)).alias("stories"), n("acceptance_criteria").alias("criteria"), n("business_rules").alias("rules"), n("open_questions").alias("questions"))


def story_status_counts(specs: DataFrame) -> DataFrame:
    return relational.counted(specs, "status", STORY_STATUS, "TODO")


def story(specs: DataFrame, wanted: str) -> DataFrame:
    """The specification whose file is named so or, without one, whose id is."""
    key = F.lit(wanted.lower())
    stem = F.lower(F.regexp_extract("path", r"([^/]+)\.\w+$", 1))
    rank = F.when(stem == key, 0).when(F.lower("id") == key, 1)
    return specs.withColumn("_rank", rank).filter("_rank is not null").orderBy("_rank", "path").limit(1).drop("_rank")


def with_status(files: DataFrame, path: str, status: str) -> DataFrame:
    """``files`` with the status of the specification or product document at ``path`` replaced where it states one: in
    its front matter, its status field, its heading, or its JSON. Nothing else of a text changes; statuses that neither
    kind knows are refused."""
    if status not in (*STORY_STATUS, *PRODUCT_STATUS):
        raise ValueError(f"no status: {status}")
    text = F.col("content")
    forms = (
        (r"(?s)\A(---\n(?:.*?\n)?status:[ \t]*)[^\n]*(?=\n.*?^?---)", "$1" + status),
        (r"(?im)^(\s*[-*]?\s*\**(?:status|estado)\**\s*:\s*\**[ \t]*)\S.*$", "$1" + status),
        (r"(?m)^(#\s+[\w-]+\s*\[)[^\]]*(?=\])", "$1" + status),
        (r"(?s)(\"status\"\s*:\s*\")[^\"]*(?=\")", "$1" + status),
    )
    edited = text
    for pattern, new in reversed(forms):
        edited = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, new)).otherwise(edited)
    return files.withColumn("content", F.when(F.col("path") == path, edited).otherwise(text))


def locations(found: DataFrame, depth: int = 6, most: int = 32, home: str = HOME) -> DataFrame:
    """``root, stories, ids, truncated`` of the collections in a repository, down to ``depth`` folders; the first
    ``most`` are listed."""
    root = F.regexp_extract("path", rf"^(.*?)/?\Q{home}\E/requirements/", 1)
    near = found.withColumn("root", root).filter(F.when(F.col("root") == "", 0).otherwise(F.size(F.split("root", "/"))) <= depth)
    rows = near.groupBy("root").agg(F.count(F.lit(1)).alias("stories"), F.array_sort(F.collect_set(F.lower("id"))).alias("ids"))
    order = Window.orderBy("root")  # a row a collection
    return rows.withColumns({"_n": F.row_number().over(order), "_all": F.count(F.lit(1)).over(Window.partitionBy())}).filter(F.col("_n") <= most).select("root", "stories", "ids", (F.col("_all") > most).alias("truncated"))


def products(files: DataFrame, home: str = HOME) -> DataFrame:
    """``path, id, title, status, owner, target_release, applies_to, requirement_ids, sections, questions, problem,
    schema_version, names_requirements`` (whether the last list is there, if empty) of
    the documents under ``home``/product: front matter, and sections by their headings (fenced code apart)."""
    within = _limited(_within(files, home, "product", "md|markdown"), F.regexp_extract("path", r"^(.*)/[^/]+$", 1), PRODUCT_FILES)
    front, body = F.regexp_extract("content", r"(?s)\A---\n(.*?)\n---\n", 1), F.regexp_replace("content", r"(?s)\A---\n.*?\n---\n", "")
    bare = F.regexp_replace(body, r"(?ms)^```.*?^```\s*$", "")
    key = lambda k: F.regexp_replace(group(front, rf"(?m)^{k}:\s*(\S.*)$", 1), r"""^["']|["']$""", "")

    def listed(k: str) -> Column:
        inline = F.split(F.regexp_extract(front, rf"(?m)^{k}:\s*\[(.*)\]\s*$", 1), r"\s*,\s*")
        block = F.regexp_extract_all(F.regexp_extract(front, rf"(?m)^{k}:\s*\n((?:\s+-\s+.*(?:\n|\z))+)", 1), F.lit(r"(?m)^\s+-\s+(.+)$"), F.lit(1))
        both = F.filter(F.concat(inline, block), lambda x: x != "")
        return F.transform(both, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))

    names = F.regexp_extract_all(bare, F.lit(r"(?m)^##\s+(.+?)\s*$"), F.lit(1))
    bodies = F.transform(F.slice(F.split(bare, r"(?m)^##\s+.*$"), 2, 1 << 20), lambda b: F.trim(F.regexp_replace(b, r"^\s+|\s+$", "")))
    sections = F.map_from_entries(F.arrays_zip(names.alias("k"), bodies.alias("v")))
    title = lambda n: F.regexp_extract("content", r"(?m)^#\s+(.+)$", n)
    keys = F.regexp_extract_all(front, F.lit(r"(?m)^([A-Za-z_]\w*)\s*:"), F.lit(1))
    problem = (
        F.when(F.octet_length("content") > FILE_BYTES, "PRD_SOURCE_TOO_LARGE")
        .when(F.col("_over"), "PRD_COLLECTION_LIMIT")
        .when(front == "", "PRD_PARSE_ERROR")
        .when(front.rlike(r"(?m)^[^#'\"]*(?::|-)\s+[*&][A-Za-z_]"), "PRD_YAML_ALIAS_UNSUPPORTED")
        .when(F.size(F.array_distinct(F.transform(keys, F.lower))) < F.size(keys), "PRD_YAML_DUPLICATE_KEY")
        .when(F.size(F.array_distinct(names)) < F.size(names), "PRD_PARSE_ERROR")
    )
    usable = F.when(F.size(F.array_distinct(names)) == F.size(names), sections)
    return within.select("path", key("id").alias("id"), F.coalesce(key("title"), title(1)).alias("title"), F.upper(F.coalesce(key("status"), F.lit(""))).alias("status"), key("owner").alias("owner"), key("target_release").alias("target_release"), listed("applies_to").alias("applies_to"), listed("requirement_ids").alias("requirement_ids"), usable.alias("sections"), F.filter(_items(_section(bare, "Open Questions|Preguntas Abiertas")), lambda q: ~F.lower(F.regexp_replace(F.trim(q), r"\.$", "")).isin(*NO_QUESTIONS)).alias("questions"), problem.alias("problem"), key("schema_version").alias("schema_version"), front.rlike(r"(?m)^requirement_ids:").alias("names_requirements"))


_DIAGNOSTIC = "code string, severity string, message string, path string, field string, section string, reference string, ord array<int>"


def external(path: Column) -> Column:
    """Whether a path is absolute, has a drive, or is an address."""
    return path.rlike(r"^([\\/]|[A-Za-z][A-Za-z0-9+.-]*:)") | path.contains("\0")


def escapes(path: Column) -> Column:
    """Whether a path leaves its root or does not lie under one."""
    depth = F.aggregate(
        F.split(F.regexp_replace(path, r"\\", "/"), "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda a, p: F.struct((a["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"), F.least(a["least"], a["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("least")),
    )
    return external(path) | (depth["least"] < 0)


def _resolved(path: Column) -> Column:
    """A path that doesn't escape, without empty, ``.`` and ``..`` parts (the root: empty)."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: ~p.isin("", "."))
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", up(a)).otherwise(F.concat(a, F.array(p)))), "/")


def product_diagnostics(docs: DataFrame, specs: DataFrame, available: bool = True, files: DataFrame | None = None) -> DataFrame:
    """The findings on product documents (see _DIAGNOSTIC), each once; ``ord`` says in which order a document has them.
    A document that can't be read has that finding alone. Incomplete sections are errors from the review on, open
    questions from the approval on. Without readable requirements, references are not checked for being there; without
    ``files``, paths are not either. Orphans have no document: their path is the requirement's."""
    out: list[DataFrame] = []

    def rule(rows: DataFrame, code: Column | str, severity: Column | str, message: Column | str, field: str | None = None, reference: Column | None = None, section: Column | None = None, at: Column | None = None) -> None:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        none = F.lit(None).cast("string")
        order = F.array(F.lit(len(out)), F.coalesce(at, F.lit(0)).cast("int") if at is not None else F.lit(0))
        out.append(rows.select(lit(code).alias("code"), lit(severity).alias("severity"), lit(message).alias("message"), "path", lit(field).cast("string").alias("field"), (section if section is not None else none).cast("string").alias("section"), (reference if reference is not None else none).cast("string").alias("reference"), order.alias("ord")))

    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    missing = lambda rows, f: rule(rows, "PRD_METADATA_MISSING", "ERROR", f"Required metadata field '{f}' is missing or empty.", f)
    rule(docs.filter("problem is not null"), F.col("problem"), "ERROR", "The document can't be read.")
    docs = docs.filter("problem is null")
    rule(docs.filter(blank("id")), "PRD_ID_MISSING", "ERROR", "PRD ID is required.", "id")
    rule(docs.filter(~blank("id") & ~F.trim("id").rlike(r"\A[A-Za-z0-9][A-Za-z0-9_-]*\z")), "PRD_ID_INVALID", "ERROR", "The ID has an invalid format.", "id", F.col("id"))
    missing(docs.filter(blank("schema_version")), "schema_version")
    rule(docs.filter("trim(schema_version) <> '1' and trim(schema_version) <> ''"), "PRD_SCHEMA_UNSUPPORTED", "ERROR", "schema_version is not 1.", "schema_version", F.col("schema_version"))
    missing(docs.filter(blank("title")), "title")
    missing(docs.filter(blank("status")), "status")
    rule(docs.filter(~blank("status") & ~F.col("status").isin(*PRODUCT_STATUS)), "PRD_STATUS_INVALID", "ERROR", "The status is not known.", "status", F.col("status"))
    missing(docs.filter(F.size("applies_to") == 0), "applies_to")
    missing(docs.filter(~F.col("names_requirements")), "requirement_ids")
    strict = F.when(F.col("status").isin("REVIEW", "APPROVED", "SHIPPED"), "ERROR").otherwise("WARNING")
    named = F.map_from_entries(F.transform(F.map_entries(F.coalesce("sections", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(F.trim(e["key"])), e["value"])))
    asked = docs.select("path", "status", "questions", named.alias("_held"), F.posexplode(F.array(*[F.lit(s) for s in SECTIONS])).alias("_at", "_section"))
    asked = asked.withColumn("_body", F.col("_held")[F.lower("_section")])
    rule(asked.filter("_body is null"), "PRD_SECTION_MISSING", strict, F.concat(F.lit("Required section '"), "_section", F.lit("' is missing.")), None, None, F.col("_section"), F.col("_at"))
    empty = (F.trim("_body") == "") | F.col("_body").rlike(r"\b(TODO|TBD)\b") | F.col("_body").rlike(r"(?im)^\s*(?:[-*+]\s+)?describe(?:\s+.*|\s*\.{3})\s*$")
    unsaid = (F.col("_section") == "Open Questions") & (F.size("questions") == 0)
    rule(asked.filter(empty & ~unsaid), "PRD_SECTION_PLACEHOLDER", strict, F.concat(F.lit("Required section '"), "_section", F.lit("' says nothing yet.")), None, None, F.col("_section"), F.col("_at"))
    open_ = docs.filter(F.size("questions") > 0)
    rule(open_.filter(F.col("status").isin("APPROVED", "SHIPPED")), "PRD_OPEN_QUESTIONS_BLOCKING", "ERROR", "This status can't retain open questions.", None, None, F.lit("Open Questions"))
    rule(open_.filter(F.col("status").isin("DRAFT", "REVIEW")), "PRD_OPEN_QUESTIONS_PRESENT", "WARNING", "The document has open questions.", None, None, F.lit("Open Questions"))
    refs = docs.select("path", F.posexplode("requirement_ids").alias("_at", "ref")).withColumns({"ref": F.trim("ref"), "key": F.lower(F.trim("ref"))})
    well_formed = F.col("ref").rlike(r"\A[A-Za-z0-9][A-Za-z0-9_.-]*\z")
    rule(refs.filter(~well_formed), "PRD_REQUIREMENT_ID_INVALID", "ERROR", "A referenced requirement ID has an invalid format.", "requirement_ids", F.lit("<invalid-requirement-id>"), None, F.col("_at"))
    refs = refs.filter(well_formed)
    if available:
        known = specs.select(F.lower("id").alias("key"))
        rule(relational.missing(refs, "key", known), "PRD_REQUIREMENT_MISSING", "ERROR", "The referenced requirement does not exist.", "requirement_ids", F.col("ref"), None, F.col("_at"))
    paths = docs.select("path", F.posexplode("applies_to").alias("_at", "_p")).withColumn("_p", F.regexp_replace(F.trim("_p"), r"\\", "/"))
    rule(paths.filter(escapes(F.col("_p"))), "PRD_APPLIES_TO_INVALID", "ERROR", "The path leaves the project.", "applies_to", F.when(external(F.col("_p")), "<outside-project>").otherwise(F.col("_p")), None, F.col("_at"))
    if files is not None:
        parts = F.split("path", "/")
        there = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("key")).distinct()
        wanted = paths.filter(~escapes(F.col("_p"))).withColumn("key", _resolved(F.col("_p"))).filter("key <> ''")
        rule(wanted.join(there, "key", "left_anti"), "PRD_APPLIES_TO_MISSING", "WARNING", "The path does not exist.", "applies_to", F.col("_p"), None, F.col("_at"))
    twice = relational.duplicates(docs.filter(~blank("id")).withColumn("_own", F.lower(F.trim("id"))), F.col("_own"), "path")
    rule(twice, "PRD_ID_DUPLICATE", "ERROR", "The ID occurs before.", "id", F.col("first_id"))
    if available:
        some = docs.limit(1).select(F.lit(1).alias("_one"))
        orphans = relational.missing(specs.select("path", "id", F.lower("id").alias("key")), "key", refs.select("key")).withColumn("_one", F.lit(1)).join(F.broadcast(some), "_one", "left_semi")
        rule(orphans, "PRD_REQUIREMENT_ORPHAN", "WARNING", "No product document refers to the requirement.", "requirement_ids", F.col("id"))
    else:
        rule(docs, "PRD_REQUIREMENTS_UNAVAILABLE", "WARNING", "Requirements can't be read.")
    all_ = out[0]
    for o in out[1:]:
        all_ = all_.unionByName(o)
    keys = ["code", "severity", "path", "field", "section", "reference"]
    return all_.groupBy(*keys).agg(F.min(F.struct("ord", "message")).alias("m")).select("code", "severity", "m.message", "path", "field", "section", "reference", "m.ord")


def scoped_diagnostics(found: DataFrame, docs: DataFrame, target: str) -> DataFrame:
    """The findings that concern ``target``: those of documents whose scope meets it, those without a document, and the
    codes that concern the whole collection."""
    outside = docs.join(in_scope(docs, target).select("path"), "path", "left_anti").select("path")
    inside = found.filter(~F.col("code").isin(*GLOBAL_CODES)).join(outside, "path", "left_anti")
    return found.filter(F.col("code").isin(*GLOBAL_CODES)).unionByName(inside.select(*found.columns))


def severity_rank(c: str = "severity") -> Column:
    return F.when(F.col(c) == "ERROR", 0).when(F.col(c) == "WARNING", 1).when(F.col(c) == "INFO", 2).otherwise(3)


def report(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``path, id, errors, warnings, infos, valid, first_error`` of each document; the first error by ``ord``."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, 1)), F.lit(0)).cast("long")
    counts = found.groupBy("path").agg(n("ERROR").alias("errors"), n("WARNING").alias("warnings"), n("INFO").alias("infos"), F.min_by("code", F.when(F.col("severity") == "ERROR", F.struct("ord", "code"))).alias("first_error"))
    rows = docs.select("path", "id").join(counts, "path", "left").na.fill(0, ["errors", "warnings", "infos"])
    return rows.withColumn("valid", F.col("errors") == 0)


def trusted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents that are not archived, with ``approved`` (approved or shipped, and valid); those with errors lose their
    sections."""
    rows = docs.join(report(docs, found).select("path", "valid"), "path").filter("status <> 'ARCHIVED'")
    empty = F.create_map().cast("map<string,string>")
    return rows.withColumns({"approved": F.col("valid") & F.col("status").isin("APPROVED", "SHIPPED"), "sections": F.when(F.col("valid"), F.col("sections")).otherwise(empty)})


def in_scope(docs: DataFrame, target: str) -> DataFrame:
    """Documents whose ``applies_to`` and the target lie on one path; an empty list applies everywhere."""
    goal = F.array(*[F.lit(p) for p in target.strip("/").split("/") if p]) if target.strip("/") else F.array().cast("array<string>")

    def meets(p: Column) -> Column:
        parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
        n = F.least(F.size(parts), F.size(goal))
        return (n == 0) | (F.slice(parts, 1, n) == F.slice(goal, 1, n))

    return docs.filter((F.size("applies_to") == 0) | F.exists("applies_to", meets))


def may_move(report_rows: DataFrame, path: str, status: str) -> bool:
    """Whether a document may take a status: review, approval and shipping need a valid one."""
    if status not in ("REVIEW", "APPROVED", "SHIPPED"):
        return status in PRODUCT_STATUS
    return report_rows.filter((F.col("path") == path) & (F.col("errors") > 0)).isEmpty()
