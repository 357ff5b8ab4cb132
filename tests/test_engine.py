import pytest
from pyspark.sql import functions as F
from sediment.operators import detect, documents
from sediment.plans.engine import Engine

from tests.sample import SAMPLE


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.of(spark, SAMPLE)


def rows(df, *cols):
    return {tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_debt(engine):
    assert rows(engine.todos, "path", "line", "type", "scope", "message") == {
        ("main.py", 6, "TODO", "auth", "check tokens"),
        ("src/services/user_service.py", 6, "FIXME", None, "slow"),
        ("tests/test_x.py", 1, "TODO", None, "more"),
    }


def test_audit(engine):
    found = rows(engine.risks, "path", "line", "type")
    assert {(".env", 0, "Unsafe Configuration File"), (".env", 1, "Database Password"), ("app/secrets.py", 1, "AWS Access Key"), ("app/secrets.py", 2, "Database Password"), ("app/secrets.py", 3, "Hardcoded IP"), ("main.py", 16, "Sensitive Data Exposure")} == found
    assert all("hunter2" not in str(r) for r in engine.risks.collect())


def test_imports_and_reach(engine):
    assert rows(engine.edges, "src", "dst") == {
        ("main.py", "models.py"),
        ("main.py", "src/services/user_service.py"),
        ("src/services/user_service.py", "src/util/text.py"),
        ("web/server.js", "web/user.model.js"),
    }
    assert rows(engine.blast_radius("src/util/text.py"), "vertex", "depth") == {("src/services/user_service.py", 1), ("main.py", 2)}
    assert rows(engine.affected_routes("src/util/text.py"), "route") == {"/users", "/posts"}
    assert rows(engine.affected_routes("main.py"), "route") == {"/users", "/posts"} and engine.affected_routes("main.py", strict=True).isEmpty()
    assert engine.onboarding().filter("tier = 4").isEmpty()


def test_entities(engine):
    named = {r["name"]: r for r in engine.entities.collect()}
    assert {"User", "Post", "Author", "Book", "orders", "Blog", "Dog", "Account"} <= set(named)
    assert [(c["name"], c["is_pk"]) for c in named["orders"]["columns"]] == [("id", True), ("total", False), ("user_id", False)]
    assert ("Book", "||--o{", "books", None) in [tuple(r) for r in named["Author"]["relations"]]
    assert ("users", "}o--||", "user_id", None) in [tuple(r) for r in named["Post"]["relations"]]
    assert ("Owner", "}o--||") in [tuple(r)[:2] for r in named["Dog"]["relations"]]
    assert [c["name"] for c in named["Account"]["columns"]] == ["name", "email"]
    found = rows(engine.resolved, "name", "target", "resolved")
    assert ("Post", "users", "User") in found and ("Post", "Tag", None) in found


def test_classes(engine):
    named = {(r["language"], r["name"]): r for r in engine.classes.collect()}
    assert named["go", "UserStore"]["methods"] == ["GetUser(id int) (User, error)"] and named["go", "Repo"]["is_interface"]
    assert named["rust", "Order"]["methods"] == ["pay(&mut self, by: u32) -> bool"] and named["rust", "Payable"]["is_interface"]
    assert named["java", "Dog"]["bases"] == ["Animal", "Pet"] and named["csharp", "Blog"]["attributes"][0] == "int Id"


def test_routes_and_contracts(engine):
    assert rows(engine.contracts, "method", "route", "entity") == {
        ("GET", "/users", "User"), ("GET", "/posts", "Post"), ("POST", "/posts", "Post"), ("GET", "/api/users", "User"), ("POST", "/api/users", "User"), ("GET", "all", None),
    } | {x for x in rows(engine.contracts, "method", "route", "entity") if x[1] == "/cart"}


def test_graph(engine):
    vertices, edges = engine.graph
    assert vertices.groupBy("id").count().filter("count > 1").isEmpty()
    assert ("GET /users", "User", "ROUTES_TO") in rows(edges, "src", "dst", "kind")


def test_detection(engine):
    a = engine.analyses()
    assert rows(a["framework"](), "framework") == {"FastAPI"} and rows(a["architecture"](), "architecture") == {"Microservices Architecture"}
    assert rows(a["infra"](), "src", "dst", "database") == {("web", "db", True), ("web", "cache", True), ("proxy", "web", False)}
    assert [tuple(r) for r in a["notebooks"]().collect()] == [("note.ipynb", ["in.csv"], ["out.parquet"])]
    found = Engine.of(engine.spark, {"frontend/package.json": '{"dependencies": {"next": "1"}}', "backend/requirements.txt": "fastapi"}).analyses()["monorepo"]()
    assert rows(found, "part", "framework") == {("frontend", "Next.js"), ("backend", "FastAPI")}


def test_requirements_and_products(engine, spark):
    specs = {r["id"]: r for r in engine.requirements.collect()}
    assert specs["US-001"]["status"] == "DONE" and specs["HU02"]["acceptance_criteria"][0]["then"] == "it ships"
    assert [b["id"] for b in specs["HU02"]["business_rules"]] == ["BR01", "BR-9"]
    codes = rows(engine.product_diagnostics, "path", "code")
    assert {(".project/product/p1.md", "PRD_APPLIES_TO_INVALID"), (".project/product/p1.md", "PRD_REQUIREMENT_MISSING"), (".project/product/p2.md", "PRD_ID_DUPLICATE"), (".project/product/p2.md", "PRD_STATUS_INVALID"), (".project/requirements/HU02.md", "PRD_REQUIREMENT_ORPHAN")} <= codes
    broken = Engine.of(spark, SAMPLE | {".project/requirements/bad.json": "[1]"})
    assert broken.requirements.isEmpty()


def test_tree_and_context(engine):
    lines = [r["line"] for r in engine.analyses()["tree"]().collect()]
    assert lines[0].endswith(".project/") and lines[-1].startswith("└── ")
    text = engine.context()
    assert "hunter2" not in text and "erDiagram" in text and "classDiagram" in text and text == engine.context()


def test_product_rules_that_decide_validity(spark):
    head = "---\nid: {}\ntitle: T\nstatus: {}\nowner: o\nschema_version: {}\napplies_to: [./src/, src/x/../a.py, src/none.py]\nrequirement_ids: [{}]\n---\n## Open Questions\n\n- when\n"
    files = {"src/a.py": "x = 1\n", **{f".project/product/{n}.md": head.format(*v) for n, v in {"a": ("PRD-1", "APPROVED", 1, ""), "b": ("PRD 2", "DRAFT", 2, "US/1")}.items()}}
    files[".project/product/c.md"] = "---\nid: PRD-3\ntitle: T\nstatus: DRAFT\n---\n## Problem\n\nx\n"
    e = Engine.of(spark, files)
    got = {(r["path"][-4], r["code"].removeprefix("PRD_"), r["severity"], r["field"] if "METADATA" in r["code"] else r["reference"]) for r in e.product_diagnostics.collect()}
    late = {("a", "OPEN_QUESTIONS_BLOCKING", "ERROR", None), ("b", "OPEN_QUESTIONS_PRESENT", "WARNING", None), ("b", "ID_INVALID", "ERROR", "PRD 2"), ("b", "SCHEMA_UNSUPPORTED", "ERROR", "2")}
    late |= {("b", "REQUIREMENT_ID_INVALID", "ERROR", "<invalid-requirement-id>"), *((d, "APPLIES_TO_MISSING", "WARNING", "src/none.py") for d in "ab")}
    late |= {("c", "METADATA_MISSING", "ERROR", f) for f in ("schema_version", "applies_to", "requirement_ids")}
    names = {c for _, c, _, _ in late}
    assert {g for g in got if g[1] in names} == late
    # sections are required from the review on
    assert {g[2] for g in got if g[:2] == ("a", "SECTION_MISSING")} == {"ERROR"} and {g[2] for g in got if g[:2] == ("b", "SECTION_MISSING")} == {"WARNING"}
    rows = {r["path"][-4]: r for r in e.analyses()["product_report"]().collect()}
    assert not any(r["valid"] for r in rows.values()) and rows["b"]["first_error"] == "PRD_ID_INVALID" and rows["c"]["first_error"] == "PRD_METADATA_MISSING"


def test_requirement_fields_say_more_than_the_heading(spark):
    text = "# Pay\n\n- **ID**: HU-7\n- **Estado**: done\n- **Title**: Pay now\n"
    e = Engine.of(spark, {"docs/.specs/requirements/x.md": text, ".specs/requirements/y.md": "# US-1 [TODO] - X\n"}, home=".specs")
    assert {(r["id"], r["status"], r["title"]) for r in e.requirements.collect()} == {("HU-7", "DONE", "Pay now"), ("US-1", "TODO", "X")}


def test_status_edit_touches_nothing_else(spark):
    texts = {"a.md": "# US-1 [TODO] - Pay\n\ntext [TODO]\n", "b.md": "# US-2 - X\n\n- **Status**: todo\n- **Want**: x\n", "c.json": '{"story": {"id": "U", "status": "done"}}', "d.md": "---\nid: P\nstatus: DRAFT\nowner: o\n---\n# P\n"}
    e = Engine.of(spark, texts)
    want = {"a.md": texts["a.md"].replace("# US-1 [TODO]", "# US-1 [REVIEW]"), "b.md": texts["b.md"].replace(": todo", ": REVIEW"), "c.json": texts["c.json"].replace("done", "REVIEW"), "d.md": texts["d.md"].replace("DRAFT", "REVIEW")}
    for path in texts:
        got = {r["path"]: r["content"] for r in documents.with_status(e.files, path, "REVIEW").collect()}
        assert got == texts | {path: want[path]}
    with pytest.raises(ValueError):
        documents.with_status(e.files, "a.md", "LATER")


def test_snapshots_and_registered_analyses(spark, tmp_path):
    old, new = Engine.of(spark, {"a.py": "1", "b.py": "2", "c.py": "3"}), Engine.of(spark, {"a.py": "1", "b.py": "22", "d.py": "4"})
    old.save_snapshot(f"file://{tmp_path}/s")
    assert rows(new.delta(f"file://{tmp_path}/s"), "path", "state") == {("a.py", "unmodified"), ("b.py", "modified"), ("c.py", "deleted"), ("d.py", "new")}
    Engine.register("count", lambda e: e.files.groupBy("ext").count())
    try:
        assert rows(new.analyses()["count"](), "ext", "count") == {(".py", 3)}
        new.save("count", f"file://{tmp_path}/c", "csv")
        assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").collect()[0]["count"] == "3"
    finally:
        Engine.REGISTERED.clear()


def test_members_among_parameters_and_masked_comments(spark):
    files = {
        "a/P.java": "/* class Old {\n int gone;\n} */\npublic record P(int x, String y) {\n  // int z;\n  String url = \"http://a /* b */\";\n}\n",
        "a/Q.cs": "public class Q(int a, string b) : Base\n{\n}\n",
        "a/R.php": "<?php\nclass R\n{\n    public function __construct(private string $name, int $n) {\n    }\n}\n",
        "a/S.ts": "export class S {\n  constructor(private x: number, y: string) {\n  }\n}\n",
    }
    named = {r["name"]: r["attributes"] for r in Engine.of(spark, files).classes.collect()}
    assert named == {"P": ["int x", "String y", "String url"], "Q": ["int a", "string b"], "R": ["string $name"], "S": ["x: number"]}


def test_own_framework_rules_come_first(spark):
    files = Engine.of(spark, {"requirements.txt": "fastapi", "x.own": "1"}).files
    own = [("Own", "Own", F.col("ext") == ".own")]
    assert rows(detect.frameworks(files, first=own), "framework") == {"Own"} and rows(detect.frameworks(files), "framework") == {"FastAPI"}


def test_diagrams_and_stories(engine):
    assert 'N0["web"]' in engine.diagram("infra") or '["web"]' in engine.diagram("infra")
    assert '[("db")]' in engine.diagram("infra") and "-->" in engine.diagram("imports")
    assert engine.diagram("routes").startswith("sequenceDiagram") and "participant P0 as main.py" in engine.diagram("routes")
    text = engine.stories()
    assert "US-001 [DONE] Log in: in" in text and text.index("[DONE]") < text.index("given a when b then c") < text.index("BR01: x")
    assert engine.stories(40).endswith("[... truncated]")


def test_settings_name_folders(spark):
    files = {"src/handlers/a.py": "1", "src/tables/b.py": "1", "pyproject.toml": '[tool.sediment]\ncontrollers = ["handlers"]\nmodels = ["tables"]\n'}
    assert rows(Engine.of(spark, files).analyses()["architecture"](), "architecture") == {"MVC Pattern"}
    assert rows(Engine.of(spark, files | {"pyproject.toml": "broken ["}).analyses()["architecture"](), "architecture") == {"Monolithic Application"}


def test_close_deletes_what_was_parsed(spark):
    import os

    e = Engine.of(spark, {"A.java": "class A { int x; }"})
    assert rows(e.classes, "name") == {"A"}
    root = e.parsed.root.removeprefix("file://")
    assert os.path.isdir(f"{root}/rows") and not e.files.storageLevel == e.files.unpersist().storageLevel
    e.close()
    assert not os.path.exists(root) and "parsed" not in vars(e)
