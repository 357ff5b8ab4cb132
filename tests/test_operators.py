import os
import subprocess

import pytest
from pyspark.sql import functions as F
from sediment.functions import text as T
from sediment.operators import graph, relational, secrets
from sediment.operators.imports import candidates
from sediment.sources import repo
from sediment.sources.repo import read_problems, read_repo, walk


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_lines(spark):
    for text in ("a\nb\r\nc\rd\x0be", "a\n", "", "\n\n", "x y\x85z"):
        assert one(spark, T.lines_of(F.lit(text))) == text.splitlines()


def test_names(spark):
    assert one(spark, T.plurals(F.lit("city"))) == ["city", "citys", "cityes", "cities"]
    assert one(spark, T.singulars(F.lit("classes"))) == ["classes", "class", "classe"]
    assert one(spark, T.identifier(F.lit("9 a-b"))) == "E_9_a_b" and one(spark, T.identifier(F.lit(""))) == "E_UNKNOWN"
    assert [one(spark, T.extension(F.lit(n))) for n in ("a.PY", ".env", "x", "a.b.ts")] == [".py", "", "", ".ts"]
    assert one(spark, T.normalized_path(F.split(F.lit("a/b/../c/./d"), "/"))) == "a/c/d"
    assert one(spark, T.normalized_path(F.split(F.lit("a/../../c"), "/"))) is None


def test_candidates(spark):
    tried = one(spark, candidates(F.lit("a/b/c.py"), F.lit("..x.y")))
    assert tried[:2] == ["a/x/y", "a/x/y.py"] and tried[-1] == "a/x/y/__init__.py"
    assert one(spark, candidates(F.lit("c.py"), F.lit("..x")))[0] is None
    assert one(spark, candidates(F.lit("a/b.js"), F.lit("../lib/u")))[2] == "lib/u.js"
    assert "src/p/q.py" in one(spark, candidates(F.lit("a.py"), F.lit("p.q")))


SECRET = [
    'api_key = "abc def ghi 123"', "Authorization: Bearer " + "a1b2c3d4e5f6g7h8i9j0", "sk-" + "proj-abcdefghij0123456789", "gh" + "p_" + "a" * 36, "xox" + "b-1234567890-abc",
    "sk_" + "live_" + "a1" * 12, "postgres://me:hidden@host/db", "npm_" + "a" * 36, "password=" + "s3cr3tvalue", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----",
]
PLAIN = ["a token is a word", "Bearer authentication is used", "token_count = 128 ", "JWT_ALGORITHM = HS256", "123e4567-e89b-12d3-a456-426614174000", "d41d8cd98f00b204e9800998ecf8427e"]


@pytest.mark.parametrize("text", SECRET)
def test_redaction_hides(spark, text):
    once = one(spark, secrets.redacted(F.lit(text)))
    assert secrets.MARK in once and once == one(spark, secrets.redacted(F.lit(once)))


@pytest.mark.parametrize("text", PLAIN)
def test_redaction_leaves(spark, text):
    assert one(spark, secrets.redacted(F.lit(text))) == text


def test_findings_positive_and_negative(spark):
    good = ['x = "' + "AKIA" + "ABCDEFGHIJKLMNOP" + '"', 'password = "real value 1"', "ip = 8.8.8.8"]
    bad = ["# password = 'x y'", "token = os.getenv('T')", 'password = "changeme"', "password = variable", "secret = '${X}'", "ip 127.0.0.1", 'api_key = "your_key_here"', "x" * 501 + ' password = "real value 1"']
    lines = spark.createDataFrame([("f.py", i, t) for i, t in enumerate(good + bad)], "path string, line int, text string")
    assert {r["line"] for r in secrets.line_findings(lines).collect()} == {0, 1, 2}


def bfs(edges, start):
    seen, level, depth = {start: 0}, [start], 0
    while level:
        depth += 1
        level = sorted({b for a, b in edges if a in level and b not in seen})
        seen |= dict.fromkeys(level, depth)
    return {v: d for v, d in seen.items() if d}


def test_reach_is_shortest(spark):
    import random

    rng = random.Random(4)
    edges = [(f"v{rng.randrange(40)}", f"v{rng.randrange(40)}") for _ in range(70)]
    frame = spark.createDataFrame(edges, "src string, dst string")
    got = {r["vertex"]: r["depth"] for r in graph.reach(frame, spark.createDataFrame([("v1",)], "start string")).collect()}
    assert got == bfs(edges, "v1")


def test_snapshot_states(spark):
    schema = "path string, mtime int, size int, sha256 string"
    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "x"), ("c", 1, 1, "x"), ("d", 1, 1, "x")], schema)
    new = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 1, "x"), ("c", 2, 1, "y"), ("e", 1, 1, "x")], schema)
    assert {r["path"]: r["state"] for r in relational.snapshot_diff(old, new).collect()} == {"a": "unmodified", "b": "touched", "c": "modified", "d": "deleted", "e": "new"}


def test_repository_source(spark, tmp_path):
    for path, text in {"a/__init__.py": "x\r\ny", ".env": "A=1", "a/b.pyc": "", "node_modules/x.js": "", ".hidden/x": "", "keep/skip.log": "", "keep/want.log": "", "deep/b/c/d.txt": "", ".gitignore": "*.pyc\n*.log\n!want.log\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text.encode())
    os.symlink(tmp_path / ".env", tmp_path / "link")
    got = {r["path"]: r["content"] for r in read_repo(spark, str(tmp_path)).collect()}
    assert set(got) == {"a/__init__.py", ".env", "keep/want.log", "deep/b/c/d.txt", ".gitignore"} and got["a/__init__.py"] == "x\ny"
    assert set(walk(str(tmp_path), 2)) == set(got) - {"deep/b/c/d.txt"}
    (tmp_path / "keep/.gitignore").write_bytes(b"x" * 5000)
    assert "keep/want.log" not in set(walk(str(tmp_path)))


IGNORES = ["*.log\n!keep.log\n", "/build\n", "docs/**/x.md\n", "a/\n", "**/tmp?\n", "[ab].txt\n", "foo/*\n!foo/bar\n", "x\\ \n"]


@pytest.mark.parametrize("rules", IGNORES)
def test_ignore_rules_as_git_has_them(tmp_path, rules):
    names = ["x.log", "keep.log", "lib/y.log", "build/z", "lib/build/z", "docs/x.md", "docs/p/q/x.md", "a/f", "lib/a", "tmp1", "lib/tmp2", "a.txt", "c.txt", "foo/bar", "foo/baz", "x "]
    if subprocess.run(["git", "init", "-q", str(tmp_path)]).returncode:
        pytest.skip("no git")
    (tmp_path / ".gitignore").write_text(rules)
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("")
    said = subprocess.run(["git", "-C", str(tmp_path), "ls-files", "-o", "--exclude-standard", "-z"], capture_output=True, text=True).stdout.split("\0")
    hidden = {p for p in said if p.startswith(("build/", "lib/build/"))}  # folders that are never read
    assert set(walk(str(tmp_path))) == {p for p in said if p} - hidden


def test_fair_cut_is_the_largest_that_fits(spark):
    import random

    rng = random.Random(2)
    lengths = {g: [rng.choice([0, 1, 5, 5, 9, 40, 1000]) for _ in range(rng.randint(1, 30))] for g in ("a", "b", "c", None)}
    rows = spark.createDataFrame([(g, n) for g, found in lengths.items() for n in found] + [("d", None), ("e", 5000)], "g string, size long")
    lengths |= {"d": [0], "e": [5000]}
    for budget in (0, 7, 60, 300, 100_000):
        want = {g: None if sum(x) <= budget else max(c for c in range(5001) if sum(min(n, c) for n in x) <= budget) for g, x in lengths.items()}
        assert {r["g"]: r["cut"] for r in relational.fair_cut(rows, budget, "size", "g").collect()} == want
    together = [n for x in lengths.values() for n in x]
    best = max(c for c in range(5001) if sum(min(n, c) for n in together) <= 300)
    assert [tuple(r) for r in relational.fair_cut(rows, 300, "size").collect()] == [(len(together), best)]
    assert relational.fair_cut(rows.limit(0), 300, "size", "g").isEmpty()


def test_repository_reads_are_verified(spark, tmp_path, monkeypatch):
    """Tasks by bytes, files that go or change meanwhile, ignore files that can't be followed."""
    for name in ("a.py", "b/c.py", "bad/x.py", "big.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * (500 if name == "big.py" else 10))
    (tmp_path / "bad/.gitignore").write_bytes(b"\xff\xfe")
    reader = repo._Reader({"path": str(tmp_path)})
    monkeypatch.setattr(repo, "BYTES_PER_TASK", 100)
    tasks = reader.partitions()
    assert [t.paths for t in tasks] == [["a.py"], ["big.py"], ["b/c.py"]] and [p for p, _ in tasks[-1].problems] == ["bad"]
    (tmp_path / "a.py").unlink()
    (row,) = reader.read(tasks[0])
    assert row[0] == "a.py" and row[4] is None and row[5] == "file not read: No such file or directory"
    stat = repo.os.stat
    monkeypatch.setattr(repo.os, "stat", lambda p, **k: stat(tmp_path / "b/c.py") if str(p).endswith("big.py") else stat(p, **k))
    (row,) = reader.read(tasks[1])
    assert row[0] == "big.py" and row[5] == "file not read: changed while it was read"
    monkeypatch.undo()
    assert {r["path"] for r in read_repo(spark, str(tmp_path)).collect()} == {"b/c.py", "big.py"}
    (found,) = read_problems(spark, str(tmp_path)).collect()
    assert found["path"] == "bad" and found["problem"].startswith("ignore file not followed: ")
