"""The analyses of sources over sources that are written from the driver's tables: every row becomes a file, an operator
reads the files, and DuckDB SQL says what the rows of the table should give.

Files are written from suppliers, if nothing else is said; their names and texts hold the supplier's key ``k``, its
nation ``n``, ``q`` (half the key), and ``f`` and ``g`` (folders of k and of q).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.operators import asg, context, debt, detect, documents, entities, graph, imports, routes, secrets, structure, symbols
from sediment.operators.lines import explode_lines
from sediment.plans.tables import query, read
from sediment.shared import new_path
from sediment.sources.repo import named, read_problems, read_repo

#: The numbers of a supplier in SQL, named as in the templates.
_S = "s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey // 2 AS q, s_suppkey % 7 AS f, (s_suppkey // 2) % 7 AS g FROM supplier)"


_STATES_SQL = "(['TODO', 'IN_PROGRESS', 'TESTING', 'DONE', 'BLOCKED'])[1 + k % 5]"


def as_files(rows: DataFrame) -> DataFrame:
    """Rows (path, content) as the files of a repository."""
    size, sha = F.octet_length("content").cast("long"), F.sha2("content", 256)
    return named(rows.select("path", size.alias("size"), F.lit(None).cast("timestamp").alias("mtime"), sha.alias("sha256"), "content"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    half = F.floor(k / 2)
    rows = read(spark, sf_dir, "supplier")
    # a row becomes a file, so few bytes make much work: they are dealt by their number
    return rows.repartition(-(-rows.count() // 500) or 1, "s_suppkey").select(k.alias("k"), F.col("s_nationkey").alias("n"), half.alias("q"), (k % 7).alias("f"), (half % 7).alias("g"))


def written(rows: DataFrame, path: str, *content: str) -> DataFrame:
    """A file for each row: the first text of ``content``, or the one that the key's remainder chooses. Templates have
    ``%1$d`` to ``%5$d`` for k, n, q, f, g."""
    fill = lambda t: F.format_string(t, "k", "n", "q", "f", "g")
    text = F.element_at(F.array(*[fill(c) for c in content]), (F.col("k") % len(content) + 1).cast("int"))
    paths = F.element_at(F.array(*[fill(p) for p in path.split("|")]), (F.col("k") % len(path.split("|")) + 1).cast("int"))
    return as_files(rows.select(paths.alias("path"), text.alias("content")))


def supplier_files(spark, sf_dir, path: str, *content: str) -> DataFrame:
    return written(suppliers(spark, sf_dir), path, *content)


def joined(*columns: str) -> list:
    """Lists as text, so that they compare."""
    return [F.array_join(c, "|").alias(c) for c in columns]


# Python modules: imports, classes, comments ---------------------------------------------------------------------------

_MODULE = "src/pkg%4$d/m%1$d.py"
_PYTHON = """from src.pkg%5$d.m%3$d import S%3$d
import os


class S%1$d(S%3$d):
    limit = %1$d
    peer: S%2$d

    def __init__(self, a, b):
        self.total = a

    def run_%2$d(self, x, y):
        # {}(n%2$d): check S%1$d
        return x
"""
_MARKERS = (*debt.MARKERS, "NOTE")
_FILES = "p AS (SELECT *, 'src/pkg' || f || '/m' || k || '.py' AS path, 'src/pkg' || g || '/m' || q || '.py' AS target FROM s)"
_EDGES = f"{_S}, {_FILES}, e AS (SELECT DISTINCT path AS src, target AS dst FROM p WHERE k <> q)"
_DEGREES = f"{_EDGES}, d AS (SELECT path, (SELECT count(*) FROM e WHERE dst = path) AS in_degree, (SELECT count(*) FROM e WHERE src = path) AS out_degree FROM p)"


def modules(spark, sf_dir) -> DataFrame:
    return supplier_files(spark, sf_dir, _MODULE, *[_PYTHON.format(m) for m in _MARKERS])


@query(f"WITH {_S}, {_FILES} SELECT path, 'src.pkg' || g || '.m' || q AS module FROM p UNION ALL SELECT path, 'os' FROM p")
def module_import_statements(spark, sf_dir):
    """What each module imports."""
    return imports.import_statements(modules(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT src, dst FROM e")
def module_import_edges(spark, sf_dir):
    """Imports resolved to the files that they mean."""
    return imports.import_edges(modules(spark, sf_dir))


@query(f"WITH {_DEGREES} SELECT path, in_degree, out_degree FROM d")
def module_degrees(spark, sf_dir):
    """How many modules import each one, and how many it imports."""
    files = modules(spark, sf_dir)
    return imports.degrees(files.select("path"), imports.import_edges(files))


@query(f"""WITH {_DEGREES}, t AS (SELECT *, CASE WHEN in_degree <= 1 AND out_degree >= 1 THEN 1 WHEN in_degree >= 2 THEN 2 ELSE 4 END AS tier FROM d)
SELECT CAST(row_number() OVER (ORDER BY tier, in_degree DESC, path) AS INTEGER) AS ord, path, tier, CASE tier WHEN 1 THEN 'Entrypoint & Router' ELSE 'Core Business Logic' END AS role, in_degree, out_degree FROM t WHERE tier < 4""")
def module_reading_order(spark, sf_dir):
    """The order in which to read the modules."""
    files = modules(spark, sf_dir)
    return imports.reading_order(files, imports.import_edges(files))


@query(f"""WITH {_EDGES}, n AS (SELECT dst, count(*) AS in_degree, list_sort(list(src))[1:3] AS few FROM e GROUP BY dst)
SELECT dst, in_degree, CASE WHEN in_degree > 5 THEN 'CORE' WHEN in_degree >= 2 THEN 'SHARED' ELSE 'PERIPHERAL' END AS class, array_to_string(few, ', ') AS dependents FROM n""")
def module_heatmap(spark, sf_dir):
    """Which modules a change touches most."""
    return imports.heatmap(imports.import_edges(modules(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT src AS vertex, 1 AS depth FROM e WHERE dst = 'src/pkg1/m1.py' UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.vertex)
SELECT vertex, min(depth) AS depth FROM r GROUP BY vertex""")
def module_blast_radius(spark, sf_dir):
    """What a change of one module reaches."""
    return graph.blast_radius(imports.import_edges(modules(spark, sf_dir)), "src/pkg1/m1.py")


@query(f"WITH {_EDGES} SELECT src, array_to_string(list_sort(list(dst)), '|') AS dst FROM e GROUP BY src")
def module_adjacency(spark, sf_dir):
    """Imports of each module as a list."""
    return imports.adjacency(imports.import_edges(modules(spark, sf_dir)), "src", "dst").select("src", *joined("dst"))


@query(f"""WITH {_S}, {_FILES} SELECT path, 'src.pkg' || f || '.m' || k AS module, 'S' || k AS name, 'S' || q AS bases, 'peer: S' || n || '|limit|total' AS attributes,
  '__init__(a, b)|run_' || n || '(x, y)' AS methods, false AS is_interface, 5 AS line FROM p""")
def python_class_members(spark, sf_dir):
    """Classes of Python modules."""
    return structure.python_classes(modules(spark, sf_dir)).select("path", "module", "name", *joined("bases", "attributes", "methods"), "is_interface", "line")


@query(f"""WITH {_S} SELECT 'S' || k AS src, 'S' || q AS dst, 'INHERITS' AS kind FROM s
UNION ALL SELECT 'S' || k, 'S' || n, 'ASSOCIATION' FROM s WHERE n <> k AND n IN (SELECT k FROM s)""")
def python_class_edges(spark, sf_dir):
    """Inheritance and association of the classes."""
    return structure.class_edges(structure.python_classes(modules(spark, sf_dir)))


_MARKED = f"m AS (SELECT *, (['{"', '".join(_MARKERS)}'])[1 + k % 6] AS type FROM p)"


@query(f"WITH {_S}, {_FILES}, {_MARKED} SELECT path, 'm' || k || '.py' AS file, 13 AS line, type, 'n' || n AS scope, 'check S' || k AS message FROM m WHERE type <> 'NOTE'")
def module_debt(spark, sf_dir):
    """Debt comments of the modules."""
    return debt.debt_markers(modules(spark, sf_dir))


@query(f"""WITH {_S}, {_FILES}, {_MARKED}, t AS (SELECT unnest(['{"', '".join(debt.MARKERS)}']) AS type)
SELECT t.type, NULL AS scope, count(m.k) AS count FROM t LEFT JOIN m USING (type) GROUP BY t.type UNION ALL SELECT type, 'n' || n, count(*) FROM m WHERE type <> 'NOTE' GROUP BY type, n""")
def module_debt_statistics(spark, sf_dir):
    """Debt by type and by scope."""
    return debt.marker_statistics(debt.debt_markers(modules(spark, sf_dir)))


@query(f"""WITH {_S}, {_FILES}, {_MARKED} SELECT CAST(greatest(0, 100 - sum(CASE type WHEN 'BUG' THEN 5 WHEN 'FIXME' THEN 3 WHEN 'HACK' THEN 3 WHEN 'XXX' THEN 2 WHEN 'TODO' THEN 1 ELSE 0 END)) AS BIGINT) AS score FROM m WHERE k < 1000000""")
def module_debt_score(spark, sf_dir):
    """One score of all debt."""
    return debt.debt_score(debt.debt_markers(modules(spark, sf_dir)))


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, (['TODO', 'BUG', 'HACK'])[1 + (c_custkey // 4) % 3] AS type FROM customer)
SELECT 'app/c' || k || (['.py', '.js', '.lua', '.md'])[1 + k % 4] AS path, 'c' || k || (['.py', '.js', '.lua', '.md'])[1 + k % 4] AS file, 2 AS line, type, CAST(NULL AS VARCHAR) AS scope, 'of nation ' || n AS message FROM c WHERE k % 4 < 3""")
def comment_signs(spark, sf_dir):
    """Debt comments by the comment sign of each language; Markdown has none."""
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(k.alias("k"), F.col("c_nationkey").alias("n"), F.floor(k / 4).alias("q"), F.lit(0).alias("f"), F.lit(0).alias("g"))
    texts = [f"x = 1\ny = 2 {sign} {{}}: of nation %2$d\n" for sign in ("#", "//", "--", "#")]
    fill = lambda t: F.format_string(t, "k", "n", "q", "f", "g")
    cell = F.array(*[F.array(*[fill(t.format(m)) for m in ("TODO", "BUG", "HACK")]) for t in texts])
    content = F.element_at(F.element_at(cell, (F.col("k") % 4 + 1).cast("int")), (F.col("q") % 3 + 1).cast("int"))
    path = F.concat(F.lit("app/c"), "k", F.element_at(F.array(*[F.lit(e) for e in (".py", ".js", ".lua", ".md")]), (F.col("k") % 4 + 1).cast("int")))
    return debt.debt_markers(as_files(rows.select(path.alias("path"), content.alias("content"))))


@query(f"WITH {_S} SELECT 'm' || k || '.py' AS path, 'm' || q AS dep FROM s WHERE k <> q")
def flat_imports(spark, sf_dir):
    """Imports between modules of one folder by their names."""
    return imports.single_file_imports(supplier_files(spark, sf_dir, "m%1$d.py", "import m%3$d\nimport os\n"))


@query(f"""WITH {_S}, e AS (SELECT CASE WHEN k = q THEN 'ROOT [DIR] -> m' || k || '.py' ELSE 'm' || k || '.py -> m' || q || '.py' END AS edge FROM s)
SELECT array_to_string(list_sort(list(DISTINCT edge)), ' ; ') AS topology FROM e""")
def topology(spark, sf_dir):
    """All modules and what they import as one line."""
    return imports.topology(supplier_files(spark, sf_dir, "m%1$d.py", "import m%3$d\nimport os\n"))


@query(f"""WITH {_S}, e AS (SELECT 'web/a' || k || '/x.js' AS src, 'web/a' || q || '/x.js' AS dst FROM s) SELECT DISTINCT src, dst FROM e WHERE src <> dst""")
def script_import_edges(spark, sf_dir):
    """Relative imports of scripts, with and without an ending."""
    return imports.import_edges(supplier_files(spark, sf_dir, "web/a%1$d/x.js", "import a from '../a%3$d/x';\n", "const a = require('../a%3$d/x.js');\n"))


@query(f"""WITH {_S}, t AS (SELECT DISTINCT 'pkg' || f AS p FROM s), fs AS (SELECT 'pkg' || f AS p, 'm' || k || '.py' AS name FROM s),
a AS (SELECT p, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM t), b AS (SELECT p, name, row_number() OVER (PARTITION BY p ORDER BY name) AS i, count(*) OVER (PARTITION BY p) AS m FROM fs)
SELECT CAST(i AS VARCHAR) AS ord, CASE WHEN i = m THEN '└── ' ELSE '├── ' END || p || '/' AS line FROM a
UNION ALL SELECT a.i || '|' || b.i, CASE WHEN a.i = a.m THEN '    ' ELSE '│   ' END || CASE WHEN b.i = b.m THEN '└── ' ELSE '├── ' END || name FROM b JOIN a USING (p)""")
def project_tree(spark, sf_dir):
    """Folders and files as a tree."""
    return context.tree(supplier_files(spark, sf_dir, "pkg%4$d/m%1$d.py", "")).select(*joined("ord"), "line")


@query(f"""WITH {_S} SELECT 'd' || f || '/m' || k || '.py' AS path FROM s WHERE k % 5 IN (0, 4)""")
def core_file_eligibility(spark, sf_dir):
    """Code that is no test, fixture or script."""
    paths = "d%4$d/m%1$d.py|tests/m%1$d.py|d%4$d/test_m%1$d.py|d%4$d/m%1$d.md|d%4$d/m%1$d.py"
    return context.eligible(supplier_files(spark, sf_dir, paths, "x = 1\n")).select("path")


_MOBILE = ("src/api/a%1$d.ts", "src/config/c%1$d.ts", "hooks/h%1$d.tsx", "src/utils/u%1$d.ts", "src/other/o%1$d.ts")


@query(f"""WITH {_S}, p AS (SELECT (['src/api/a', 'src/config/c', 'hooks/h', 'src/utils/u', 'src/other/o'])[1 + k % 5] || k || CASE WHEN k % 5 = 2 THEN '.tsx' ELSE '.ts' END AS path, k % 5 AS place FROM s WHERE k % 5 < 4)
SELECT CAST(row_number() OVER (ORDER BY place, path) AS INTEGER) AS ord, path FROM p QUALIFY ord <= 25""")
def mobile_core_files(spark, sf_dir):
    """The files that tell most of a mobile project: calls, settings, hooks, helpers."""
    return context.mobile_core_files(supplier_files(spark, sf_dir, "|".join(_MOBILE), "export const x = 1;\n"), 25).select("ord", "path")


@query(f"""WITH {_S}, c AS (SELECT CASE WHEN k % 5 = 0 THEN 'd' || k || '/main.py' WHEN k % 5 = 1 THEN 'd' || k || '/urls.py' ELSE 'd' || k || '/x.md' END AS path, k FROM s),
r AS (SELECT path, CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS b FROM c WHERE k % 5 = 0 OR path = (SELECT min(path) FROM c WHERE k % 5 = 1))
SELECT CAST(row_number() OVER (ORDER BY b, path) AS INTEGER) AS ord, path FROM r QUALIFY ord <= 250""")
def core_file_ranking(spark, sf_dir):
    """Entry points first, then one of each well-known name."""
    files = supplier_files(spark, sf_dir, "d%1$d/main.py|d%1$d/urls.py|d%1$d/x.md|d%1$d/x.md|d%1$d/x.md", "x = 1\n")
    return context.core_files(files, imports.import_edges(files), 250).select("ord", "path")


@query(f"""WITH {_S} SELECT 'd' || f || '/m' || k || (CASE WHEN k % 2 = 0 THEN '.py' ELSE '.md' END) AS path, CAST(length('x = ' || k || chr(10)) AS BIGINT) AS size,
  sha256('x = ' || k || chr(10)) AS sha256, (CASE WHEN k % 2 = 0 THEN '.py' ELSE '.md' END) AS ext, 'm' || k AS stem, 1 AS depth FROM s""")
def file_index(spark, sf_dir):
    """Files with their sizes, digests and names."""
    return supplier_files(spark, sf_dir, "d%4$d/m%1$d.py|d%4$d/m%1$d.md", "x = %1$d\n").select("path", "size", "sha256", "ext", "stem", "depth")


def on_disk(files: DataFrame) -> str:
    """A folder of the shared file system that the files' tasks have written them to."""
    root = new_path(files.sparkSession, "repository").removeprefix("file://")

    def write(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                at = os.path.join(root, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
            yield frame[["path"]]

    files.select("path", "content").mapInPandas(write, "path string").count()
    return root


#: Rules of the folders d0 to d6 and of the root: what is ignored, and what is wanted again.
_IGNORES = {".gitignore": "*.log\nbuild/\n", "d1/.gitignore": "*.md\n!keep*.md\n", "d2/.gitignore": "/x*.py\n", "d3/.gitignore": "[" + "a" * 5000 + "\n"}


def walked(spark, sf_dir) -> str:
    rules = as_files(spark.createDataFrame(sorted(_IGNORES.items()), "path string, content string"))
    paths = "d%4$d/m%1$d.py|d%4$d/x%1$d.py|d%4$d/x%1$d.md|d%4$d/keep%1$d.md|d%4$d/e%1$d.log|d%4$d/deep/x%1$d.py|d%4$d/node_modules/n%1$d.py|d%4$d/build/b%1$d.py"
    return on_disk(supplier_files(spark, sf_dir, paths, "x = %1$d\r\n").unionByName(rules))


@query(f"""WITH {_S}, p AS (SELECT *, 'd' || f || '/' || (['m', 'x', 'x', 'keep', 'e', 'deep/x', 'node_modules/n', 'build/b'])[1 + k % 8] || k || (['.py', '.py', '.md', '.md', '.log', '.py', '.py', '.py'])[1 + k % 8] AS path FROM s),
c AS (SELECT path, 'x = ' || k || chr(13) || chr(10) AS content FROM p WHERE k % 8 NOT IN (4, 6, 7) AND f <> 3 AND NOT (f = 1 AND k % 8 = 2) AND NOT (f = 2 AND k % 8 = 1)
  UNION ALL SELECT '.gitignore', '*.log' || chr(10) || 'build/' || chr(10) UNION ALL SELECT 'd1/.gitignore', '*.md' || chr(10) || '!keep*.md' || chr(10) UNION ALL SELECT 'd2/.gitignore', '/x*.py' || chr(10))
SELECT path, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS sha256, replace(content, chr(13) || chr(10), chr(10)) AS content FROM c""")
def walked_files(spark, sf_dir):
    """Files of a folder as the repository source reads them, under the rules of nested ignore files."""
    return read_repo(spark, walked(spark, sf_dir)).select("path", "size", "sha256", "content")


@query("SELECT 'd3' AS path, 'ignore file not followed: the ignore file exceeds a limit' AS problem FROM (SELECT DISTINCT s_suppkey % 7 AS f FROM supplier) WHERE f = 3")
def walk_problems(spark, sf_dir):
    """Folders that are not read, and why."""
    return read_problems(spark, walked(spark, sf_dir))


# Credentials ----------------------------------------------------------------------------------------------------------

#: By the key's remainder: a line before and after its secret, the secret's format (null: none), and what it is.
_PEM = "-----BEGIN RSA PRIVATE " + "KEY-----"
_CREDENTIALS = (
    ('x = "', "AKIA%1$016d", '"', "AWS Access Key", "CRITICAL"),
    ('x = "', "ghp_%1$024d", '"', "GitHub Token", "CRITICAL"),
    ('x = "', "glpat-%1$020d", '"', "GitLab Token", "CRITICAL"),
    ('x = "', "sk_live_%1$020d", '"', "Stripe Secret", "CRITICAL"),
    ('x = "', "rk_test_%1$020d", '"', "Stripe Test Key", "WARNING"),
    ('x = "', "whsec_%1$020d", '"', "Stripe Webhook Secret", "CRITICAL"),
    ('x = "', "sk-proj-%1$024d", '"', "Model Provider Key", "CRITICAL"),
    ('x = "', "SG.%1$016d.%1$016d", '"', "SendGrid Key", "CRITICAL"),
    ('x = "', "SK%1$032d", '"', "Twilio Key", "CRITICAL"),
    ('x = "', "xoxb-%1$012d", '"', "Slack Token", "CRITICAL"),
    ('x = "', "npm_%1$036d", '"', "NPM Token", "CRITICAL"),
    ('x = "', "%1$032d-us1", '"', "Mailchimp Key", "CRITICAL"),
    ('x = "', "eyJ%1$010d.%1$010d.%1$010d", '"', "JWT Hardcoded", "HIGH"),
    ('password = "', "long and %1$d", '"', "Database Password", "HIGH"),
    ('api_key = "', "of s %1$d", '"', "API Key", "CRITICAL"),
    ('x = "mysql://u:', "pw%1$d", '@h/db"', "Credentials in URI", "CRITICAL"),
    ('h = "Authorization: Bearer ', "%1$024d", '"', "Bearer Token", "CRITICAL"),
    ("", _PEM, "", "Private Key", "CRITICAL"),
    ('h = "10.20.30.4"', None, "", "Hardcoded IP", "WARNING"),
    ('h = "127.0.0.1"', None, "", None, None),
    ("token = os.getenv(k)", None, "", None, None),
    ("# nothing in %1$d", None, "", None, None),
)
_N = len(_CREDENTIALS)


def _chosen(column: int) -> str:
    return "CASE k % " + str(_N) + "".join(f" WHEN {i} THEN '{c[column]}'" for i, c in enumerate(_CREDENTIALS) if c[column]) + " END"


_LEAKS = f"""{_S}, leaks AS (SELECT 'conf/s' || k || '.py' AS path, 1 AS line, {_chosen(3)} AS type, {_chosen(4)} AS severity, CASE WHEN k % {_N} = 18 THEN 'Config' ELSE 'Secrets' END AS category,
  'Match: ***REDACTED***' AS message, k FROM s WHERE {_chosen(3)} IS NOT NULL)"""


def leaking(spark, sf_dir) -> DataFrame:
    return supplier_files(spark, sf_dir, "conf/s%1$d.py", *[f"{a}{secret or ''}{b}\n" for a, secret, b, _, _ in _CREDENTIALS])


@query(f"WITH {_LEAKS} SELECT path, line, type, severity, category, message FROM leaks")
def credential_findings(spark, sf_dir):
    """Every credential rule, and lines that only look like one."""
    return secrets.file_findings(leaking(spark, sf_dir))


@query(f"""WITH {_S} SELECT 'conf/s' || k || '.py' AS path, sha256(CASE k % {_N}{"".join(f" WHEN {i} THEN '{a}{secrets.MARK if secret else ''}{b}'" for i, (a, secret, b, _, _) in enumerate(_CREDENTIALS) if i != _N - 1)} ELSE '# nothing in ' || k END
  || CASE WHEN k % {_N} = 17 THEN '' ELSE chr(10) END) AS redacted_sha256 FROM s""")
def credential_redaction(spark, sf_dir):
    """Files without their credentials; a key block without an end is taken to the end."""
    return leaking(spark, sf_dir).select("path", F.sha2(secrets.redacted(F.col("content")), 256).alias("redacted_sha256"))


@query(f"""WITH {_LEAKS} SELECT n.n_regionkey AS region, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'WARNING') AS warning,
  CASE WHEN count(*) FILTER (severity = 'CRITICAL') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (severity = 'HIGH') > 0 THEN 'HIGH' WHEN count(*) FILTER (severity = 'WARNING') > 3 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM leaks JOIN s USING (k) JOIN nation n ON n.n_nationkey = s.n GROUP BY 1""")
def credential_risk(spark, sf_dir):
    """Findings by region and the level of each."""
    key = F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("k")
    regions = suppliers(spark, sf_dir).join(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("region")), "n")
    found = secrets.file_findings(leaking(spark, sf_dir)).withColumn("k", key)
    return secrets.risk_summary(found.join(regions.select("k", "region"), "k"), ("region",))


@query(f"""WITH {_LEAKS} SELECT CAST(greatest(0, 100 - sum(CASE severity WHEN 'CRITICAL' THEN 20 WHEN 'HIGH' THEN 10 ELSE 3 END)) AS BIGINT) AS score FROM leaks""")
def credential_score(spark, sf_dir):
    """One score of all findings."""
    return secrets.security_score(secrets.file_findings(leaking(spark, sf_dir)))


@query(f"""WITH {_LEAKS}, r AS (SELECT count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'WARNING') AS warning FROM leaks),
{_FILES}, {_MARKED}, d AS (SELECT count(*) FILTER (type IN ('FIXME', 'BUG', 'XXX')) AS bugs, count(*) FILTER (type IN ('TODO', 'HACK')) AS todos FROM m),
b AS (SELECT *, CAST(greatest(0, least(100, 100 - 25 * critical - 10 * (high + warning) - 3 * bugs - todos)) AS BIGINT) AS score FROM r, d)
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM b""")
def repository_health(spark, sf_dir):
    """Score and grade of a repository from its findings and its debt."""
    return secrets.health(debt.debt_markers(modules(spark, sf_dir)), secrets.file_findings(leaking(spark, sf_dir)))


@query("""WITH r AS (SELECT (['.env', '.env.local', 'secrets.json', 'credentials.json', 'conf/.env'])[1 + r_regionkey] AS path FROM region)
SELECT path, 0 AS line, 'Unsafe Configuration File' AS type, 'HIGH' AS severity, 'Config' AS category FROM r WHERE path <> 'conf/.env'""")
def unsafe_configuration(spark, sf_dir):
    """Configuration files that should not be there."""
    names = F.array(*[F.lit(x) for x in (".env", ".env.local", "secrets.json", "credentials.json", "conf/.env")])
    rows = read(spark, sf_dir, "region").select(F.element_at(names, F.col("r_regionkey") + 1).alias("path"), F.lit("a: 1\n").alias("content"))
    return secrets.file_findings(as_files(rows)).select("path", "line", "type", "severity", "category")


def accounts(spark, sf_dir) -> DataFrame:
    """An entity for each nation; even ones have a password."""
    n = F.col("n_nationkey")
    column = lambda name: F.struct(F.lit(name).alias("name"))
    columns = F.when(n % 2 == 0, F.array(column("id"), column("password"), column("card_number"))).otherwise(F.array(column("id")))
    return read(spark, sf_dir, "nation").select((n + 1).alias("ord"), F.format_string("User%02d", n).alias("name"), columns.alias("columns"))


@query("SELECT n_nationkey + 1 AS ord, 'User' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS entity, 'password|card_number' AS columns FROM nation WHERE n_nationkey % 2 = 0")
def sensitive_columns(spark, sf_dir):
    """Entities with sensitive columns."""
    return secrets.sensitive_entities(accounts(spark, sf_dir)).select("ord", "entity", *joined("columns"))


@query(f"""WITH {_S} SELECT 'api/s' || k || '.py' AS path, 2 AS line, 'User' || lpad(CAST(n AS VARCHAR), 2, '0') AS entity, 'password, card_number' AS columns,
  (['return variable', 'jsonify call', 'schema/model reference'])[1 + k % 4] AS how FROM s WHERE n % 2 = 0 AND k % 4 < 3""")
def sensitive_exposures(spark, sf_dir):
    """Lines that hand out an entity with sensitive columns."""
    texts = ["\n    return user%2$02d\n", "\n    x = jsonify(user%2$02d)\n", '\n@app.get("/", response_model=User%2$02dOut)\n', "\n    from users import user%2$02d\n"]
    lines = explode_lines(supplier_files(spark, sf_dir, "api/s%1$d.py", *texts))
    return secrets.exposures(lines, secrets.sensitive_entities(accounts(spark, sf_dir)))


# Classes of brace languages -------------------------------------------------------------------------------------------


def members_of(spark, sf_dir, language: str, path: str, content: str) -> DataFrame:
    found = structure.brace_classes(supplier_files(spark, sf_dir, path, content), language)
    return found.select("path", "module", "name", *joined("bases", "attributes", "methods"), "is_interface", "line")


def _members_sql(path: str, module: str, name: str, bases: str, attributes: str, methods: str, interface: str = "false", line: int = 1) -> str:
    return f"SELECT {path} AS path, {module} AS module, {name} AS name, {bases} AS bases, {attributes} AS attributes, {methods} AS methods, {interface} AS is_interface, {line} AS line FROM s"


@query(f"WITH {_S} " + _members_sql("'java/J' || k || '.java'", "'java'", "'J' || k", "'Base' || n || '|Pet|Toy'", "'Long id|String name' || n", "'bark' || k || '(int times)'", line=3))
def java_class_members(spark, sf_dir):
    """Classes of Java."""
    return members_of(spark, sf_dir, "java", "java/J%1$d.java", "package a;\n\npublic class J%1$d extends Base%2$d implements Pet, Toy {\n    private Long id;\n    protected String name%2$d;\n\n    public String bark%1$d(int times) {\n        return name;\n    }\n}\n")


@query(f"WITH {_S} " + _members_sql("'cs/C' || k || '.cs'", "'Shop'", "'C' || k", "'Base' || n || '|IPet'", "'int Id|string Name' || n", "'Run' || k || '(int x)'", line=3))
def csharp_class_members(spark, sf_dir):
    """Classes of C#."""
    return members_of(spark, sf_dir, "csharp", "cs/C%1$d.cs", "namespace Shop;\n\npublic class C%1$d : Base%2$d, IPet\n{\n    public int Id { get; set; }\n    public string Name%2$d { get; set; }\n\n    public void Run%1$d(int x) { }\n}\n")


@query(f"WITH {_S} " + _members_sql("'php/P' || k || '.php'", "'php'", "'P' || k", "'Model|Pet'", "'string $name' || n", "'run' || k || '($x)'", line=2))
def php_class_members(spark, sf_dir):
    """Classes of PHP."""
    return members_of(spark, sf_dir, "php", "php/P%1$d.php", "<?php\nclass P%1$d extends Model implements Pet\n{\n    private string $name%2$d;\n\n    public function run%1$d($x) {\n        return $x;\n    }\n}\n")


@query(f"WITH {_S} " + _members_sql("'web/T' || k || '.ts'", "'web'", "'T' || k", "'Base' || n", "'id: number|name' || n || ': string'", "'run' || k || '(x: number)'"))
def script_class_members(spark, sf_dir):
    """Classes of TypeScript."""
    return members_of(spark, sf_dir, "script", "web/T%1$d.ts", "export class T%1$d extends Base%2$d {\n  id: number;\n  private name%2$d: string;\n\n  run%1$d(x: number): void {\n    this.id = x;\n  }\n}\n")


@query(f"WITH {_S} " + _members_sql("'go/u' || k || '.go'", "'go'", "'Store' || k", "''", "'DB db|*Cache cache' || n", "'Get' || k || '(id int) (User, error)'", line=3))
def go_struct_members(spark, sf_dir):
    """Structs of Go with their receivers."""
    return members_of(spark, sf_dir, "go", "go/u%1$d.go", "package user\n\ntype Store%1$d struct {\n\tdb DB\n\tcache%2$d *Cache\n}\n\nfunc (s *Store%1$d) Get%1$d(id int) (User, error) {\n\treturn s.db.Get(id)\n}\n")


@query(f"WITH {_S} " + _members_sql("'rust/o' || k || '.rs'", "'rust'", "'O' || k", "''", "'id: u64|total' || n || ': f64'", "'pay' || k || '(&mut self, by: u32) -> bool'"))
def rust_struct_members(spark, sf_dir):
    """Structs of Rust with their impl blocks."""
    return members_of(spark, sf_dir, "rust", "rust/o%1$d.rs", "pub struct O%1$d {\n    pub id: u64,\n    total%2$d: f64,\n}\n\nimpl O%1$d {\n    pub fn pay%1$d(&mut self, by: u32) -> bool {\n        true\n    }\n}\n")


# Shapes that one line and one level of brackets don't show: files at the root, several classes a file, declarations over
# several lines, nested generics, bodies on one line, literals and comments that hold brackets.


def _shapes_sql(*classes: str) -> str:
    return f"WITH {_S} " + " UNION ALL ".join(classes)


@query(_shapes_sql(
    _members_sql("'J' || k || '.java'", "'Root'", "'J' || k", "'Base' || n || '|Pet|Toy'", "'Map<String, List<Integer>> m' || n || '|int a'", "'load(int a, Map<String, J' || q || '> b)'", line=2),
    _members_sql("'J' || k || '.java'", "'Root'", "'In' || k", "''", "'int z' || n", "''", line=9),
    _members_sql("'J' || k || '.java'", "'Root'", "'P' || k", "''", "'int a|Map<String, List<J' || q || '>> m'", "''", line=11),
))
def java_class_shapes(spark, sf_dir):
    """Java at the root: sealed and generic classes, records, nested classes, members over several lines."""
    text = (
        "// class No { {\npublic sealed class J%1$d<T extends Map<String, List<T>>> extends Base%2$d<Foo<T>>\n    implements Pet<A, B>, Toy permits X {\n  /* } */ private Map<String,\n    List<Integer>> m%2$d = null; int a, b = 3;\n"
        "  public J%1$d(int x) { }\n  public <T> List<T> load(int a,\n    Map<String, J%3$d> b) throws E { return \"}\"; }\n  static class In%1$d { int z%2$d; }\n}\nrecord P%1$d(int a, Map<String, List<J%3$d>> m) {}\n"
    )
    return members_of(spark, sf_dir, "java", "J%1$d.java", text)


@query(_shapes_sql(
    _members_sql("'S' || k || '.cs'", "'Uni.N' || n", "'S' || k", "'Base|IThing'", "'int a|int Id|List<List<S' || q || '>> Xs'", "'Load' || n || '(int a)'", line=2),
    _members_sql("'S' || k || '.cs'", "'Uni.N' || n", "'ITree' || k", "'IBase'", "'int Count'", "'Get(int at' || n || ')'", "true", line=7),
    _members_sql("'S' || k || '.cs'", "'Uni.N' || n", "'Node' || k", "''", "'int Id|string? N' || n", "''", line=8),
))
def csharp_class_shapes(spark, sf_dir):
    """C# at the root: namespaces of a file, conditions on types, primary constructors, properties without a block."""
    text = (
        "namespace Uni.N%2$d;\n[Table(\"t{\")] public class S%1$d<T>(int a) : Base<Foo<int>>,\n  IThing where T : class {\n  [Key] public int Id { get; set; } = 5; public List<List<S%3$d>> Xs => new();\n  private string s = @\"a\"\"}\";\n"
        "  public T Load%2$d<T>(int a) where T : class => default; }\npublic interface ITree%1$d<T> : IBase<T> { int Count { get; } T Get(int at%2$d); }\npublic record Node%1$d(int Id, string? N%2$d = null);\n"
    )
    return members_of(spark, sf_dir, "csharp", "S%1$d.cs", text)


@query(_shapes_sql(
    _members_sql("'p' || k || '.php'", "'App\\N' || n", "'A' || k", "'\\Foo\\Bar|I|J'", "'?int $x|(B&C)|null $y|string $n' || n || '|string $m'", "'__construct(private readonly ?int $x, protected (B&C)|null $y = null, $z = 1)'", line=5),
    _members_sql("'p' || k || '.php'", "'App\\N' || n", "'Suit' || k", "'HasL'", "''", "'label' || n || '()'", line=9),
).replace("\\\\", "\\"))
def php_class_shapes(spark, sf_dir):
    """PHP at the root: comments with brackets, union types, promoted members, backed enumerations, texts that choose their end."""
    text = (
        "<?php\nnamespace App\\N%2$d;\n# comment {\n#[Attr(1)]\nfinal class A%1$d extends \\Foo\\Bar implements I, J {\n  public function __construct(private readonly ?int $x, protected (B&C)|null $y = null, $z = 1) { }\n"
        "  private string $n%2$d, $m = 'x{';\n}\nenum Suit%1$d: string implements HasL { case H = 'h'; public function label%2$d(): string { return <<<X\n } class Z {\nX; } }\n"
    )
    return members_of(spark, sf_dir, "php", "p%1$d.php", text)


@query(_shapes_sql(
    _members_sql("'t' || k || '.ts'", "'Root'", "'T' || k", "'Base|A'", "'x' || n || ': Map<string, number>|y: string|z|handle'", "'name()|load(a: T' || q || ', b = {c: 1})'"),
    _members_sql("'t' || k || '.ts'", "'Root'", "'Props' || k", "''", "'a' || n || ': string|b: number|d: object'", "'c(x: number): void'", "true", line=9),
    _members_sql("'t' || k || '.ts'", "'Root'", "'Card' || k", "''", "''", "'render({ a, b }: Props' || k || ')'", line=11),
    _members_sql("'t' || k || '.ts'", "'Root'", "'Panel' || k", "''", "''", "'render({ a' || n || ' })'", line=12),
))
def script_class_shapes(spark, sf_dir):
    """TypeScript at the root: generic types, decorators, accessors, members without a type, templates, components."""
    text = (
        "export class T%1$d<X> extends Base<X> implements A {\n  private x%2$d: Map<string, number> = new Map()\n  @Input() y?: string\n  z = 1;\n  get name(): string { return `a ${ {b: `}`} } }`; }\n  handle = async (e: Event) => { return e }\n"
        "  async load<T>(a: T%3$d,\n    b = {c: 1}): Promise<T[]> { return [] } }\ninterface Props%1$d { a%2$d: string, b?: number; c(x: number): void\n  d: { e: string } }\nexport default function Card%1$d({ a, b }: Props%1$d) { return null }\n"
        "export const Panel%1$d: React.FC<Props> = ({ a%2$d }) => { return a }\nconst lower = () => 1\n"
    )
    return members_of(spark, sf_dir, "script", "t%1$d.ts", text)


@query(_shapes_sql(
    _members_sql("'g/g' || k || '.go'", "'g'", "'A' || k", "''", "'int B' || n || '|int C|*pkg.Base|map[string]*A' || q || ' m'", "''", line=4),
    _members_sql("'g/g' || k || '.go'", "'g'", "'R' || k", "''", "''", "'Get(id string) (*A' || q || ', error)|Other'", "true", line=9),
    _members_sql("'g/g' || k || '.go'", "'g'", "'G' || k", "''", "'T v' || n", "'Do(a int, b string) (T, error)'", line=11),
))
def go_type_shapes(spark, sf_dir):
    """Go: types in a group, embedded ones, several names a field, generic receivers."""
    text = (
        "package g\n// type Fake struct { x int }\ntype (\n  A%1$d struct {\n    B%2$d, C int `json:\"b{\"`\n    *pkg.Base\n    m map[string]*A%3$d\n  }\n  R%1$d interface { Get(id string) (*A%3$d, error); Other }\n)\n"
        "type G%1$d[T any] struct { v%2$d T }\nfunc (g *G%1$d[T]) Do(a int,\n  b string) (T, error) { return \"}\" }\n"
    )
    return members_of(spark, sf_dir, "go", "g/g%1$d.go", text)


@query(_shapes_sql(
    _members_sql("'r/r' || k || '.rs'", "'r'", "'Q' || k", "''", "'a: u8|b' || n || ': HashMap<String, Vec<Q' || q || '>>'", "'go(&self, x: T) -> Result<(), E>'", line=2),
    _members_sql("'r/r' || k || '.rs'", "'r'", "'W' || k", "''", "'0: u8|1: S' || n", "''", line=3),
    _members_sql("'r/r' || k || '.rs'", "'r'", "'E' || k", "''", "'variant X|variant Y' || n || '|variant Z'", "''", line=4),
))
def rust_type_shapes(spark, sf_dir):
    """Rust: structs on one line and of a tuple, enumerations with data, comments in comments, raw texts."""
    text = (
        "#[derive(Debug)]\npub struct Q%1$d { a: u8, pub(crate) b%2$d: HashMap<String, Vec<Q%3$d>> }\npub struct W%1$d(pub u8, S%2$d);\nenum E%1$d { X, Y%2$d(u32), Z { a: u8 } }\n"
        "impl Q%1$d { pub async fn go<T>(&self, x: T) -> Result<(), E> { /* } /* } */ */ r#\"}\"# } }\n"
    )
    return members_of(spark, sf_dir, "rust", "r/r%1$d.rs", text)


# Entities -------------------------------------------------------------------------------------------------------------


def declared_rows(found: DataFrame) -> DataFrame:
    return found.select("path", "entity", "kind", "name", "type", "is_pk", "target", "symbol", "label")


def _column_sql(path: str, entity: str, name: str, kind: str, pk: str = "false", where: str = "") -> str:
    none = "CAST(NULL AS VARCHAR)"
    return f"SELECT {path} AS path, {entity} AS entity, 'column' AS kind, {name} AS name, {kind} AS type, {pk} AS is_pk, {none} AS target, {none} AS symbol, {none} AS label FROM s {where}"


def _relation_sql(path: str, entity: str, target: str, symbol: str, label: str, where: str = "") -> str:
    return f"SELECT {path}, {entity}, 'relation', NULL, NULL, false, {target}, '{symbol}', {label} FROM s {where}"


def _union(*parts: str) -> str:
    return f"WITH {_S} " + " UNION ALL ".join(parts)


_P = ("'prisma/p' || k || '.prisma'", "'P' || k")


def prisma_files(spark, sf_dir) -> DataFrame:
    return supplier_files(spark, sf_dir, "prisma/p%1$d.prisma", "model P%1$d {\n  id Int @id\n  email%2$d String\n  books p%3$ds[]\n  owner X%2$d?\n}\n")


@query(_union(_column_sql(*_P, "'id'", "'Int'", "true"), _column_sql(*_P, "'email' || n", "'String'"), _relation_sql(*_P, "'p' || q || 's'", "||--o{", "'books'"), _relation_sql(*_P, "'X' || n", "}o--||", "'owner'")))
def prisma_entities(spark, sf_dir):
    """Models of Prisma."""
    return declared_rows(entities.prisma(prisma_files(spark, sf_dir), 1))


_T = ("'db/t' || k || '.sql'", "'P' || k")


def ddl_files(spark, sf_dir) -> DataFrame:
    return supplier_files(spark, sf_dir, "db/t%1$d.sql", "-- tables\nCREATE TABLE P%1$d (\n  id INT PRIMARY KEY,\n  total%2$d DECIMAL(10, 2),\n  user_id INT,\n  FOREIGN KEY (user_id) REFERENCES users%2$d(id)\n);\n")


@query(_union(_column_sql(*_T, "'id'", "'INT'", "true"), _column_sql(*_T, "'total' || n", "'DECIMAL(10, 2)'"), _column_sql(*_T, "'user_id'", "'INT'"), _relation_sql(*_T, "'users' || n", "}o--||", "'user_id'")))
def ddl_entities(spark, sf_dir):
    """Tables of SQL."""
    return declared_rows(entities.ddl(ddl_files(spark, sf_dir), 2))


_U = ("'t' || k || '.sql'", "'my P' || k")


@query(_union(_column_sql(*_U, "'id'", "'INT'", "true"), _column_sql(*_U, "'b' || n", "'DECIMAL(10, 2)'", "true"), _column_sql(*_U, "'c'", "'INT'"), _relation_sql(*_U, "'other' || n", "}o--||", "'c'"), _relation_sql(*_U, "'my P' || q", "}o--||", "'b' || n")))
def ddl_shapes(spark, sf_dir):
    """Tables of SQL at the root: quoted names with a schema, values in brackets of many levels, keys of several columns."""
    deep = "f(" * 30 + "1" + ")" * 30
    text = f'CREATE TABLE IF NOT EXISTS public."my P%1$d" (\n id INT, b%2$d DECIMAL(10, 2) DEFAULT ({deep}) NOT NULL, -- x, y (\n c INT REFERENCES other%2$d(id) CHECK (a < (b)),\n CONSTRAINT pk PRIMARY KEY (id, b%2$d),\n FOREIGN KEY (b%2$d) REFERENCES s."my P%3$d"(x))'
    return declared_rows(entities.ddl(supplier_files(spark, sf_dir, "t%1$d.sql", text), 2))


_V = ("'a' || k || '_model.py'", "'A' || k")


@query(_union(_column_sql(*_V, "'id'", "'int'", "true"), _column_sql(*_V, "'name' || n", "'String'"), _column_sql(*_V, "'owner_id'", "'Integer'"), _relation_sql(*_V, "'users' || n", "}o--||", "'owner_id'"), _relation_sql(*_V, "'A' || q", "||--o{", "'post'")))
def python_model_shapes(spark, sf_dir):
    """Models at the root whose calls take several lines, with names from imports and type aliases."""
    text = (
        "import sqlalchemy as sa\nfrom sqlalchemy import Column as C, ForeignKey\ntype Id = int\nclass A%1$d:\n    id: Mapped[Id] = mapped_column(primary_key=True)\n    name%2$d = C(\n        sa.String(20),\n        nullable=False,\n    )\n"
        "    owner_id = sa.Column(sa.Integer, ForeignKey(\n        'public.users%2$d.id'))\n    post: Mapped[list['A%3$d']] = relationship(\n        back_populates='a')\n"
    )
    return declared_rows(entities.python_models(supplier_files(spark, sf_dir, "a%1$d_model.py", text), 0))


_A = ("'models/a' || k || '.py'", "'A' || k")


@query(_union(_column_sql(*_A, "'id'", "'Integer'", "true"), _column_sql(*_A, "'name' || n", "'String'"), _column_sql(*_A, "'user_id'", "'Column'"), _relation_sql(*_A, "'users' || n", "}o--||", "'user_id'"), _relation_sql(*_A, "'B' || q", "||--o{", "'posts'")))
def sqlalchemy_entities(spark, sf_dir):
    """Models of SQLAlchemy."""
    text = "class A%1$d(Base):\n    __tablename__ = 'a'\n    id = Column(Integer, primary_key=True)\n    name%2$d = Column(String)\n    user_id = Column(ForeignKey('users%2$d.id'))\n    posts = relationship('B%3$d')\n"
    return declared_rows(entities.python_models(supplier_files(spark, sf_dir, "models/a%1$d.py", text), 0))


_D = ("'shop/models' || k || '.py'", "'D' || k")


@query(_union(_column_sql(*_D, "'name' || n", "'CharField'"), _relation_sql(*_D, "'D' || q", "}o--||", "'owner'"), _relation_sql(*_D, "'Tag' || n", "}o--o{", "'tags'"), _relation_sql(*_D, "'Card'", "||--||", "'card'")))
def django_entities(spark, sf_dir):
    """Models of Django."""
    text = "class D%1$d(models.Model):\n    name%2$d = models.CharField(max_length=9)\n    owner = models.ForeignKey('D%3$d', on_delete=models.CASCADE)\n    tags = models.ManyToManyField('Tag%2$d')\n    card = models.OneToOneField('Card')\n"
    return declared_rows(entities.python_models(supplier_files(spark, sf_dir, "shop/models%1$d.py", text), 0))


_O = ("'web/o' || k || '.entity.ts'", "'O' || k")


@query(_union(_column_sql(*_O, "'id'", "'number'", "true"), _column_sql(*_O, "'name' || n", "'string'"), _relation_sql(*_O, "'O' || q", "||--o{", "'posts'")))
def typeorm_entities(spark, sf_dir):
    """Entities of TypeORM."""
    text = "@Entity()\nexport class O%1$d {\n  @PrimaryGeneratedColumn()\n  id: number;\n\n  @Column()\n  name%2$d: string;\n\n  @OneToMany(() => O%3$d, (p) => p.user)\n  posts: O%3$d[];\n}\n"
    return declared_rows(entities.annotated(supplier_files(spark, sf_dir, "web/o%1$d.entity.ts", text), "script", 8))


_E = ("'Models/E' || k || '.cs'", "'E' || k")


@query(_union(_column_sql(*_E, "'Id'", "'int'", "true"), _column_sql(*_E, "'Title' || n", "'string'"), _relation_sql(*_E, "'E' || q", "||--o{", "'Entries'"), _relation_sql(*_E, "'Owner' || n", "}o--||", "'Owner'")))
def efcore_entities(spark, sf_dir):
    """Entities of C#."""
    text = "namespace Shop.Models;\n\npublic class E%1$d\n{\n    [Key]\n    public int Id { get; set; }\n    public string Title%2$d { get; set; }\n    public ICollection<E%3$d> Entries { get; set; }\n    public Owner%2$d Owner { get; set; }\n}\n"
    return declared_rows(entities.annotated(supplier_files(spark, sf_dir, "Models/E%1$d.cs", text), "csharp", 9))


_J = ("'java/D' || k || '.java'", "'D' || k")


@query(_union(_column_sql(*_J, "'id'", "'Long'", "true"), _column_sql(*_J, "'name' || n", "'String'"), _relation_sql(*_J, "'Owner' || n", "}o--||", "'owner'"), _relation_sql(*_J, "'D' || q", "||--o{", "'pups'")))
def jpa_entities(spark, sf_dir):
    """Entities of Java."""
    text = "@Entity\npublic class D%1$d {\n    @Id\n    private Long id;\n    private String name%2$d;\n    @ManyToOne\n    private Owner%2$d owner;\n    @OneToMany\n    private List<D%3$d> pups;\n}\n"
    return declared_rows(entities.annotated(supplier_files(spark, sf_dir, "java/D%1$d.java", text), "java", 10))


_H = ("'php/H' || k || '.php'", "'H' || k")


@query(_union(_column_sql(*_H, "'name'", "'string'"), _column_sql(*_H, "'mail' || n", "'string'"), _relation_sql(*_H, "'H' || q", "||--o{", "'posts'"), _relation_sql(*_H, "'Team'", "}o--||", "'team'")))
def eloquent_entities(spark, sf_dir):
    """Models of Eloquent."""
    text = "<?php\nclass H%1$d extends Model\n{\n    protected $fillable = ['name', 'mail%2$d'];\n    public function posts() {\n        return $this->hasMany(H%3$d::class);\n    }\n    public function team() {\n        return $this->belongsTo(Team::class);\n    }\n}\n"
    return declared_rows(entities.eloquent(supplier_files(spark, sf_dir, "php/H%1$d.php", text), 11))


_W = ("'web/s' || k || '.js'", "'Item' || k")


@query(_union(_column_sql(*_W, "'name' || n", "'String'"), _relation_sql(*_W, "'Item' || q", "||--o{", "'posts'"), _relation_sql(*_W, "'Team'", "}o--||", "'team'")))
def mongoose_entities(spark, sf_dir):
    """Schemas of Mongoose, beside a package file that names it."""
    text = "const item%1$dSchema = new Schema({\n  name%2$d: { type: String },\n  posts: [{ type: Schema.Types.ObjectId, ref: 'Item%3$d' }],\n  team: { type: Schema.Types.ObjectId, ref: 'Team' },\n});\n"
    package = as_files(spark.createDataFrame([("web/package.json", '{"dependencies": {"mongoose": "7"}}')], "path string, content string"))
    return declared_rows(entities.script_schemas(supplier_files(spark, sf_dir, "web/s%1$d.js", text).unionByName(package), 3))


_Q = ("'web/q' || k || '.js'", "'Q' || k")


@query(_union(_column_sql(*_Q, "'id'", "'INTEGER'", "true"), _column_sql(*_Q, "'name' || n", "'STRING'"), _relation_sql(*_Q, "'Q' || q", "||--o{", "'hasMany'")))
def sequelize_entities(spark, sf_dir):
    """Definitions of Sequelize."""
    text = "const Q%1$d = sequelize.define('Q%1$d', {\n  id: { type: DataTypes.INTEGER, primaryKey: true },\n  name%2$d: DataTypes.STRING,\n});\nQ%1$d.hasMany(Q%3$d);\n"
    return declared_rows(entities.script_schemas(supplier_files(spark, sf_dir, "web/q%1$d.js", text), 3))


_Z = ("'web/z' || k || '.ts'", "'z' || k")


@query(_union(_column_sql(*_Z, "'id'", "'serial'", "true"), _column_sql(*_Z, "'owner' || n", "'integer'"), _relation_sql(*_Z, "'z' || q", "}o--||", "'owner' || n")))
def drizzle_entities(spark, sf_dir):
    """Tables of Drizzle."""
    text = "export const z%1$d = pgTable('z%1$d', {\n  id: serial('id').primaryKey(),\n  owner%2$d: integer('owner').references(() => z%3$d.id),\n});\n"
    return declared_rows(entities.script_schemas(supplier_files(spark, sf_dir, "web/z%1$d.ts", text), 3))


_I = ("'web/i' || k || '.model.ts'", "'I' || k")


@query(_union(_column_sql(*_I, "'id'", "'string'", "true"), _column_sql(*_I, "'teamId'", "'string'"), _relation_sql(*_I, "'I' || q", "||--o{", "'posts' || n"), _relation_sql(*_I, "'Team'", "}o--||", "'teamId'")))
def interface_entities(spark, sf_dir):
    """Interfaces of TypeScript models."""
    text = "export interface I%1$d {\n  id: string;\n  teamId: string;\n  posts%2$d: I%3$d[];\n}\n"
    return declared_rows(entities.script_schemas(supplier_files(spark, sf_dir, "web/i%1$d.model.ts", text), 3))


_F = ("'web/f' || k || '.ts'",)


@query(_union(_column_sql(*_F, "'users' || k", "'id'", "'string'", "true"), _relation_sql(*_F, "'users' || k", "'posts' || n", "||--o{", "'posts' || n")))
def firestore_entities(spark, sf_dir):
    """Collections of Firestore, beside its configuration."""
    gate = as_files(spark.createDataFrame([("web/firebaseConfig.ts", "export const db = 1;")], "path string, content string"))
    text = "const a = collection(db, 'users%1$d', uid, 'posts%2$d');\n"
    return declared_rows(entities.firestore(supplier_files(spark, sf_dir, "web/f%1$d.ts", text).unionByName(gate), 7))


def both_dialects(spark, sf_dir) -> DataFrame:
    """Entities that Prisma and SQL declare under the same names."""
    return entities.merged(entities.prisma(prisma_files(spark, sf_dir), 1).unionByName(entities.ddl(ddl_files(spark, sf_dir), 2)))


_ORD = "o AS (SELECT *, CAST(row_number() OVER (ORDER BY 'prisma/p' || k || '.prisma') AS INTEGER) AS ord FROM s)"


@query(f"""WITH {_S}, {_ORD} SELECT ord, 'P' || k AS name, 'id Int true|email' || n || ' String false|id INT true|total' || n || ' DECIMAL(10, 2) false|user_id INT false' AS columns,
  'p' || q || 's ||--o{{ books|X' || n || ' }}o--|| owner|users' || n || ' }}o--|| user_id' AS relations FROM o""")
def merged_entities(spark, sf_dir):
    """Entities of several dialects by name."""
    text = lambda *c: lambda x: F.concat_ws(" ", *[x[n].cast("string") for n in c])
    found = both_dialects(spark, sf_dir)
    return found.select("ord", "name", F.array_join(F.transform("columns", text("name", "type", "is_pk")), "|").alias("columns"), F.array_join(F.transform("relations", text("target", "symbol", "label")), "|").alias("relations"))


@query(f"""WITH {_S} SELECT 'P' || k AS name, 'books' AS label, 'p' || q || 's' AS target, 'P' || q AS resolved FROM s UNION ALL SELECT 'P' || k, 'owner', 'X' || n, NULL FROM s UNION ALL SELECT 'P' || k, 'user_id', 'users' || n, NULL FROM s""")
def resolved_relations(spark, sf_dir):
    """Relations whose targets are known by some form of their names."""
    return entities.resolved_targets(both_dialects(spark, sf_dir)).select("name", "label", "target", "resolved")


@query(f"""WITH {_S}, {_ORD} SELECT ord, 'P' || k AS "Table", 'Column' AS "Type", c.name AS "Name", c.details AS "Details" FROM o, (SELECT unnest([
  {{'p': 'id', 's': 0, 'details': 'Int PK'}}, {{'p': 'email', 's': 1, 'details': 'String'}}, {{'p': 'id', 's': 0, 'details': 'INT PK'}}, {{'p': 'total', 's': 1, 'details': 'DECIMAL(10, 2)'}}, {{'p': 'user_id', 's': 0, 'details': 'INT'}}]) AS x) t, LATERAL (SELECT x.p || CASE WHEN x.s = 1 THEN CAST(n AS VARCHAR) ELSE '' END AS name, x.details AS details) c
UNION ALL SELECT ord, 'P' || k, 'Relationship', 'books', '||--o{{ -> p' || q || 's' FROM o UNION ALL SELECT ord, 'P' || k, 'Relationship', 'owner', '}}o--|| -> X' || n FROM o UNION ALL SELECT ord, 'P' || k, 'Relationship', 'user_id', '}}o--|| -> users' || n FROM o""")
def data_dictionary(spark, sf_dir):
    """Columns and relations of all entities."""
    return entities.dictionary(both_dialects(spark, sf_dir)).drop("at")


# Routes ---------------------------------------------------------------------------------------------------------------

_API = """from services import load

@router.get("/item%2$ds/%1$d")
async def read_%1$d(x):
    return load(x)


@router.route("/w%1$d", methods=["POST", "PUT"])
def write_%1$d(x):
    return x
"""
_ROUTES = f"""{_S}, r AS (SELECT 'GET' AS method, '/item' || n || 's/' || k AS route, 'read_' || k AS handler, 'api/r' || k || '.py' AS path, 4 AS line, true AS is_async, 'load' AS calls, n FROM s
  UNION ALL SELECT unnest(['POST', 'PUT']), '/w' || k, 'write_' || k, 'api/r' || k || '.py', 9, false, '', NULL FROM s)"""


def api(spark, sf_dir) -> DataFrame:
    return routes.python_routes(supplier_files(spark, sf_dir, "api/r%1$d.py", _API))


def items(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select((n + 1).alias("ord"), F.concat(F.lit("Item"), n).alias("entity"))


@query(f"WITH {_ROUTES} SELECT method, route, handler, path, line, is_async, calls FROM r")
def python_api_routes(spark, sf_dir):
    """Routes of Python by their decorators."""
    return api(spark, sf_dir).select("method", "route", "handler", "path", "line", "is_async", *joined("calls"))


@query(f"""WITH {_S} SELECT 'GET' AS method, '/u' || k AS route, 'web/e' || k || '.js' AS path, 1 AS line FROM s UNION ALL SELECT 'POST', '/v' || n, 'web/e' || k || '.js', 1 FROM s""")
def express_routes(spark, sf_dir):
    """Routes of Express."""
    return routes.script_routes(supplier_files(spark, sf_dir, "web/e%1$d.js", "app.get('/u%1$d', f); router.post(\"/v%2$d\", g);\n")).select("method", "route", "path", "line")


@query(f"""WITH {_S} SELECT 'GET' AS method, 'all' || n AS route, 'web/n' || k || '.controller.ts' AS path, 3 AS line FROM s UNION ALL SELECT 'POST', '/', 'web/n' || k || '.controller.ts', 6 FROM s""")
def nest_routes(spark, sf_dir):
    """Routes of Nest."""
    text = "@Controller('cats')\nexport class C%1$d {\n  @Get('all%2$d')\n  all(): string { return ''; }\n\n  @Post()\n  add(): void {}\n}\n"
    return routes.script_routes(supplier_files(spark, sf_dir, "web/n%1$d.controller.ts", text)).select("method", "route", "path", "line")


@query(f"""WITH {_S}, v AS (SELECT unnest(['GET', 'POST']) AS method) SELECT 'GET' AS method, '/shop' || k AS route, 'app/(g)/shop' || k || '/page.tsx' AS path FROM s WHERE k % 3 = 0
UNION ALL SELECT method, '/api/x' || k, 'app/api/x' || k || '/route.ts' FROM s, v WHERE k % 3 = 1 UNION ALL SELECT method, '/api/y' || k, 'pages/api/y' || k || '.ts' FROM s, v WHERE k % 3 = 2""")
def next_routes(spark, sf_dir):
    """Routes of Next.js by where files lie."""
    files = supplier_files(spark, sf_dir, "app/(g)/shop%1$d/page.tsx|app/api/x%1$d/route.ts|pages/api/y%1$d.ts", "export default 1;\n", "export async function GET() {}\nexport const POST = 1;\n", "export default 1;\n")
    return routes.script_routes(files).select("method", "route", "path")


@query(f"WITH {_ROUTES} SELECT method, route, path, line, CASE WHEN n IS NOT NULL THEN 'Item' || n END AS entity FROM r")
def route_contracts(spark, sf_dir):
    """Routes and the entities that they serve."""
    return routes.contracts(api(spark, sf_dir), items(spark, sf_dir)).select("method", "route", "path", "line", "entity")


@query(f"WITH {_ROUTES} SELECT method, route, handler, path, calls AS call FROM r WHERE calls <> ''")
def route_traces(spark, sf_dir):
    """What the handlers of routes call."""
    return routes.traces(api(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT src AS vertex FROM e WHERE dst = 'src/pkg1/m1.py' UNION SELECT e.src FROM r JOIN e ON e.dst = r.vertex)
SELECT 'GET' AS method, '/m' || k AS route, path AS file FROM p WHERE path IN (SELECT vertex FROM r) OR path = 'src/pkg1/m1.py'""")
def routes_after_change(spark, sf_dir):
    """Routes in what a change of one module reaches."""
    files = modules(spark, sf_dir)
    found = routes.python_routes(supplier_files(spark, sf_dir, _MODULE, "@app.get('/m%1$d')\ndef f(x):\n    return x\n")).select("method", "route", F.col("path").alias("file"))
    return imports.affected_routes(found, graph.blast_radius(imports.import_edges(files), "src/pkg1/m1.py"), "src/pkg1/m1.py")


# Calls and what they mean ---------------------------------------------------------------------------------------------

#: By the key's remainder: how the parent is imported, how an object of the class comes about, who defines ``top``.
_CALLERS = (
    """from src.pkg%5$d.m%3$d import S%3$d


class S%1$d(S%3$d):
    def own(self):
        return self.top()

    def top(self):
        return leaf%1$d()


def leaf%1$d():
    return len('')


@app.get('/m%1$d')
def h%1$d(made: S%1$d):
    return made.own()
""",
    """from src.pkg%5$d.m%3$d import (
    S%3$d as Base,
)


class S%1$d(Base):
    def own(self):
        return self.top()


@app.get('/m%1$d')
def h%1$d():
    made = S%1$d()
    return made.own()
""",
    """import src.pkg%5$d.m%3$d as parent


class S%1$d(parent.S%3$d):
    def own(self):
        return super().top()


@app.get('/m%1$d')
def h%1$d():
    return S%1$d().own()
""",
)
_CALLS = f"""{_S}, up AS (SELECT k, k AS a, 0 AS d FROM s UNION ALL SELECT up.k, p.q, up.d + 1 FROM up JOIN s p ON p.k = up.a JOIN s z ON z.k = p.q WHERE p.q <> p.k),
top AS (SELECT k, arg_min(a, d) AS a FROM up WHERE a % 3 = 0 GROUP BY k),
p AS (SELECT s.*, 'src/pkg' || f || '/m' || k || '.py' AS path, 'src/pkg' || f || '/m' || k || '.py#' AS m, 'S' || k AS c, 'src/pkg' || a % 7 || '/m' || a || '.py#S' || a || '.top' AS above FROM s LEFT JOIN top USING (k)),
e AS (SELECT m || c || '.own' AS src, c || '.top' AS call, coalesce(above, m || c) AS dst, CASE WHEN above IS NULL THEN 'class' ELSE 'method' END AS kind FROM p WHERE k % 3 < 2
  UNION ALL SELECT m || c || '.own', 'super.top', above, CASE WHEN above IS NULL THEN NULL ELSE 'method' END FROM p WHERE k % 3 = 2
  UNION ALL SELECT m || c || '.own', 'super', NULL, NULL FROM p WHERE k % 3 = 2
  UNION ALL SELECT m || c || '.top', 'leaf' || k, m || 'leaf' || k, 'function' FROM p WHERE k % 3 = 0
  UNION ALL SELECT m || 'leaf' || k, 'len', NULL, NULL FROM p WHERE k % 3 = 0
  UNION ALL SELECT m || 'h' || k, c || '.own', m || c || '.own', 'method' FROM p
  UNION ALL SELECT m || 'h' || k, c, m || c, 'class' FROM p WHERE k % 3 > 0)"""


def callers(spark, sf_dir) -> DataFrame:
    return supplier_files(spark, sf_dir, _MODULE, *_CALLERS)


@query(f"WITH RECURSIVE {_CALLS} SELECT src, call, dst, kind FROM e")
def call_targets(spark, sf_dir):
    """The definitions that calls mean: through aliases, imported modules, types of names and any number of base classes."""
    return symbols.resolved_calls(callers(spark, sf_dir)).select("src", "call", "dst", "kind")


@query(f"""WITH RECURSIVE {_CALLS}, r AS (SELECT k, m || 'h' || k AS vertex, 0 AS depth FROM p UNION SELECT r.k, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.vertex WHERE e.dst IS NOT NULL),
n AS (SELECT q AS k, count(*) AS n FROM s WHERE q <> k GROUP BY q)
SELECT 'GET' AS method, '/m' || r.k AS route, vertex, min(depth) AS depth, max(CASE WHEN n > 5 THEN 'CORE' WHEN n >= 2 THEN 'SHARED' ELSE 'PERIPHERAL' END) AS risk
FROM r LEFT JOIN n ON n.k = regexp_extract(vertex, '/m([0-9]+)', 1)::BIGINT WHERE depth > 0 GROUP BY ALL""")
def route_reach(spark, sf_dir):
    """Every definition that the handlers of routes get to, over any number of calls, and how shared its file is."""
    files = callers(spark, sf_dir)
    return symbols.route_reach(routes.routes(files), symbols.resolved_calls(files), imports.import_edges(files)).select("method", "route", "vertex", "depth", "risk")


# The merged graph -----------------------------------------------------------------------------------------------------


def merged_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    found = both_dialects(spark, sf_dir)
    return asg.build(structure.python_classes(modules(spark, sf_dir)), found, entities.resolved_targets(found), routes.contracts(api(spark, sf_dir), items(spark, sf_dir)))


@query(f"""WITH {_ROUTES} SELECT 'src.pkg' || f || '.m' || k || '.S' || k AS id, 'S' || k AS name, 'CLASS' AS kind, 3 AS attributes, 2 AS methods FROM s
UNION ALL SELECT 'P' || k, 'P' || k, 'ENTITY', 4, 0 FROM s UNION ALL SELECT method || ' ' || route, method || ' ' || route, 'ENDPOINT', 0, 0 FROM r""")
def graph_vertices(spark, sf_dir):
    """Classes, entities and routes as vertices of one graph."""
    return merged_graph(spark, sf_dir)[0].select("id", "name", "kind", F.size("attributes").alias("attributes"), F.size("methods").alias("methods"))


@query(f"""WITH {_ROUTES} SELECT 'src.pkg' || f || '.m' || k || '.S' || k AS src, 'src.pkg' || g || '.m' || q || '.S' || q AS dst, 'INHERITS' AS kind FROM s
UNION ALL SELECT 'P' || k, 'P' || q, 'HAS_MANY' FROM s UNION ALL SELECT 'P' || k, 'X' || n, 'BELONGS_TO' FROM s UNION ALL SELECT 'P' || k, 'users' || n, 'BELONGS_TO' FROM s
UNION ALL SELECT method || ' ' || route, 'Item' || n, 'ROUTES_TO' FROM r WHERE n IS NOT NULL""")
def graph_edges(spark, sf_dir):
    """Their distinct edges."""
    return merged_graph(spark, sf_dir)[1].select("src", "dst", "kind")


@query(f"""WITH {_S} SELECT 'src/pkg' || f || '/m' || k || '.py' AS path, 'P' || (dense_rank() OVER (ORDER BY f) - 1) AS alias FROM s""")
def folder_aliases(spark, sf_dir):
    """Aliases of folders for diagrams."""
    files = modules(spark, sf_dir).withColumn("folder", F.element_at("folders", -1))
    return graph.numbered(files, ["folder"], "P").select("path", "alias")


@query(f"""WITH {_S}, l AS (SELECT 0 AS r, 'us-' || k AS id, 'US-' || k || ' [' || {_STATES_SQL} || '] Story of ' || k || ': to pay' AS text FROM s
  UNION ALL SELECT 1, 'us-' || k, 'US-' || k || ' given a cart when I pay then it ships ' || k FROM s UNION ALL SELECT 2, 'us-' || k, 'US-' || k || unnest([' BR01: one', ' BR-9: two']) FROM s)
SELECT r AS rank, text FROM l""")
def story_lines(spark, sf_dir):
    """Stories as lines for a reader, what matters first."""
    return context.story_lines(stories(spark, sf_dir)).select("rank.k", "text").withColumnRenamed("k", "rank")


# Detection ------------------------------------------------------------------------------------------------------------

_PARTS = (
    ("artisan", "x", "Laravel", "PHP"),
    ("composer.json", '{"require": {"laravel/framework": "1"}}', "Laravel", "PHP"),
    ("requirements.txt", "FastAPI==1", "FastAPI", "Python"),
    ("manage.py", "import django", "Django", "Python"),
    ("pom.xml", "spring-boot", "Spring Boot", "Java"),
    ("a.csproj", "x", ".NET Core / C#", "C#"),
    ("package.json", '{"dependencies": {"express": "1", "@nestjs/core": "1"}}', "NestJS", "JavaScript"),
    ("package.json", '{"devDependencies": {"next": "1"}}', "Next.js", "JavaScript"),
    ("package.json", '{"dependencies": {"koa": "1"}}', "Koa", "JavaScript"),
    ("package.json", '{"dependencies": {"express": "1"}}', "Express.js", "JavaScript"),
    ("package.json", '{"dependencies": {"knex": "1"}}', "Node.js", "JavaScript"),
    ("package.json", '{"dependencies": {"left": "1"}}', "Unknown", "Unknown"),
    ("app.py", "from flask import Flask", "Flask", "Python"),
    ("app.py", "from quart import Quart", "Quart", "Python"),
    ("go.mod", "module x", "Go", "Go"),
    ("go.mod", "require github.com/gin-gonic/gin", "Gin (Go)", "Go"),
    ("Cargo.toml", "x", "Rust", "Rust"),
    ("Cargo.toml", "actix-web", "Actix-web (Rust)", "Rust"),
    ("build.gradle", "x", "Java (Gradle)", "Java"),
    ("notes.txt", "x", "Unknown", "Unknown"),
)


@query(f"""WITH {_S} SELECT 's' || k AS part, (['{"', '".join(p[2] for p in _PARTS)}'])[1 + k % {len(_PARTS)}] AS framework, (['{"', '".join(p[3] for p in _PARTS)}'])[1 + k % {len(_PARTS)}] AS language FROM s""")
def framework_of_part(spark, sf_dir):
    """The framework of each part of a repository."""
    files = supplier_files(spark, sf_dir, "|".join(f"s%1$d/{p[0]}" for p in _PARTS), *[p[1] for p in _PARTS])
    return detect.frameworks(files, F.element_at("folders", 1))


@query("SELECT 'n' || n_nationkey AS src, 'n' || (n_nationkey // 2) AS dst, (n_nationkey // 2) % 3 = 0 AS database FROM nation")
def compose_services(spark, sf_dir):
    """Services of a compose file and what they depend on."""
    n = F.col("n_nationkey")
    one = F.concat(F.lit("  n"), n, F.lit(":\n    image: "), F.when(n % 3 == 0, "postgres:16").otherwise("web"), F.lit("\n    depends_on: [n"), F.floor(n / 2), F.lit("]\n"))
    text = read(spark, sf_dir, "nation").agg(F.concat(F.lit("services:\n"), F.array_join(F.array_sort(F.collect_list(one)), "")).alias("content"))  # one file
    return detect.service_edges(detect.services(as_files(text.select(F.lit("docker-compose.yml").alias("path"), "content"))))


@query(f"WITH {_S} SELECT 'nb/b' || k || '.ipynb' AS path, 'in' || k || '.csv|x' || n || '.json' AS inputs, 'out' || k || '.parquet' AS outputs FROM s")
def notebook_files(spark, sf_dir):
    """What notebooks read and write."""
    text = '{"cells": [{"cell_type": "code", "source": ["df = read_csv(\'in%1$d.csv\')\\n", "e = open(\'x%2$d.json\')"]}, {"cell_type": "markdown", "source": "x"}, {"cell_type": "code", "source": "df.to_parquet(\'out%1$d.parquet\')"}]}'
    return detect.notebook_lineage(supplier_files(spark, sf_dir, "nb/b%1$d.ipynb", text)).select("path", *joined("inputs", "outputs"))


# Requirements and product documents -----------------------------------------------------------------------------------

_STORY = """# US-%1$d [{}] - Story of %1$d

- **Role**: buyer %2$d
- **Want**: to pay

## Business Rules

- one
- BR-9: two

## Acceptance Criteria

- Given a cart, When I pay, Then it ships %1$d

## Open Questions

- why
"""


def stories(spark, sf_dir) -> DataFrame:
    return documents.requirements(supplier_files(spark, sf_dir, f"r%1$d/{documents.HOME}/requirements/US-%1$d.md", *[_STORY.format(s) for s in documents.STORY_STATUS]))


@query(f"""WITH {_S} SELECT 'US-' || k AS id, 'Story of ' || k AS title, 'buyer ' || n AS role, 'to pay' AS want, {_STATES_SQL} AS status, 'BR01 one|BR-9 two' AS rules, 'AC01 a cart/I pay/it ships ' || k AS criteria, 'why' AS open_questions FROM s""")
def requirement_stories(spark, sf_dir):
    """Stories from Markdown."""
    rule = lambda x: F.concat_ws(" ", x["id"], x["description"])
    criterion = lambda x: F.concat(x["id"], F.lit(" "), F.concat_ws("/", x["given"], x["when"], x["then"]))
    return stories(spark, sf_dir).select("id", "title", "role", "want", "status", F.array_join(F.transform("business_rules", rule), "|").alias("rules"), F.array_join(F.transform("acceptance_criteria", criterion), "|").alias("criteria"), *joined("open_questions"))


@query(f"""WITH {_S} SELECT 'US-' || k AS id, 'Log in ' || n AS title, CASE WHEN k % 2 = 0 THEN 'DONE' ELSE 'TODO' END AS status, 'AC01' AS criteria FROM s""")
def requirement_json(spark, sf_dir):
    """Stories from JSON, with and without a status."""
    text = '{{"story": {{"id": "US-%1$d", "title": "Log in %2$d"{}}}, "acceptance_criteria": [{{"id": "AC01", "given": "a", "when": "b", "then": "c"}}]}}'
    files = supplier_files(spark, sf_dir, f"r%1$d/{documents.HOME}/requirements/US-%1$d.json", text.format(', "status": "done"'), text.format(""))
    return documents.requirements(files).select("id", "title", "status", F.array_join(F.transform("acceptance_criteria", lambda x: x["id"]), "|").alias("criteria"))


#: JSON by the key's remainder, with what is wrong with it: ``#`` stands for brackets, ``@`` for zeros, by the nation.
_ODD_JSON = (
    ('{"id": "US-%1$d", "x": #}', "CASE WHEN n > 12 THEN 'JSON_DEPTH' END"),
    ('{"id": "US-%1$d", "x": [@]}', "CASE WHEN n > 12 THEN 'JSON_NODES' END"),
    ('{"id": "US-%1$d", "x": {"b": 1, "\\u0062": 2}}', "'JSON_DUPLICATE_KEY'"),
    ('{"id": "US-%1$d", "x": "[[{{ \\" ]"}', "NULL"),
    ('{"id": "US-%1$d", "x": NaN}', "'INVALID_JSON'"),
    ('{"id": "US-%1$d"} {"id": 2}', "'INVALID_JSON'"),
    ('{"id": "US-%1$d", "story": null}', "'SCHEMA_INVALID'"),
    ('{"id": "US-%1$d", "validations": [{"field": "a"}, 1]}', "'SCHEMA_INVALID'"),
    ('{"id": "US-%1$d", "open_questions": ["why", 2]}', "'SCHEMA_INVALID'"),
    ('[{"id": "US-%1$d"}]', "'SCHEMA_INVALID'"),
    ('{"id": "US-%1$d", "exceptions": []}', "NULL"),
)


@query(f"""WITH {_S} SELECT 'r' || k || '/{documents.HOME}/requirements/US.json' AS path, CASE k % {len(_ODD_JSON)} {' '.join(f'WHEN {i} THEN {p}' for i, (_, p) in enumerate(_ODD_JSON))} END AS problem FROM s""")
def requirement_json_problems(spark, sf_dir):
    """JSON stories that are too deep, too large, broken, ambiguous or of the wrong shape."""
    deep = F.concat(F.repeat(F.lit("["), (F.col("n") + 51).cast("int")), F.repeat(F.lit("]"), (F.col("n") + 51).cast("int")))
    zeros = F.concat(F.repeat(F.lit("0,"), (F.col("n") + 9982).cast("int")), F.lit("0"))
    rows = suppliers(spark, sf_dir)
    text = F.element_at(F.array(*[F.format_string(t, "k") for t, _ in _ODD_JSON]), (F.col("k") % len(_ODD_JSON) + 1).cast("int"))
    files = as_files(rows.select(F.format_string(f"r%d/{documents.HOME}/requirements/US.json", "k").alias("path"), F.replace(F.replace(text, F.lit("#"), deep), F.lit("@"), zeros).alias("content")))
    return documents.requirements(files).select("path", "problem")


_DETAILS = """# US-%1$d - Pay

## Required %2$d Data

- `amount_%1$d`: number %2$d
free text %2$d

## Validaciones

* amount - at least %1$d

## Exceptions

- E%1$d: too much
- nothing else
"""


@query(f"""WITH {_S} SELECT 'US-' || k AS id, 'field=amount_' || k || ',type=number ' || n || '|field=free text ' || n || ',type=string' AS required_data,
'field=amount,rule=at least ' || k AS validations, 'code=E' || k || ',description=too much|code=EXCEPTION,description=nothing else' AS exceptions FROM s WHERE k % 2 = 0
UNION ALL SELECT 'US-' || k, 'field=a' || n || ',type=int', '', 'code=E' || k FROM s WHERE k % 2 = 1""")
def requirement_details(spark, sf_dir):
    """Data, validations and exceptions of stories, from Markdown and JSON."""
    rows = supplier_files(spark, sf_dir, f"r%1$d/{documents.HOME}/requirements/US.md|r%1$d/{documents.HOME}/requirements/US.json", _DETAILS, '{"id": "US-%1$d", "required_data": [{"field": "a%2$d", "type": "int"}], "exceptions": [{"code": "E%1$d"}]}')
    pairs = lambda c: F.array_join(F.transform(c, lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")), "|")
    return documents.requirements(rows).select("id", *[pairs(c).alias(c) for c in ("required_data", "validations", "exceptions")])


@query(f"WITH {_S} SELECT count(*) AS stories, count(*) AS criteria, 2 * count(*) AS rules, count(*) AS questions FROM s")
def requirement_totals(spark, sf_dir):
    """How much the stories hold."""
    return documents.requirement_totals(documents.collection(stories(spark, sf_dir)))


@query(f"""WITH {_S}, t AS (SELECT {_STATES_SQL} AS status FROM s), k AS (SELECT unnest(['TODO', 'IN_PROGRESS', 'TESTING', 'DONE', 'BLOCKED', 'OTHER']) AS status) SELECT k.status, count(t.status) AS n FROM k LEFT JOIN t USING (status) GROUP BY k.status""")
def requirement_status(spark, sf_dir):
    """Stories by status."""
    return documents.story_status_counts(documents.collection(stories(spark, sf_dir)))


@query(f"""WITH {_S} SELECT 'r' || n AS root, count(*) AS stories, array_to_string(list_sort(list(DISTINCT 'us-' || k)), '|') AS ids, false AS truncated FROM s GROUP BY n""")
def requirement_locations(spark, sf_dir):
    """Collections of stories in a repository."""
    files = supplier_files(spark, sf_dir, f"r%2$d/{documents.HOME}/requirements/US-%1$d.md", "# US-%1$d - x\n")
    return documents.locations(documents.requirements(files)).select("root", "stories", *joined("ids"), "truncated")


_PRODUCT = """---
id: PRD-%3$d
title: Product %1$d
status: {}
owner: o
schema_version: {}
applies_to: [pkg%4$d, ../out%2$d]
requirement_ids: [US-%1$d, US-gone%2$d]
---
## Problem Statement

{}

## Goals

None of them.

## Open Questions

- {}
"""
#: By the key's remainder: status, schema version, problem statement, open question.
_DRAFTS = (("DRAFT", "1", "TBD soon", "why"), ("REVIEW", "2", "It is slow.", "N/A"), ("APPROVED", "1", "It is slow.", "why"), ("LOST", "1", "It is slow.", "none."))
_DOCS = f"d AS (SELECT *, 'r' || k || '/{documents.HOME}/product/d.md' AS path, (['{"', '".join(d[0] for d in _DRAFTS)}'])[1 + k % 4] AS status FROM s)"
_GONE = ", ".join(f"'{x}'" for x in documents.SECTIONS if x not in ("Problem Statement", "Goals", "Open Questions"))
_FOUND = f"""{_S}, {_DOCS}, x AS (
  SELECT 'PRD_SCHEMA_UNSUPPORTED' AS code, 'ERROR' AS severity, path, 'schema_version' AS field, NULL AS section, '2' AS reference, k FROM d WHERE k % 4 = 1
  UNION ALL SELECT 'PRD_STATUS_INVALID', 'ERROR', path, 'status', NULL, 'LOST', k FROM d WHERE k % 4 = 3
  UNION ALL SELECT 'PRD_SECTION_MISSING', CASE WHEN k % 4 IN (1, 2) THEN 'ERROR' ELSE 'WARNING' END, path, NULL, unnest([{_GONE}]), NULL, k FROM d
  UNION ALL SELECT 'PRD_SECTION_PLACEHOLDER', 'WARNING', path, NULL, 'Problem Statement', NULL, k FROM d WHERE k % 4 = 0
  UNION ALL SELECT 'PRD_OPEN_QUESTIONS_PRESENT', 'WARNING', path, NULL, 'Open Questions', NULL, k FROM d WHERE k % 4 = 0
  UNION ALL SELECT 'PRD_OPEN_QUESTIONS_BLOCKING', 'ERROR', path, NULL, 'Open Questions', NULL, k FROM d WHERE k % 4 = 2
  UNION ALL SELECT 'PRD_REQUIREMENT_MISSING', 'ERROR', path, 'requirement_ids', NULL, 'US-gone' || n, k FROM d
  UNION ALL SELECT 'PRD_APPLIES_TO_INVALID', 'ERROR', path, 'applies_to', NULL, '../out' || n, k FROM d
  UNION ALL SELECT 'PRD_APPLIES_TO_MISSING', 'WARNING', path, 'applies_to', NULL, 'pkg' || f, k FROM d WHERE f > 2
  UNION ALL SELECT 'PRD_ID_DUPLICATE', 'ERROR', path, 'id', NULL, (SELECT min(e.path) FROM d e WHERE e.q = d.q), k FROM d WHERE path <> (SELECT min(e.path) FROM d e WHERE e.q = d.q)
  UNION ALL SELECT 'PRD_REQUIREMENT_ORPHAN', 'WARNING', 'r' || k || '/{documents.HOME}/requirements/US-x' || k || '.md', 'requirement_ids', NULL, 'US-x' || k, NULL FROM s)"""


def product_documents(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Product documents and what is found in them, beside stories that they name and stories that none names."""
    home = documents.HOME
    docs = supplier_files(spark, sf_dir, f"r%1$d/{home}/product/d.md", *[_PRODUCT.format(*d) for d in _DRAFTS])
    named_ = supplier_files(spark, sf_dir, f"r%1$d/{home}/requirements/US-%1$d.md", "# US-%1$d - x\n").unionByName(supplier_files(spark, sf_dir, f"r%1$d/{home}/requirements/US-x%1$d.md", "# US-x%1$d - x\n"))
    code = supplier_files(spark, sf_dir, "pkg%4$d/m%1$d.py", "").filter(F.col("path") < "pkg3")
    found = documents.products(docs)
    return found, documents.product_diagnostics(found, documents.requirements(named_), True, docs.unionByName(named_).unionByName(code))


@query(f"WITH {_FOUND} SELECT code, severity, path, field, section, reference FROM x")
def product_findings(spark, sf_dir):
    """The rules on product documents."""
    return product_documents(spark, sf_dir)[1].select("code", "severity", "path", "field", "section", "reference")


@query(f"""WITH {_FOUND}, c AS (SELECT k, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings FROM x GROUP BY k)
SELECT path, 'PRD-' || q AS id, errors, warnings, 0 AS infos, false AS valid, CASE k % 4 WHEN 1 THEN 'PRD_SCHEMA_UNSUPPORTED' WHEN 2 THEN 'PRD_SECTION_MISSING' WHEN 3 THEN 'PRD_STATUS_INVALID' ELSE 'PRD_REQUIREMENT_MISSING' END AS first_error FROM d JOIN c USING (k)""")
def product_reports(spark, sf_dir):
    """Findings of each product document in numbers, and its first error."""
    return documents.report(*product_documents(spark, sf_dir))


@query(f"WITH {_S}, {_DOCS} SELECT path FROM d WHERE f = 3")
def scope_overlap(spark, sf_dir):
    """Product documents that apply to a file."""
    text = _PRODUCT.replace(", ../out%2$d", "")
    docs = documents.products(supplier_files(spark, sf_dir, f"r%1$d/{documents.HOME}/product/d.md", *[text.format(*d) for d in _DRAFTS]))
    return documents.in_scope(docs, "pkg3/deep/x.py").select("path")


@query(f"WITH {_FOUND} SELECT code, x.path, reference FROM x LEFT JOIN d ON d.path = x.path WHERE code IN ('PRD_APPLIES_TO_INVALID', 'PRD_ID_DUPLICATE', 'PRD_REQUIREMENT_ORPHAN') OR d.f = 3 AND section IS NULL")
def product_findings_in_scope(spark, sf_dir):
    """The findings that concern one folder."""
    text = _PRODUCT.replace(", ../out%2$d", "")
    docs = documents.products(supplier_files(spark, sf_dir, f"r%1$d/{documents.HOME}/product/d.md", *[text.format(*d) for d in _DRAFTS]))
    found = product_documents(spark, sf_dir)[1].filter("section is null")
    return documents.scoped_diagnostics(found, docs, "pkg3").select("code", "path", "reference")
