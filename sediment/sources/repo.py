"""A source repository as a table of files: a Spark data source that walks it under its ignore rules."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sediment.functions.text import extension, file_name, folders, stem

#: Folders that are never read.
IGNORED = frozenset((
    ".git", ".github", ".idea", ".vscode", ".vs", "venv_subida", "tmp", "temp", "logs", ".DS_Store", "node_modules",
    "dist", "build", "out", ".next", ".nuxt", "bower_components", "bin", "obj", "Properties", "TestResults",
    "packages", "venv", ".venv", "env", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox",
    "coverage", ".coverage", "htmlcov", "site-packages", "target", ".gradle", ".mvn", "vendor", "storage",
    "bootstrap", "public", ".phpunit.cache", "pkg", ".bundle",
))
#: File categories by extension or name.
CATEGORIES = {
    "python": (".py",),
    "csharp": (".cs",),
    "js_ts": (".js", ".ts", ".jsx", ".tsx"),
    "java": (".java",),
    "php": (".php",),
    "config": (".json", ".yml", ".yaml", ".xml", ".toml", ".ini", ".conf", ".env", ".env.local"),
    "notebook": (".ipynb",),
    "compose": ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"),
}
#: Limits of an ignore file; one that exceeds them hides its whole folder.
IGNORE_BYTES, IGNORE_RULES, IGNORE_LENGTH = 1 << 20, 10_000, 4096
#: Bytes and files that one task reads (a larger file has a task of its own).
BYTES_PER_TASK = 64_000_000
FILES_PER_TASK = 256

SCHEMA = "path string, size long, mtime timestamp, sha256 string, content string"


@lru_cache(4096)
def _pattern(glob: str) -> re.Pattern:
    """A glob over a path as a regular expression; ``**`` crosses folders."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            out.append(fnmatch.translate(glob[i : end + 1]).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z"))
            i = end + 1
        elif c == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return re.compile("".join(out))


class IgnoreRules:
    """The rules of one ignore file, for paths below its folder; the last rule that matches decides."""

    def __init__(self, data: bytes):
        lines = data.decode("utf-8").split("\n")
        if len(data) > IGNORE_BYTES or len(lines) > IGNORE_RULES or any(len(x) > IGNORE_LENGTH for x in lines):
            raise ValueError("the ignore file exceeds a limit")
        self.rules = []
        for line in lines:
            line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r"))
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[negated:].replace("\\ ", " ")
            only_folders, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.lstrip("/")
            self.rules.append((_pattern(line if anchored else f"**/{line}"), negated, only_folders))

    def decide(self, path: str, is_folder: bool) -> bool | None:
        """True: ignored, False: wanted again, None: no rule says anything."""
        for pattern, negated, only_folders in reversed(self.rules):
            if (is_folder or not only_folders) and pattern.fullmatch(path):
                return not negated
        return None


def walk(root: str, max_depth: int | None = 10) -> Iterator[str]:
    """The files of a repository, in the order of their path components: no links, no ignored or hidden folders, no
    files that an ignore file names. An unreadable ignore file hides its folder."""
    return (path for path, _, problem in listed(root, max_depth) if problem is None)


def listed(root: str, max_depth: int | None = 10) -> Iterator[tuple[str, int, str | None]]:
    """Path and size of what ``walk`` finds, and a row with a problem for each folder that can't be listed or whose ignore
    file can't be followed: nothing below it is read."""
    stack: list[tuple[str, int, tuple]] = [("", 0, ())]
    while stack:
        folder, depth, rules = stack.pop()
        at = os.path.join(root, folder)
        try:
            entries = sorted(os.scandir(at), key=lambda e: e.name)
        except OSError as e:
            yield folder, 0, f"folder not listed: {e.strerror}"
            continue
        ignore = next((e for e in entries if e.name == ".gitignore"), None)
        if ignore is not None:
            try:
                if ignore.is_symlink():
                    raise ValueError("it is a link")
                with open(ignore.path, "rb") as f:
                    rules = (*rules, (folder, IgnoreRules(f.read(IGNORE_BYTES + 1))))
            except (OSError, ValueError) as e:
                yield folder, 0, f"ignore file not followed: {getattr(e, 'strerror', None) or e}"
                continue
        below = []
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            is_folder = e.is_dir(follow_symlinks=False)
            verdict = None
            for base, one in rules:
                said = one.decide(path[len(base) + 1 :] if base else path, is_folder)
                verdict = verdict if said is None else said
            if e.is_symlink() or verdict:
                continue
            if is_folder:
                hidden = e.name in IGNORED or e.name.startswith(".") or e.name.endswith(".egg-info")
                if not hidden and (max_depth is None or depth + 1 <= max_depth):
                    below.append((path, depth + 1, rules))
            elif e.is_file(follow_symlinks=False):
                try:
                    yield path, e.stat(follow_symlinks=False).st_size, None
                except OSError:
                    yield path, 0, None  # gone; its task says so
        stack += reversed(below)


class _Files(InputPartition):
    def __init__(self, paths: list[str], problems: list[tuple[str, str]]):
        self.paths, self.problems = paths, problems


def _verified(full: str) -> tuple[bytes, os.stat_result]:
    """A file's bytes and state, which is the same before and after they were read; raises if it isn't twice."""
    for _ in range(2):
        with os.fdopen(os.open(full, os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
            before, data, after = os.fstat(f.fileno()), f.read(), os.stat(full, follow_symlinks=False)
        state = lambda x: (x.st_ino, x.st_size, x.st_mtime_ns)
        if state(before) == state(after) and len(data) == after.st_size:
            return data, after
    raise ValueError("changed while it was read")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].removeprefix("file://")
        depth = options.get("maxdepth", options.get("maxDepth", "10"))
        self.depth = None if depth == "none" else int(depth)

    def partitions(self):
        """Files in tasks of about BYTES_PER_TASK, FILES_PER_TASK at most."""
        tasks, paths, held, problems = [], [], 0, []
        for path, size, problem in listed(self.root, self.depth):
            if problem is not None:
                problems.append((path, problem))
                continue
            if paths and (held + size > BYTES_PER_TASK or len(paths) >= FILES_PER_TASK):
                tasks.append(_Files(paths, []))
                paths, held = [], 0
            paths.append(path)
            held += size
        return [*tasks, _Files(paths, problems)]

    def read(self, partition):
        from datetime import UTC, datetime

        for path, problem in partition.problems:
            yield path, None, None, None, None, problem
        for path in partition.paths:
            try:
                data, state = _verified(os.path.join(self.root, path))
            except (OSError, ValueError) as e:
                yield path, None, None, None, None, f"file not read: {getattr(e, 'strerror', None) or e}"
                continue
            text = data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
            yield path, state.st_size, datetime.fromtimestamp(state.st_mtime, UTC), hashlib.sha256(data).hexdigest(), text, None


class RepoFiles(DataSource):
    """``spark.read.format("repo_files").option("maxDepth", "10").load(root)``; Spark's own text sources skip names that
    begin with ``_`` or ``.``, which this one needs. ``root`` is a folder that driver and executors see. A row is a file, or
    has the ``problem`` for which a file or folder was not read."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return f"{SCHEMA}, problem string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def named(files: DataFrame) -> DataFrame:
    """Files (path, ...) with ``name, stem, ext, folders, depth, categories``."""
    name = file_name(F.col("path"))
    rows = files.withColumns({"name": name, "stem": stem(name), "ext": extension(name), "folders": folders(F.col("path"))})
    kinds = [F.when(F.col("ext").isin(*v) | F.col("name").isin(*v), F.lit(k)) for k, v in CATEGORIES.items()]
    return rows.withColumns({"depth": F.size("folders"), "categories": F.array_compact(F.array(*kinds))})


def _loaded(spark: SparkSession, root: str, max_depth: int | None) -> DataFrame:
    spark.dataSource.register(RepoFiles)
    return spark.read.format("repo_files").option("maxDepth", "none" if max_depth is None else str(max_depth)).load(root)


def read_repo(spark: SparkSession, root: str, max_depth: int | None = 10) -> DataFrame:
    """The files of a repository (see ``named``) that could be read whole."""
    return named(_loaded(spark, root, max_depth).filter("problem is null").drop("problem"))


def read_problems(spark: SparkSession, root: str, max_depth: int | None = 10) -> DataFrame:
    """``path, problem`` of files and folders of a repository that are not read: gone, changed meanwhile, unreadable, or
    under an ignore file that can't be followed."""
    return _loaded(spark, root, max_depth).filter("problem is not null").select("path", "problem")


def from_rows(spark: SparkSession, rows: dict[str, str]) -> DataFrame:
    """Files from a mapping of paths to contents, as ``read_repo`` gives them."""
    data = [(p, len(c.encode()), hashlib.sha256(c.encode()).hexdigest(), c) for p, c in sorted(rows.items())]
    frame = spark.createDataFrame(data, "path string, size long, sha256 string, content string")
    return named(frame.withColumn("mtime", F.lit(None).cast("timestamp")).select("path", "size", "mtime", "sha256", "content"))


def with_suffix(files: DataFrame, *suffixes: str) -> DataFrame:
    return files.filter(F.col("ext").isin(*suffixes))


def within_depth(files: DataFrame, depth: int | None) -> DataFrame:
    return files if depth is None else files.filter(F.col("depth") <= depth)


def path_order() -> list:
    """Order by path components, so that a folder's files come before those of folders that extend its name."""
    return [F.split("path", "/")]
