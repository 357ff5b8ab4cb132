"""Who imports whom: import statements, their resolution to files, degrees, reading order, and what a change reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.functions.text import any_of, folders, groups, normalized_path
from sediment.shared import joined
from sediment.sources.repo import IGNORED

#: What may follow a module's path, in the order in which it is tried.
ENDINGS = ("", ".py", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts", "/__init__.py")
BASES = ("", "src/")
#: Words in a path that make a tier, and what is left out of the reading order.
STORES = ("db", "models", "schema", "orm", "database", "infra", "config", "settings")
ENTRIES = ("main", "app", "index", "router", "server")
CORES = ("service", "controller", "util", "helper", "manager", "handler")
NOISE = ("test_", ".test.", ".spec.", "conftest")
NO_CODE = (".exe", ".bat", ".ps1", ".cfg", ".json", ".yaml", ".yml", ".toml", ".ini", ".md", ".txt")


def import_statements(files: DataFrame) -> DataFrame:
    """``path, module`` of the import statements of Python and JavaScript or TypeScript files, distinct."""
    text = F.col("content")
    python = F.concat(groups(text, r"(?m)^from\s+(\S+)\s+import"), groups(text, r"(?m)^import\s+(\S+)"))
    script = F.concat(groups(text, r"""from\s+['"]([^'"]+)['"]"""), groups(text, r"""require\(\s*['"]([^'"]+)['"]\s*\)"""))
    modules = F.when(F.col("ext") == ".py", python).when(F.col("ext").isin(".js", ".ts", ".jsx", ".tsx"), script)
    return files.select("path", F.explode(F.array_distinct(modules)).alias("module"))


def candidates(path: Column, module: Column) -> Column:
    """The paths that an import may mean, in the order in which they are tried. ``./`` and ``../`` and leading dots
    start at the importing file's folder; dots in other modules separate folders. What would leave the root has none."""
    own = folders(path)
    slashed = module.rlike(r"^\.\.?/")
    dots = F.length(F.regexp_extract(module, r"^(\.+)", 1))
    rest = F.split(F.regexp_replace(module, r"^\.+", ""), r"\.")
    up = F.when(dots - 1 <= F.size(own), F.slice(own, 1, F.greatest(F.size(own) - dots + 1, F.lit(0))))
    relative = F.when(slashed, normalized_path(F.concat(own, F.split(module, "/")))).otherwise(normalized_path(F.concat(up, rest)))
    tried = lambda base: [F.concat(base, F.lit(e)) for e in ENDINGS]
    flat = F.regexp_replace(module, r"\.(?!(?:py|js|ts|jsx|tsx)$)", "/")
    absolute = [c for b in BASES for c in tried(F.concat(F.lit(b), flat))]
    return F.when(module.startswith("."), F.array(*tried(relative))).otherwise(F.array(*absolute))


def first_candidate(rows: DataFrame, keys: list[str], options: Column, targets: DataFrame, target: str) -> DataFrame:
    """For each row (``keys`` name it), the first of its ``options`` (an array in order) that ``targets`` has in column
    ``target``: the keys and that column. Rows without any are left out. An equi-join on the options; the least
    position is aggregated, so no row's options are gathered."""
    tried = rows.select(*keys, F.posexplode(options).alias("_at", target)).filter(F.col(target).isNotNull())
    hits = joined(tried, targets.select(target).distinct(), [target])
    return hits.groupBy(*keys).agg(F.min(F.struct("_at", target)).alias("_first")).select(*keys, f"_first.{target}")


def import_edges(files: DataFrame) -> DataFrame:
    """``src, dst``: distinct pairs of files of which one imports the other."""
    found = import_statements(files).withColumnRenamed("path", "src")
    named = files.select(F.col("path").alias("dst"))
    return first_candidate(found, ["src", "module"], candidates(F.col("src"), F.col("module")), named, "dst").select("src", "dst").filter("src != dst").distinct()


def degrees(vertices: DataFrame, edges: DataFrame, vertex: str = "path") -> DataFrame:
    """``vertices`` with ``in_degree`` and ``out_degree`` over ``edges`` (src, dst)."""
    into = edges.groupBy(F.col("dst").alias(vertex)).agg(F.count(F.lit(1)).alias("in_degree"))
    out = edges.groupBy(F.col("src").alias(vertex)).agg(F.count(F.lit(1)).alias("out_degree"))
    return vertices.join(into, vertex, "left").join(out, vertex, "left").na.fill(0, ["in_degree", "out_degree"])


def adjacency(edges: DataFrame, key: str, other: str) -> DataFrame:
    return edges.groupBy(key).agg(F.array_sort(F.collect_set(other)).alias(other))


def heat_class(in_degree: Column) -> Column:
    return F.when(in_degree > 5, "CORE").when(in_degree >= 2, "SHARED").otherwise("PERIPHERAL")


def heatmap(edges: DataFrame, shown: int = 3) -> DataFrame:
    """``dst, in_degree, class, dependents``: the first ``shown`` dependents by name and how many more there are. Only
    these few are kept while aggregating, by rank within the target."""
    rank = F.row_number().over(Window.partitionBy("dst").orderBy("src"))
    few = edges.withColumn("_n", rank).filter(F.col("_n") <= shown).groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("_few"))
    counts = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"))
    more = F.when(F.col("in_degree") > shown, F.concat(F.lit(" (+"), (F.col("in_degree") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return counts.join(few, "dst").select("dst", "in_degree", heat_class(F.col("in_degree")).alias("class"), F.concat(F.array_join("_few", ", "), more).alias("dependents"))


def tier(path: Column, in_degree: Column, out_degree: Column) -> Column:
    """3 for stores and settings (asked first), 1 for entry points, 2 for core logic, else 4."""
    low = F.lower(path)
    return (
        F.when(any_of(low, STORES), 3)
        .when(((in_degree <= 1) & (out_degree >= 1)) | any_of(low, ENTRIES), 1)
        .when((in_degree >= 2) | any_of(low, CORES), 2)
        .otherwise(4)
    )


#: Folders of environments, in any case.
ENVIRONMENTS = (".venv", "env", "venv", "__pycache__")


def reading_order(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``ord, path, tier, role, in_degree, out_degree``: files by tier, then by how many import them, then by path. Tier
    4 is left out unless there is nothing else; then its first 15 are shown."""
    hidden = F.exists(F.split("path", "/"), lambda p: p.isin(*sorted(IGNORED)) | F.lower(p).isin(*ENVIRONMENTS) | p.startswith("."))
    code = files.filter(~F.col("ext").isin(*NO_CODE) & ~hidden & ~any_of(F.lower("path"), NOISE)).select("path")
    rows = degrees(code, edges).withColumn("tier", tier(F.col("path"), F.col("in_degree"), F.col("out_degree")))
    order = Window.partitionBy("tier").orderBy(F.desc("in_degree"), "path")
    ranked = rows.withColumn("_rank", F.row_number().over(order))
    counts = ranked.groupBy("tier").agg(F.count(F.lit(1)).alias("_n"))  # four rows
    offsets = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    any_tier = counts.agg(F.coalesce(F.max(F.col("tier") < 4), F.lit(False)).alias("_some"))
    kept = ranked.join(F.broadcast(offsets), "tier").withColumn("_one", F.lit(1)).join(F.broadcast(any_tier.withColumn("_one", F.lit(1))), "_one")
    kept = kept.filter(F.when(F.col("_some"), F.col("tier") < 4).otherwise(F.col("_rank") <= 15))
    role = F.element_at(F.array(*[F.lit(r) for r in ("Entrypoint & Router", "Core Business Logic", "Database & Infra", "Peripheral / Helper")]), F.col("tier"))
    place = F.when(F.col("_some"), F.col("_base") + F.col("_rank")).otherwise(F.col("_rank"))
    return kept.select(place.cast("int").alias("ord"), "path", "tier", role.alias("role"), "in_degree", "out_degree")


def affected_routes(routes: DataFrame, reached: DataFrame, changed: str, strict: bool = False) -> DataFrame:
    """The routes (with column ``file``) in reached files (``vertex``) or the changed one; ``strict`` gives none if
    nothing is reached."""
    spark = routes.sparkSession
    own = spark.range(1).select(F.lit(changed).alias("file"))
    files = reached.select(F.col("vertex").alias("file"))
    every = files.unionByName(own)
    if strict:
        some = files.limit(1).select(F.lit(1).alias("_one"))
        every = every.withColumn("_one", F.lit(1)).join(F.broadcast(some), "_one", "left_semi").drop("_one")
    return routes.join(every.distinct(), "file", "left_semi")


def single_file_imports(files: DataFrame) -> DataFrame:
    """``path, dep``: the word right after from or import names another file of the repository by its stem."""
    words = files.filter(F.col("ext") == ".py").select("path", F.col("stem").alias("_own"), F.explode(F.array_distinct(groups(F.col("content"), r"(?m)^\s*(?:from|import)\s+(\w+)"))).alias("dep"))
    stems = files.filter(F.col("ext").isin(".py", ".cs", ".js", ".ts")).select(F.col("stem").alias("dep")).distinct()
    return words.filter("dep != _own").join(stems, "dep", "left_semi").select("path", "dep")


def topology(files: DataFrame) -> DataFrame:
    """One row ``topology``: sorted distinct edges of files to what their name says they serve, ``;`` between them."""
    low, name = F.lower("name"), F.col("name")
    folder = F.when(F.size("folders") > 0, F.element_at("folders", -1)).otherwise(F.lit("ROOT"))
    in_folder = F.concat(folder, F.lit(" [DIR] -> "), name)

    def serves(kind: str, what: str) -> Column:
        return F.concat(F.lit(f"[{kind}] "), name, F.lit(f" -> {what}"))

    deps = single_file_imports(files).groupBy("path").agg(F.collect_set("dep").alias("_deps"))
    rows = files.select("path", "name", "ext", "folders").join(deps, "path", "left")
    python = (
        F.when(any_of(low, ("controller", "ctrl")), F.array(serves("Controller", "API")))
        .when(any_of(low, ("model", "entity", "schema")), F.array(serves("Model", "Database")))
        .when(any_of(low, ("service", "svc")), F.array(serves("Service", "Business_Logic")))
        .when(any_of(low, ("route", "router")), F.array(serves("Route", "Endpoints")))
        .when(low.contains("middleware"), F.array(serves("Middleware", "Request_Pipeline")))
        .when(F.size("_deps") > 0, F.transform("_deps", lambda d: F.concat(name, F.lit(" -> "), d, F.lit(".py"))))
        .otherwise(F.array(in_folder))
    )
    sharp = (
        F.when(low.contains("controller"), serves("Controller", "API"))
        .when(any_of(low, ("model", "entity")), serves("Model", "Database"))
        .when(any_of(low, ("service", "repository")), serves("Service", "Business_Logic"))
        .otherwise(in_folder)
    )
    other = (
        F.when(name == "docker-compose.yml", F.concat(F.lit("docker-compose.yml -> "), folder, F.lit(" [App]")))
        .when(name.isin("Dockerfile", "Cargo.toml", "package.json", "go.mod", "pom.xml", "tsconfig.json"), in_folder)
        .when(F.col("ext") == ".cs", sharp)
        .when(F.col("ext").isin(".csproj", ".sln"), F.concat(folder, F.lit(" [Solution/Project] -> "), name))
        .when(F.col("ext") == ".tf", F.concat(F.lit("Terraform -> "), name))
        .when(F.col("ext").isin(".sql", ".db", ".sqlite"), serves("Database", "Data_Storage"))
    )
    edges = rows.select(F.explode(F.when(F.col("ext") == ".py", python).otherwise(F.array_compact(F.array(other)))).alias("edge"))
    return edges.agg(F.array_join(F.array_sort(F.collect_set("edge")), " ; ").alias("topology"))
