"""What a repository is made with: frameworks, architecture, features, services, notebooks."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.text import any_of

#: Parts of a monorepo.
PARTS = ("frontend", "backend", "client", "server", "apps/web", "apps/api", "packages/web", "packages/api", "web", "api")


#: Packages that tell of a script framework in the order in which they count, and of a data layer.
SCRIPT_FRAMEWORKS = (("@nestjs/core", "NestJS"), ("next", "Next.js"), ("fastify", "Fastify"), ("koa", "Koa"), ("express", "Express.js"))
SCRIPT_STORES = ("prisma", "@prisma/client", "typeorm", "sequelize", "mongoose", "drizzle-orm", "knex")
UNKNOWN = "Unknown"


def packages() -> Column:
    """What a package file or composer file depends on, as an array of names (null for text that is no JSON)."""
    keys = [F.json_object_keys(F.get_json_object("content", f"$.{k}")) for k in ("dependencies", "devDependencies", "require", "require-dev")]
    return F.concat(*[F.coalesce(k, F.array().cast("array<string>")) for k in keys])


def rules() -> list[tuple[str, str, Column]]:
    """Frameworks in the order in which they are asked: name, language, condition on a file."""
    name, text, ext = F.col("name"), F.col("content"), F.col("ext")
    imports = lambda module: (ext == ".py") & text.rlike(rf"(?m)^\s*(?:from\s+{module}\b.*\bimport|import\s+{module}\b)")
    package, gradle = name == "package.json", name.isin("build.gradle", "build.gradle.kts")
    django = (name == "manage.py") & (F.lower(text).contains("django") | text.contains("DJANGO_SETTINGS_MODULE"))
    django |= (name == "settings.py") & any_of(text, ("INSTALLED_APPS", "DJANGO_SETTINGS_MODULE"))
    django |= name.isin("wsgi.py", "asgi.py") & F.lower(text).contains("django")
    spring = (name == "pom.xml") & text.contains("spring-boot")
    spring |= gradle & any_of(text, ("spring-boot", "org.springframework.boot"))
    return [
        ("Laravel", "PHP", (name == "artisan") | ((name == "composer.json") & F.array_contains(packages(), "laravel/framework"))),
        ("FastAPI", "Python", (name.isin("requirements.txt", "Pipfile", "pyproject.toml") & F.lower(text).contains("fastapi")) | imports("fastapi")),
        ("Django", "Python", django),
        ("Spring Boot", "Java", spring),
        (".NET Core / C#", "C#", ext.isin(".csproj", ".sln")),
        *[(shown, "JavaScript", package & F.array_contains(packages(), key)) for key, shown in SCRIPT_FRAMEWORKS],
        ("Node.js", "JavaScript", package & F.arrays_overlap(packages(), F.array(*[F.lit(k) for k in SCRIPT_STORES]))),
        ("Flask", "Python", imports("flask")),
        ("Quart", "Python", imports("quart")),
        ("Gin (Go)", "Go", (name == "go.mod") & text.contains("gin-gonic/gin")),
        ("Fiber (Go)", "Go", (name == "go.mod") & text.contains("gofiber/fiber")),
        ("Go", "Go", name == "go.mod"),
        ("Actix-web (Rust)", "Rust", (name == "Cargo.toml") & text.contains("actix-web")),
        ("Rocket (Rust)", "Rust", (name == "Cargo.toml") & text.contains("rocket")),
        ("Rust", "Rust", name == "Cargo.toml"),
        ("PHP", "PHP", name == "composer.json"),
        ("Java (Maven)", "Java", name == "pom.xml"),
        ("Java (Gradle)", "Java", gradle),
    ]


def frameworks(files: DataFrame, part: Column | None = None, first: list[tuple[str, str, Column]] | None = None) -> DataFrame:
    """``part, framework, language``: for each part of the repository the first framework that a file tells of, else
    Unknown. ``first`` are rules of the caller's own, which are asked before the others."""
    every = [*(first or []), *rules()]
    hit = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(i).alias("i"), F.lit(n).alias("framework"), F.lit(lang).alias("language"))) for i, (n, lang, cond) in enumerate(every)]))
    rows = files.withColumn("part", part if part is not None else F.lit("")).filter("part is not null")
    found = rows.select("part", F.array_min(hit).alias("h")).groupBy("part").agg(F.min("h").alias("h"))
    return found.select("part", F.coalesce("h.framework", F.lit(UNKNOWN)).alias("framework"), F.coalesce("h.language", F.lit(UNKNOWN)).alias("language"))


def monorepo(files: DataFrame) -> DataFrame:
    """Parts with their frameworks, if at least two different ones are among them."""
    part = F.lit(None).cast("string")
    for p in PARTS:
        part = F.coalesce(part, F.when(F.col("path").startswith(f"{p}/"), F.lit(p)))
    found = frameworks(files, part).filter(F.col("framework") != UNKNOWN)
    several = found.agg(F.count_distinct("framework").alias("n")).filter("n >= 2").select(F.lit(1).alias("_one"))
    return found.withColumn("_one", F.lit(1)).join(F.broadcast(several), "_one", "left_semi").drop("_one")


def features(files: DataFrame) -> DataFrame:
    """One row ``features``: sorted names."""
    name, ext, low = F.col("name"), F.col("ext"), F.lower("content")
    code = ext.isin(".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".json", ".toml", ".yaml", ".yml", ".mod")
    orms = ("sqlalchemy", "django.db", "prisma", "typeorm", "sequelize", "mongoose", "gorm.io", "database/sql", "sqlx", "diesel")
    tests = {
        "Database": ext.isin(".sql", ".db", ".sqlite") | (code & any_of(low, orms)),
        "Docker": F.col("path") == "Dockerfile",
        "Docker Compose": F.col("path").isin("docker-compose.yml", "docker-compose.yaml"),
        "GitHub Actions": F.col("path").startswith(".github/workflows/"),
        "GitLab CI": F.col("path") == ".gitlab-ci.yml",
        "Unit Tests": (ext == ".py") & (name.startswith("test_") | name.endswith("_test.py")),
        "Swagger/OpenAPI": (ext == ".py") & low.contains("swagger"),
        "Authentication": ((ext == ".py") & any_of(F.col("content"), ("jwt", "JWT", "oauth", "OAuth", "auth"))) | (code & (low.rlike(r"\b(jwt|oauth2?|authentication|authorization|auth middleware)\b") | F.lower("stem").contains("auth"))),
        "SQLAlchemy ORM": (ext == ".py") & low.contains("sqlalchemy"),
        "Django ORM": (ext == ".py") & F.col("content").contains("django.db"),
    }
    seen = files.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in tests.items()])
    return seen.select(F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"`{n}`"), F.lit(n)) for n in tests]))).alias("features"))


#: Names of the folders that an architecture is read from.
FOLDERS = {"controllers": ("controllers", "controller"), "models": ("models", "model", "entities"), "services": ("services", "service"), "routes": ("routes", "routers", "router")}


def settings(files: DataFrame, section: str) -> dict[str, list[str]]:
    """The lists of names under ``[tool.<section>]`` of the project file at the root; none if it is missing or broken."""
    found = files.filter(F.col("path") == "pyproject.toml").select("content").limit(1).collect()  # one file
    try:
        table = tomllib.loads(found[0]["content"]).get("tool", {}).get(section, {}) if found else {}
    except tomllib.TOMLDecodeError:
        return {}
    return {k: [str(x) for x in v] for k, v in table.items() if isinstance(v, list)}


def architecture(files: DataFrame, names: dict[str, list[str]] | None = None) -> DataFrame:
    """One row ``architecture``. ``names`` replaces folder names (see FOLDERS)."""
    known = {k: [x.lower() for x in v] for k, v in {**FOLDERS, **(names or {})}.items()}
    folder = lambda *names: F.coalesce(F.bool_or(F.exists("folders", lambda f: F.lower(f).isin(*names))), F.lit(False))
    at = lambda *names: F.coalesce(F.bool_or(F.col("path").isin(*names)), F.lit(False))
    services = F.max(F.when(F.col("path") == "docker-compose.yml", F.size(F.regexp_extract_all("content", F.lit(r"(image:|build:)"), F.lit(1)))).otherwise(0))
    facts = files.filter(F.size("folders") >= 0).agg(
        F.coalesce(F.bool_or((F.col("name") == "package.json") & F.col("content").rlike(r'"next"\s*:')), F.lit(False)).alias("next"),
        folder(*known["controllers"]).alias("c"), folder(*known["models"]).alias("m"), folder(*known["services"]).alias("s"), folder(*known["routes"]).alias("r"),
        at("docker-compose.yml", "docker-compose.yaml", "Dockerfile").alias("d"), services.alias("n"),
        F.coalesce(F.bool_or(F.col("path").startswith("app/") | F.col("path").startswith("src/app/")), F.lit(False)).alias("app"),
        F.coalesce(F.bool_or(F.col("path").startswith("pages/") | F.col("path").startswith("src/pages/")), F.lit(False)).alias("pages"),
    )
    kind = (
        F.when(F.col("next") & F.col("app"), "Next.js App Router")
        .when(F.col("next") & F.col("pages"), "Next.js Pages Router")
        .when(F.col("next"), "Next.js Project")
        .when(F.col("n") > 2, "Microservices Architecture")
        .when(F.col("c") & F.col("m") & F.col("s"), "MVC + Services (Layered)")
        .when(F.col("c") & F.col("m"), "MVC Pattern")
        .when(F.col("r") & F.col("m"), "REST API (Route-based)")
        .when(F.col("d"), "Containerized Application")
        .otherwise("Monolithic Application")
    )
    return facts.select(kind.alias("architecture"))


def services(files: DataFrame) -> DataFrame:
    """``name, image, build, depends_on, links`` of the compose file at the root."""
    schema = "name string, image string, build string, depends_on array<string>, links array<string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for frame in frames:
            rows = []
            for content in frame["content"]:
                try:
                    found = (yaml.safe_load(content) or {}).get("services") or {}
                except (yaml.YAMLError, AttributeError):
                    continue
                for name, spec in found.items():
                    spec = spec or {}
                    build = spec.get("build")
                    rows.append((name, spec.get("image"), build.get("context") if isinstance(build, dict) else build, list(spec.get("depends_on") or []), [str(x).partition(":")[0] for x in spec.get("links") or []]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    order = F.array_position(F.array(*[F.lit(n) for n in ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")]), F.col("path"))
    first = files.filter(order > 0).orderBy(order).limit(1)
    return first.select("content").mapInPandas(run, schema)


def service_edges(found: DataFrame) -> DataFrame:
    """``src, dst, database``: what a service depends on or links to, once; ``database`` says that the target is one."""
    image = F.lower(F.coalesce("image", "name"))
    stores = found.select(F.col("name").alias("dst"), any_of(image, ("postgres", "mysql", "mariadb", "mongo", "redis", "sqlite", "mssql", "elasticsearch")).alias("database"))
    edges = found.select(F.col("name").alias("src"), F.explode(F.array_distinct(F.concat("depends_on", "links"))).alias("dst"))
    return edges.join(stores, "dst", "left").select("src", "dst", F.coalesce("database", F.lit(False)).alias("database"))


def notebook_lineage(files: DataFrame) -> DataFrame:
    """``path, inputs, outputs`` of notebooks, in order of first mention."""
    cells = F.from_json("content", "struct<cells:array<struct<cell_type:string,source:string>>>")["cells"]
    code = F.transform(F.filter(cells, lambda c: c["cell_type"] == "code"), lambda c: F.concat_ws("", F.coalesce(F.from_json(c["source"], "array<string>"), F.array(c["source"]))))
    rows = files.filter(F.col("ext") == ".ipynb").select("path", F.array_join(code, "\n").alias("code")).filter("code is not null")
    grab = lambda p: F.array_distinct(F.regexp_extract_all("code", F.lit(p), F.lit(1)))
    return rows.select("path", grab(r"""(?:read_(?:csv|parquet|sql|json|excel)|open)\(\s*['"]([^'"]+)['"]""").alias("inputs"), grab(r"""(?:to_\w+|save|dump)\(\s*['"]([^'"]+)['"]""").alias("outputs"))


MODEL_HINTS = r"model|entity|entities|schema|domain"
ROUTE_HINTS = r"route|router|endpoint|controller|urls|views|resource|api"


def model_files(files: DataFrame) -> DataFrame:
    return files.filter(F.lower("stem").rlike(MODEL_HINTS) | F.exists("folders", lambda f: F.lower(f).rlike(MODEL_HINTS)) | (F.col("ext") == ".prisma"))


def route_files(files: DataFrame) -> DataFrame:
    return files.filter(F.lower("stem").rlike(ROUTE_HINTS) | F.exists("folders", lambda f: F.lower(f).rlike(ROUTE_HINTS)))
