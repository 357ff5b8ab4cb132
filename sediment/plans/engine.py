"""Analyses of one repository by name, over tables that are built once and read lazily."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.operators import asg, context, debt, detect, documents, entities, graph, imports, relational, routes, secrets, snapshots, structure, symbols
from sediment.shared import cut
from sediment.sources.repo import IGNORED, from_rows, read_repo


class Engine:
    """``Engine(spark, root)`` or ``Engine.of(spark, {path: content})``; each analysis is a DataFrame. ``home`` is the
    folder of requirements and product documents, ``[tool.<section>]`` of pyproject.toml may name folders of an
    architecture."""

    #: Analyses that were registered, by name.
    REGISTERED: dict[str, Callable[[Engine], DataFrame]] = {}

    @classmethod
    def register(cls, name: str, analysis: Callable[[Engine], DataFrame]) -> None:
        """Add an analysis of one's own to those of all engines; a name that exists is replaced."""
        cls.REGISTERED[name] = analysis

    def __init__(self, spark: SparkSession, root: str | None = None, max_depth: int | None = 10, files: DataFrame | None = None, home: str = documents.HOME, section: str = "sediment"):
        self.spark, self.home, self.section = spark, home, section
        self.files = (read_repo(spark, root, max_depth) if files is None else files).persist()

    def close(self) -> None:
        """Give back what the engine keeps: tables in memory and parsed sources in the shared folder. What was made of these
        must not be read any more."""
        for name, kept in list(vars(self).items()):
            for one in kept if isinstance(kept, tuple) else (kept,):
                if isinstance(one, DataFrame):
                    one.unpersist()
                elif isinstance(one, structure.Parsed):
                    one.delete()
                    del self.__dict__[name]

    @classmethod
    def of(cls, spark: SparkSession, rows: dict[str, str], home: str = documents.HOME) -> Engine:
        return cls(spark, files=from_rows(spark, rows), home=home)

    @cached_property
    def edges(self) -> DataFrame:
        return imports.import_edges(self.files).persist()

    @cached_property
    def parsed(self) -> structure.Parsed:
        return structure.parsed(self.files)

    @cached_property
    def classes(self) -> DataFrame:
        return cut(structure.classes(self.parsed), "classes")

    @cached_property
    def entities(self) -> DataFrame:
        return cut(entities.merged(cut(entities.declared(self.parsed), "declared")), "entities")

    @cached_property
    def resolved(self) -> DataFrame:
        return entities.resolved_targets(self.entities).persist()

    @cached_property
    def routes(self) -> DataFrame:
        return routes.routes(self.files).persist()

    @cached_property
    def contracts(self) -> DataFrame:
        return routes.contracts(self.routes, self.entities.select("ord", F.col("name").alias("entity"))).persist()

    @cached_property
    def calls(self) -> DataFrame:
        return cut(symbols.resolved_calls(self.files), "calls")

    @cached_property
    def todos(self) -> DataFrame:
        return debt.debt_markers(self.files)

    @cached_property
    def risks(self) -> DataFrame:
        found = secrets.file_findings(self.files)
        from sediment.operators.lines import explode_lines

        shown = secrets.exposures(explode_lines(self.files), secrets.sensitive_entities(self.entities))
        message = F.concat(F.lit("Entity '"), "entity", F.lit("' (sensitive cols: "), "columns", F.lit(") exposed in "), "how")
        return found.unionByName(shown.select("path", "line", F.lit("Sensitive Data Exposure").alias("type"), F.lit("HIGH").alias("severity"), F.lit("Sensitive Data").alias("category"), message.alias("message")))

    @cached_property
    def health(self) -> DataFrame:
        folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
        tests = F.exists(folders, lambda f: f.isin("tests", *sorted(IGNORED))) | F.element_at(F.split("path", "/"), -1).startswith("test_")
        return secrets.health(self.todos, self.risks, tests)

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        vertices, edges = asg.build(self.classes, self.entities, self.resolved, self.contracts)
        return vertices.persist(), edges.persist()

    @cached_property
    def requirements(self) -> DataFrame:
        return documents.collection(documents.requirements(self.files, self.home))

    @cached_property
    def products(self) -> DataFrame:
        return documents.products(self.files, self.home)

    @cached_property
    def product_diagnostics(self) -> DataFrame:
        readable = documents.requirements(self.files, self.home).filter("problem is not null").isEmpty()
        return documents.product_diagnostics(self.products, self.requirements, readable, self.files)

    def blast_radius(self, path: str) -> DataFrame:
        return graph.blast_radius(self.edges, path)

    def affected_routes(self, path: str, strict: bool = False) -> DataFrame:
        return imports.affected_routes(self.routes.withColumnRenamed("path", "file"), self.blast_radius(path), path, strict)

    def onboarding(self) -> DataFrame:
        return imports.reading_order(self.files, self.edges)

    def save_snapshot(self, path: str, expected: int | None = None) -> int:
        """Keep what ``delta`` compares as the version after ``expected`` (null: the last one) and give its number; refused
        if another version was saved since."""
        return snapshots.save(self.files, path, expected)

    def delta(self, old: DataFrame | str) -> DataFrame:
        """What changed since an older table of files (path, mtime, size, sha256), or since the last version of saved
        snapshots, which must be as it was saved."""
        return relational.snapshot_diff(snapshots.load(self.spark, old)[0] if isinstance(old, str) else old, self.files)

    def save(self, name: str, path: str, form: str = "json") -> None:
        """Write one analysis under ``path`` in a format of Spark's (json, csv with a header, parquet)."""
        rows = self.analyses()[name]()
        (rows.coalesce(1).write.option("header", True) if form == "csv" else rows.write).format(form).save(path)

    def context(self, n: int = 5) -> str:
        sections = {"classes": asg.mermaid_classes(*self.graph), "entities": asg.mermaid_entities(self.entities, self.resolved)}
        return context.context_text(self.files, self.edges, sections, n)

    def analyses(self) -> dict[str, Callable[[], DataFrame]]:
        return {
            "files": lambda: self.files.drop("content"),
            "tree": lambda: context.tree(self.files),
            "uml": lambda: self.classes,
            "uml_edges": lambda: structure.class_edges(self.classes),
            "er": lambda: self.entities,
            "dictionary": lambda: entities.dictionary(self.entities),
            "routes": lambda: self.routes,
            "contract": lambda: self.contracts,
            "trace": lambda: routes.traces(self.routes),
            "calls": lambda: self.calls,
            "reach": lambda: symbols.route_reach(self.routes, self.calls, self.edges),
            "infra": lambda: detect.service_edges(detect.services(self.files)),
            "notebooks": lambda: detect.notebook_lineage(self.files),
            "todo": lambda: self.todos,
            "audit": lambda: self.risks,
            "health": lambda: self.health,
            "imports": lambda: self.edges,
            "impact": lambda: imports.heatmap(self.edges),
            "onboarding": self.onboarding,
            "topology": lambda: imports.topology(self.files),
            "framework": lambda: detect.frameworks(self.files),
            "monorepo": lambda: detect.monorepo(self.files),
            "features": lambda: detect.features(self.files),
            "architecture": lambda: detect.architecture(self.files, detect.settings(self.files, self.section)),
            "asg_nodes": lambda: self.graph[0],
            "asg_edges": lambda: self.graph[1],
            "requirements": lambda: self.requirements,
            "requirement_totals": lambda: documents.requirement_totals(self.requirements),
            "requirement_status": lambda: documents.story_status_counts(self.requirements),
            "products": lambda: self.products,
            "product_diagnostics": lambda: self.product_diagnostics,
            "product_report": lambda: documents.report(self.products, self.product_diagnostics),
            "core_files": lambda: context.core_files(self.files, self.edges),
            "mobile_core_files": lambda: context.mobile_core_files(self.files),
        } | {name: partial(f, self) for name, f in self.REGISTERED.items()}

    def diagram(self, name: str) -> str:
        """A diagram as text: classes, entities, routes, imports, or infra."""
        if name == "infra":
            edges = detect.service_edges(detect.services(self.files))
            return asg.mermaid_graph(edges, {r["dst"] for r in edges.filter("database").collect()})
        return {
            "classes": lambda: asg.mermaid_classes(*self.graph),
            "entities": lambda: asg.mermaid_entities(self.entities, self.resolved),
            "routes": lambda: asg.mermaid_routes(self.routes),
            "imports": lambda: asg.mermaid_graph(self.edges),
        }[name]()

    def stories(self, budget: int = 8000) -> str:
        """The stories of the requirements within a budget of characters, what matters first; credentials as marks."""
        lines = context.story_lines(self.requirements)
        return context.budgeted_lines(lines.withColumn("text", secrets.redacted(F.col("text"))), budget)

    def scan(self, *names: str) -> str:
        """Analyses as JSON: one alone as its bare rows, several under their names."""
        known = self.analyses()
        rows = {n: [r.asDict(recursive=True) for r in known[n]().collect()] for n in names or ("framework", "architecture", "features", "todo", "audit", "health")}
        return json.dumps(rows if len(rows) > 1 else next(iter(rows.values())), default=str, sort_keys=True)
