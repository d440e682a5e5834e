"""A repository as a bundle of lazy tables: asking for one plans only what it needs.

files (path, content) is all it takes; a commit log and a diff are optional.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.lineage import cut
from graphmill.operators import classify, entries, graph, history, metrics, report, risk, symbols, syntax, text
from graphmill.sources import readers


class Workspace:
    """files: path, content; commits: cid, path, ts, author, email; diff: diff, line_no, line; memo: where symbols are kept by content."""

    def __init__(self, files: DataFrame, commits: DataFrame | None = None, diff: DataFrame | None = None, as_of: str = "2100-01-01 00:00:00", memo: str | None = None) -> None:
        self.files, self.commits, self.diff, self.as_of, self.memo = files, commits, diff, as_of, memo
        self.spark = files.sparkSession

    @classmethod
    def read(cls, spark: SparkSession, root: str, with_history: bool = False) -> Workspace:
        """The code files below root; with_history also the commit log of the local repository there."""
        found = readers.read_text(readers.scan_files(spark, root))
        files = cut(found.where(readers.is_code_file(F.col("path")) & ~readers.is_excluded(F.col("path"))), "files")
        commits = None
        if with_history:
            lines = readers.git_lines(spark, root, "log", "--pretty=format:COMMIT|%ae|%an|%at", "--name-only", "--diff-filter=AM")
            commits = cut(history.without_bots(readers.parse_author_log(lines)), "commits")
        return cls(files, commits)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.files.select(F.col("path").alias("node")).distinct()

    @cached_property
    def parsed(self) -> syntax.Parsed:
        """Tokens of the JavaScript, TypeScript and Go files."""
        return syntax.parsed(self.files)

    @cached_property
    def declarations(self) -> DataFrame:
        return cut(syntax.declarations(self.parsed), "declarations")

    @cached_property
    def python_imports(self) -> DataFrame:
        return cut(symbols.python_imports(self.files), "python-imports")

    @cached_property
    def imports(self) -> DataFrame:
        """source, target, module, external, ord, type_only: by syntax where a language has one here, else by pattern."""
        columns = ["source", "language", "module", "ord", "type_only"]
        lexed = syntax.import_statements(self.parsed, self.files).select(*columns)
        python = self.python_imports.select("source", F.lit("python").alias("language"), "module", "ord", F.lit(False).alias("type_only")).distinct()
        others = self.files.where(~F.col("path").rlike("|".join([*syntax.ENDINGS.values(), r"\.pyi?$"])))
        every = lexed.unionByName(python).unionByName(text.imports_regex(others).select(*columns))
        return cut(text.resolve_imports(every, self.files), "imports")

    @cached_property
    def specifiers(self) -> DataFrame:
        """file, local, imported, type_only, target_file: names that imports bind; target_file is null outside of the repository."""
        names = syntax.import_specifiers(self.parsed).unionByName(self.python_imports.select("source", "ord", "local", "imported", F.lit(False).alias("type_only")))
        at = self.imports.groupBy("source", "ord").agg(F.min("target").alias("target_file"))
        return names.join(at, ["source", "ord"], "left").select(F.col("source").alias("file"), "local", "imported", "type_only", "target_file")

    @cached_property
    def edges(self) -> DataFrame:
        return self.imports.where("target is not null").select(F.col("source").alias("s"), F.col("target").alias("t"))

    @cached_property
    def counts(self) -> DataFrame:
        lines = metrics.file_text_counts(self.files.withColumnRenamed("path", "key")).select(F.col("key").alias("node"), "lines")
        return metrics.instability(metrics.fan_counts(self.nodes, self.edges)).join(lines, "node")

    @cached_property
    def roles(self) -> DataFrame:
        outside = self.imports.where("external is not null").select("source", F.col("external").alias("target"), F.col("ord").alias("edge_ord"))
        return classify.with_roles(outside, classify.boundary_lookup(self.spark))

    @cached_property
    def classified(self) -> DataFrame:
        """path, category, confidence after all four passes."""
        first = classify.classify_content(classify.classify_path(self.files)).select(F.col("path").alias("key"), "category", "confidence")
        third = cut(classify.classify_boundary(first, self.roles), "classified")
        typed = self.imports.where("target is not null").groupBy(F.col("source").alias("s"), F.col("target").alias("t")).agg(F.bool_and("type_only").alias("type_only"))
        packages = self.imports.where("external is not null").select(F.col("external").alias("package"), F.col("source").alias("key"))
        found = classify.classify_graph(classify.graph_candidates(third.withColumn("path", F.col("key")), typed, packages))
        joined = third.join(found.select("key", F.col("category").alias("found"), F.col("confidence").alias("sure")), "key", "left")
        return cut(joined.select(F.col("key").alias("path"), F.coalesce("found", "category").alias("category"), F.coalesce("sure", "confidence").alias("confidence")), "classified")

    @cached_property
    def layers(self) -> DataFrame:
        return self.classified.select(F.col("path").alias("node"), classify.layer_of(F.col("category")).alias("layer"))

    @cached_property
    def violations(self) -> DataFrame:
        return classify.layer_violations(self.edges, self.layers)

    @cached_property
    def components(self) -> DataFrame:
        return cut(graph.scc(self.nodes, self.edges), "components")

    @cached_property
    def cycles(self) -> DataFrame:
        return graph.cycles(self.components, self.edges)

    @cached_property
    def symbols(self) -> DataFrame:
        if self.memo is not None:
            every = symbols.by_content(self.files, lambda files: symbols.python_symbols(files).unionByName(syntax.declared_symbols(files)), self.memo)[0]
        else:
            every = symbols.python_symbols(self.files).unionByName(syntax.symbols_of(self.declarations))
        entry = self.entry_points.select("file", F.lit(True).alias("is_entry_point")).distinct()
        return cut(every.join(entry, "file", "left").na.fill(False, ["is_entry_point"]), "symbols")

    @cached_property
    def symbol_edges(self) -> DataFrame:
        """source_file, source, target_file, target, edge_type, edge_ord."""
        raw = symbols.python_edges(self.files).withColumn("binding", F.lit("free")).unionByName(syntax.scoped_references(self.parsed, self.declarations))
        found = syntax.resolve(raw, self.symbols, self.specifiers, self.edges.select(F.col("s").alias("file"), F.col("t").alias("target")))
        return cut(found.where("target_file is not null").select(F.col("file").alias("source_file"), "source", "target_file", "target", "edge_type", F.col("line").alias("edge_ord")), "symbol-edges")

    @cached_property
    def keyed_symbol_edges(self) -> DataFrame:
        """source, target as file:name."""
        key = lambda f, n: F.concat_ws(":", f, n)
        return self.symbol_edges.select(key("source_file", "source").alias("source"), key("target_file", "target").alias("target"), "edge_type", "edge_ord")

    @cached_property
    def dead_code(self) -> DataFrame:
        boundary = classify.boundary_roles(self.roles).where(F.col("role").isin("http", "persistence")).select(F.col("source").alias("file"))
        return symbols.dead_code(self.symbols, self.symbol_edges.select(F.col("target").alias("name")), boundary)

    @cached_property
    def coupling(self) -> DataFrame:
        if self.commits is None:
            return self.spark.createDataFrame([], "file_a string, file_b string, support long, confidence double")
        return history.coupling(self.commits.where(readers.is_coupled_source(F.col("path"))))

    @cached_property
    def flows(self) -> DataFrame:
        known = self.classified.withColumn("node", F.col("path"))
        return graph.flows(graph.flow_entries(known), self.components, self.layers, self.edges)[0]

    @cached_property
    def seams(self) -> DataFrame:
        n = self.nodes.count()
        bridges = graph.bridge_edges(self.nodes, self.edges, 50, graph.bridge_blocks(n, n))
        return graph.seams(bridges, self.components, self.coupling, n)

    @cached_property
    def temporal(self) -> DataFrame:
        if self.commits is None:
            return self.spark.createDataFrame([], "path string, commits long, last_changed timestamp, lines long, complexity long, risk long")
        return history.temporal(self.commits, self.counts.select(F.col("node").alias("path"), "lines"), self.as_of)

    def file_blast(self, file: str) -> DataFrame:
        """root, node, hop of the files that import a file, directly or through others."""
        return graph.dependents(self.edges.distinct(), self.nodes.where(F.col("node") == file))

    def origin(self, symbol: str, file: str | None = None) -> DataFrame:
        """node: the first symbol of that name, in that file."""
        asked = self.spark.createDataFrame([(0, symbol, file)], "q int, name string, file string")
        return symbols.lookup(self.symbols, asked).select(F.concat_ws(":", "file", "name").alias("node"))

    def impact(self, symbol: str, file: str | None = None) -> DataFrame:
        """root, node, hop of the callers of a symbol, direct and transitive."""
        return graph.dependents(self.keyed_symbol_edges.select(F.col("source").alias("s"), F.col("target").alias("t")), self.origin(symbol, file))

    def risk(self, diff: DataFrame) -> DataFrame:
        hunks = risk.parse_diff(diff)
        touched = risk.touched_symbols(hunks, self.symbols.withColumn("line_end", F.coalesce("line_end", "line_start"))).select(F.concat_ws(":", "file", "name").alias("target"))
        return risk.diff_risk(touched.join(graph.blast_scores(self.keyed_symbol_edges), "target"), risk.coupling_impact(hunks, self.coupling))

    def check(self, most_violations: int = 132, most_dead: int = 240, most_blast: float = 58.0) -> DataFrame:
        n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        one = n(self.violations, "violations").join(n(self.dead_code, "dead_code")).join(graph.max_blast(self.keyed_symbol_edges))
        return one.join(risk.gate_check("violations", "dead_code", "max_blast", one, most_violations, most_dead, most_blast))

    @cached_property
    def entry_points(self) -> DataFrame:
        return cut(entries.entry_points(self.files), "entry-points")

    def signals(self, top: int = 5) -> DataFrame:
        """id, family, kind, basis, data: what steers a first look, risks where there is a history, and how complete it is."""
        steering = self.classified.select(F.col("path").alias("node"), "category")
        counts = cut(self.counts, "counts")
        reached = graph.dependent_counts(self.nodes, self.components, self.edges)
        count = lambda df: df.agg(F.count(F.lit(1)).alias("count"))
        found = [
            ("hot-files", "architecture", "fact", report.steering(metrics.hot_files(counts), steering).orderBy("rank").limit(top).select(F.col("node").alias("file"), F.col("fan_in").alias("value"))),
            ("instability", "architecture", "derived", metrics.rank_instability(report.steering(counts, steering), top)),
            ("propagation-reach", "architecture", "derived", report.steering(reached.where("dependents > 0"), steering).orderBy(F.desc("dependents"), "node").limit(top)),
            ("layer-violations", "architecture", "fact", count(self.violations)),
            ("circular-dependencies", "architecture", "fact", self.cycles.agg(F.count_distinct("cycle").alias("count"))),
            ("analysis-completeness", "confidence", "fact", report.completeness(self.files, self.nodes, self.edges)),
        ]
        if self.commits is not None:
            by_path = steering.withColumnRenamed("node", "path")
            kept = report.steering(self.commits, by_path, "path")
            fan_in = counts.select(F.col("node").alias("path"), "fan_in")
            found += [
                ("temporal-hotspots", "risk", "fact", history.rank_hotspots(report.steering(self.temporal, by_path, "path"), top).select(F.col("path").alias("file"), F.col("risk").alias("value"))),
                ("ownership-concentration", "risk", "derived", history.rank_ownership(history.ownership(kept), top=top)),
                ("dangerous-hotspots", "risk", "derived", history.rank_dangerous(history.churn(kept), fan_in, self.as_of, top)),
            ]
        return report.summary({id: report.signal(df, id, family, kind) for id, family, kind, df in found})

    def summary_payload(self, top: int = 5) -> dict:
        """A first orientation: language, frameworks, roots by surface, counts, and signals by family. Lists are cut at `top`."""
        runtime, tooling = entries.by_surface(self.entry_points)
        named = lambda df: [r["file"] for r in df.orderBy("rank").limit(top).collect()]
        counts = cut(self.counts, "counts")
        families: dict[str, list] = {"architecture": [], "risk": [], "confidence": []}
        for r in self.signals(top).collect():
            families[r["family"]].append({"id": r["id"], "kind": r["kind"], "basis": r["basis"], "data": json.loads(r["data"])})
        return {
            "language": classify.primary_language(self.files).first()["language"],
            "frameworks": [r.asDict() for r in entries.frameworks(self.files).limit(top).collect()],
            "runtime_roots": named(runtime),
            "launch_surfaces": named(tooling),
            "files": self.nodes.count(),
            "orphans": metrics.orphans(counts).count(),
            "hot_files_coverage": metrics.hot_files_coverage(metrics.hot_files(counts), counts).first()["coverage"],
            **families,
        }

    def publish(self, tiers: Iterable[int] = (0, 1, 2, 4, 6)) -> Iterator[tuple[int, dict[str, DataFrame]]]:
        """(tier, tables) in turn, each with the tables that the tiers before it don't have: a reader sees the first while the next isn't planned."""
        seen: set[str] = set()
        for tier in tiers:
            new = {name: df for name, df in self.bundle(tier).items() if name not in seen}
            seen |= new.keys()
            yield tier, new

    def bundle(self, tier: int = 2) -> dict[str, DataFrame]:
        """Tables of a tier and those below: 0 files, 1 the file graph, 2 symbols, flows and coupling, 4 schemas, 6 history."""
        out = {"frameworks": entries.frameworks(self.files), "language": classify.primary_language(self.files)}
        if tier >= 1:
            out |= {
                "entry_points": self.entry_points, "categories": classify.classification_summary(self.classified), "hot_files": metrics.hot_files(self.counts),
                "unstable": metrics.rank_instability(self.counts), "cycles": self.cycles, "layer_violations": self.violations,
                "completeness": report.completeness(self.files, self.nodes, self.edges),
            }
        if tier >= 2:
            out |= {"dead_code": self.dead_code, "flows": self.flows, "coupling": self.coupling.orderBy(F.desc("support"), "file_a", "file_b")}
        if tier >= 4:
            out["entities"] = text.prisma_entities(self.files)
        if tier >= 6:
            out["hotspots"] = history.rank_hotspots(self.temporal)
        return out
