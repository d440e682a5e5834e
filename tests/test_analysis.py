"""Classification, history, risk, symbols, syntax, text, tours, reports and sources on literal inputs."""

import subprocess

from pyspark.sql import functions as F

from graphmill.functions.columns import fold_dots, half_up, package_name
from graphmill.operators import classify, entries, history, metrics, report, risk, symbols, syntax, text, tours
from graphmill.sources import readers
from tests.conftest import rows


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_path_rules(spark):
    expected = {
        "src/a.e2e.ts": "e2e", "tests/x.ts": "test", "src/x.spec.ts": "test", "pkg/test_x.py": "test", "examples/a.ts": "example", "__fixtures__/a.ts": "fixture", "tsconfig.json": "config",
        "src\\routes\\users.ts": "route", "src/middleware/auth.ts": "middleware", "src/useThing.ts": "utility", "src/store/index.ts": "service", "src/index.ts": "entry", "bin/run.ts": "entry",
        "src/components/A.tsx": "component", "lib.rs": "unknown", "fastapi/routing.py": "libSource", "src/types/a.ts": "type", "src/a.repository.ts": "model", "src/x.css": "style",
        "constants/routes.ts": "type", "src/models/user.ts": "model", "a/context/b.tsx": "component",
    }
    got = classify.classify_path(frame(spark, [(p,) for p in expected], "path string"))
    assert {r.path: r.category for r in got.collect()} == expected


def test_content_and_boundary_rules(spark):
    files = frame(
        spark,
        [("a", "app = FastAPI()", "unknown"), ("b", "@router.get('/x')", "unknown"), ("c", "from pydantic import BaseModel\nclass A(BaseModel): pass", "unknown"), ("d", "@Entity()", "service"), ("e", None, "unknown"), ("f", "x\nfunc main() {", "unknown")],
        "key string, content string, category string",
    ).withColumn("confidence", F.lit("low"))
    known = classify.classify_content(files)
    assert {r.key: r.category for r in known.collect()} == {"a": "entry", "b": "route", "c": "type", "d": "service", "e": "unknown", "f": "entry"}
    imports = frame(spark, [("e", "node_modules/zod/lib", 0), ("e", "pg", 1), ("e", "pg", 2), ("x", "zod", 0), ("x", "pg", 1)], "source string, target string, edge_ord int")
    roles = classify.with_roles(imports, classify.boundary_lookup(spark))
    assert rows(classify.boundary_roles(roles)) == [("e", "persistence", 2), ("x", "persistence", 1), ("x", "validation", 1)]
    more = classify.classify_boundary(known.select("key", "category", "confidence").unionByName(frame(spark, [("x", "unknown", "low")], "key string, category string, confidence string")), roles)
    assert {r.key: r.category for r in more.collect() if r.key in "ex"} == {"e": "service", "x": "model"}


def test_layers_and_cycles_in_one_layer(spark):
    layers = frame(spark, [(1, 3), (2, 3), (3, 1), (4, 0), (5, -1), (6, -2), (7, 5)], "node long, layer int")
    e = frame(spark, [(1, 2), (2, 1), (1, 3), (3, 1), (1, 4), (5, 3), (6, 7), (1, 6), (3, 7)], "s long, t long")
    assert [(r.s, r.t, r.direction) for r in classify.layer_violations(e, layers).orderBy("s", "t").collect()] == [(1, 3, "backward"), (1, 6, "backward"), (3, 1, "skip-layer"), (3, 7, "skip-layer")]


def test_entry_points_and_frameworks(spark):
    package = '{"main": "lib/run.js", "bin": {"x": "bin/x.js", "y": "gone.js"}, "scripts": {"start": "node server.js"}, "dependencies": {"next": "^14.1", "react": "~18"}, "devDependencies": {"vitest": "1"}}'
    files = frame(
        spark,
        [("package.json", package), ("lib/run.js", ""), ("bin/x.js", ""), ("server.js", ""), ("app/page.tsx", ""), ("src/main.py", ""), ("pkg/cli.py", ""), ("a.py", "if __name__ == '__main__':"), ("b.test.ts", "x.listen(PORT)"), ("c.ts", "x.listen(3000)"),
         ("pyproject.toml", '[project.scripts]\ncli = "pkg.cli:main"\n'), ("requirements.txt", "fastapi>=0.100\nSQLAlchemy")],
        "path string, content string",
    )
    got = {r.file: (r.type, r.confidence, r.surface) for r in entries.entry_points(files).collect()}
    assert got == {
        "lib/run.js": ("main", "high", "runtime"), "bin/x.js": ("cli", "high", "tooling"), "server.js": ("main", "high", "runtime"), "app/page.tsx": ("route", "high", "runtime"),
        "src/main.py": ("main", "medium", "runtime"), "pkg/cli.py": ("cli", "high", "runtime"), "a.py": ("main", "medium", "runtime"), "c.ts": ("main", "medium", "runtime"),
    }
    assert {(r.name, r.version) for r in entries.frameworks(files).collect()} == {("Next.js (App Router)", "14.1"), ("React", "18"), ("FastAPI", "0.100"), ("Node.js", None), ("SQLAlchemy", None), ("Vitest", None)}


def test_coupling_drops_ubiquitous_files(spark):
    log = [(c, "everywhere", c) for c in range(90)] + [(c, p, c) for c in range(0, 100, 10) for p in ("a", "b")] + [(95, "c", 95)]
    commits = frame(spark, log, "cid long, path string, ts long")
    got = rows(history.coupling(commits))
    assert got == [("a", "b", 10, 1.0)]
    assert history.coupling(commits, newest=5).count() == 0


def test_temporal_of_three_commits(spark):
    commits = frame(spark, [(i, "a.ts", f"2024-01-{10 + i:02d} 00:00:00", "Ann", "ann@x" if i < 3 else "dependabot@x") for i in range(4)], "cid long, path string, ts string, author string, email string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    kept = history.without_bots(commits)
    got = history.temporal(kept, frame(spark, [("a.ts", 100)], "path string, lines long"), "2024-02-01 00:00:00").first()
    assert (got.commits, got.complexity, got.risk) == (3, 3, 5)
    assert rows(history.ownership(kept).select("email", "percentage", "rank")) == [("ann@x", 100, 1)]


def test_git_log_markers_and_blank_lines(spark):
    raw = "abc\nsrc/a.ts\nsrc/b.ts\nMakefile\nsrc/c.ts\n\nsrc/lost.ts\ndef\nnode_modules/x.js\nREADME.md\nsrc/d.py"
    lines = frame(spark, [("r", i, x) for i, x in enumerate(raw.split("\n"))], "log string, line_no long, line string")
    got = {}
    for r in readers.parse_git_log(lines).collect():
        got.setdefault(r.cid, set()).add(r.path)
    assert sorted(map(sorted, got.values())) == [["src/a.ts", "src/b.ts"], ["src/c.ts"], ["src/d.py"]]
    author = frame(spark, [("r", i, x) for i, x in enumerate(["COMMIT|a@x|Ann|86400", "src/a.ts", "", "COMMIT|b@x|Bob|0", "src/b.ts"])], "log string, line_no long, line string")
    assert [(r.email, r.author, r.path) for r in readers.parse_author_log(author).orderBy("cid").collect()] == [("a@x", "Ann", "src/a.ts"), ("b@x", "Bob", "src/b.ts")]


def test_diff_hunks_and_risk(spark):
    diff = "diff --git a/x.ts b/src/x.ts\n--- a/x.ts\n+++ b/src/x.ts\n@@ -1,2 +10,3 @@ f\n+a\n@@ -5 +20 @@\n@@ -9,4 +30,0 @@\ndiff --git a/y b/y\n@@ -1 +1,2 @@"
    hunks = risk.parse_diff(frame(spark, [("d", i, x) for i, x in enumerate(diff.split("\n"))], "diff string, line_no long, line string"))
    assert rows(hunks.select("file", "start_line", "end_line")) == [("src/x.ts", 10, 12), ("src/x.ts", 20, 20), ("y", 1, 2)]
    known = frame(spark, [("src/x.ts", "f", 12, 15), ("src/x.ts", "g", 13, 19), ("y", "h", 0, 1)], "file string, name string, line_start int, line_end int")
    assert rows(risk.touched_symbols(hunks, known)) == [("src/x.ts", "f"), ("y", "h")]
    pairs = frame(spark, [("src/x.ts", "z", 3, 1.0), ("a", "y", 2, 0.95), ("src/x.ts", "y", 2, 1.0)], "file_a string, file_b string, support long, confidence double")
    impact = risk.coupling_impact(hunks, pairs)
    assert {r.confidence for r in impact.collect()} == {1.0, 0.95}
    out = risk.diff_risk(frame(spark, [(3.0,)], "score double"), impact).first()
    assert (out.score, out.level) == (54, "medium")


def test_diagnostics_confirm_dead_code(spark):
    log = frame(spark, [("src/a.ts:3:7 - error TS6133: 'x' is declared but never read.",), ("noise",), ("src/b.ts:1:1 - warning TS2304: no",)], "line string")
    found = risk.parse_diagnostics(log)
    assert [(r.file, r.line, r.code) for r in found.orderBy("file").collect()] == [("src/a.ts", 3, "6133"), ("src/b.ts", 1, "2304")]
    every = frame(
        spark,
        [("x", "src/a.ts", "function", 3, False, None), ("y", "src/a.ts", "function", 9, False, None), ("called", "src/a.ts", "function", 1, False, None), ("shown", "src/a.ts", "function", 1, True, None), ("T", "src/a.ts", "interface", 1, False, None),
         ("m", "src/a.ts", "method", 1, False, "C"), ("t", "test/a.ts", "function", 1, False, None), ("db", "src/db.ts", "function", 1, False, None)],
        "name string, file string, kind string, line_start int, is_exported boolean, parent string",
    ).withColumn("is_entry_point", F.lit(False))
    dead = symbols.dead_code(every, frame(spark, [("called",)], "name string"), frame(spark, [("src/db.ts",)], "file string"))
    fused = symbols.fuse_diagnostics(dead, found)
    assert {r.name: r.confidence for r in fused.collect()} == {"x": 0.95, "y": 1.0}


def test_symbols_and_their_resolution(spark):
    source = "LIMIT = 3\nclass A(Base):\n    def m(self):\n        helper()\n\ndef helper():\n    pass\n"
    files = frame(spark, [("a.py", source), ("b.py", "def helper(:"), ("c.ts", "export class Foo {\nfunction bar() {}\nexport const X = 1"), ("d.go", "func (r *T) Run() {\ntype T struct {")], "path string, content string")
    assert {(r.name, r.kind, r.line_start, r.parent) for r in symbols.python_symbols(files).collect()} == {("LIMIT", "constant", 1, None), ("A", "class", 2, None), ("m", "method", 3, "A"), ("helper", "function", 6, None)}
    assert {(r.source, r.target, r.edge_type) for r in symbols.python_edges(files).collect()} == {("A", "Base", "extends"), ("m", "helper", "calls")}
    assert {(r.name, r.kind, r.is_exported) for r in syntax.declared_symbols(files).collect()} == {("Foo", "class", True), ("bar", "function", False), ("X", "constant", True), ("Run", "method", True), ("T", "class", True)}
    refs = frame(spark, [(1, "a", "f"), (2, "a", "g"), (3, "a", "none")], "ref int, file string, name string")
    known = frame(spark, [("f", "b"), ("f", "c"), ("g", "a"), ("g", "z")], "name string, file string")
    got = symbols.resolve(refs, known, frame(spark, [("a", "c")], "file string, target string"))
    assert {r.ref: r.target_file for r in got.collect()} == {1: "c", 2: "z", 3: None}


def test_imports_are_resolved_in_order(spark):
    files = frame(
        spark,
        [("src/a.ts", "import x from './b'\nimport { y } from '@/util'\nconst z = require('lodash/fp')\nimport '@org/pkg'"), ("src/b.tsx", ""), ("src/util/index.ts", ""), ("p/m.py", "from p.n import x\nimport os"), ("p/n.py", ""), ("g.go", 'import (\n "fmt"\n "my/mod/x"\n)')],
        "path string, content string",
    )
    got = text.resolve_imports(text.imports_regex(files), files, go_module="my/mod")
    assert {(r.module, r.target, r.external) for r in got.collect()} == {
        ("./b", "src/b.tsx", None), ("@/util", "src/util/index.ts", None), ("lodash/fp", None, "lodash"), ("@org/pkg", None, "@org/pkg"), ("p.n", "p/n.py", None), ("os", None, None),
        ("fmt", None, "stdlib:fmt"), ("my/mod/x", "x", None),
    }


def test_retrieval(spark):
    docs = frame(spark, [("a", "red fox jumps"), ("b", "red hen"), ("c", "blue fox fox")], "id string, content string")
    index = text.inverted_index(docs)
    ask = frame(spark, [(1, "Fox red"), (2, "none")], "q int, content string")
    assert rows(text.search_text(index, ask)) == [(1, "a")]
    lists = frame(spark, [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "b")], "q int, list int, rank int, id string")
    assert [r.id for r in text.rrf(lists).orderBy(F.desc("fused")).collect()] == ["b", "a"]
    ranked = frame(spark, [(1, "a", 1, 5), (1, "b", 2, 9), (1, "c", 3, 1)], "q int, id string, rank int, size int")
    assert rows(text.budget_pack(ranked, 10).select("id")) == [("a",)]
    old = frame(spark, [("k", "old")], "key string, value string")
    assert rows(text.upsert(old, frame(spark, [("k", "new")], "key string, value string"), ["key"])) == [("k", "new")]
    writes = frame(spark, [("k", "b", 2), ("k", "c", 3), ("k", "a", 1)], "key string, value string, ord int").repartition(3)
    assert rows(text.upsert(old, writes, ["key"], "ord")) == [("k", "c")]
    assert rows(text.insert_ignore(old.limit(0), writes, ["key"], "ord")) == [("k", "a")]
    chunk = text.chunks(frame(spark, [("f", "1\n2\n3"), ("g", "x")], "path string, content string"), frame(spark, [("f", "s", 2, 9)], "file string, name string, line_start int, line_end int"))
    assert {(r.chunk_id, r.content) for r in chunk.collect()} == {("f::s::2", "2\n3"), ("g::__file__", "x")}


def test_text_shapes(spark):
    code = "import a\n\n\nfunction f() {\n  x\n}\nclass B {"
    got = frame(spark, [(code,), ("plain\n\n\n\nwords  ",)], "c string").select(text.skeletonize(F.col("c")), text.compact_text(F.col("c"))).collect()
    assert [r[0] for r in got] == ["import a\nfunction f()\nclass B", "plain\n\nwords"]
    assert got[0][1] == "import a\n\nfunction f() {\n  x\n}\nclass B {"
    schema = "model User {\n id Int @id\n name String?\n posts Post[]\n // no\n}\nmodel Post {\n author User\n}"
    found = text.prisma_entities(frame(spark, [("s.prisma", schema), ("s.txt", schema)], "path string, content string"))
    assert {(r.entity, r.field, r.relation, r.is_primary, r.is_nullable) for r in found.collect()} == {
        ("User", "id", None, True, False), ("User", "name", None, False, True), ("User", "posts", "one-to-many", False, False), ("Post", "author", "many-to-one", False, False)
    }


def test_hot_names_make_no_pairs(spark):
    many = 3000
    files = spark.range(many).select(F.format_string("d%d/x.ts", F.col("id") % 40).alias("file"), F.col("id").cast("int").alias("line_start"), F.lit("run").alias("name"))
    asked = spark.range(many).select(F.col("id").alias("q"), F.lit("run").alias("name"), F.when(F.col("id") % 3 == 0, "x.ts").when(F.col("id") % 3 == 1, F.format_string("d%d/x.ts", F.col("id") % 40)).alias("file"))
    found = symbols.lookup(files, asked).collect()
    assert {r.q: r.file for r in found} == {q: f"d{q % 40}/x.ts" if q % 3 == 1 else "d0/x.ts" for q in range(many)}
    assert _most_rows(spark, lambda: symbols.lookup(files, asked)) <= 4 * many
    known = spark.range(many).select(F.lit("run").alias("name"), F.format_string("f%05d", "id").alias("file"))
    refs = known.select(F.col("file").alias("ref"), "file", "name")
    imports = frame(spark, [("f00002", "f00001")], "file string, target string")
    got = {r.ref: r.target_file for r in symbols.resolve(refs, known, imports).collect()}
    assert got == {f"f{i:05d}": "f00001" if i in (0, 2) else "f00000" for i in range(many)}
    assert _most_rows(spark, lambda: symbols.resolve(refs, known, imports)) <= 4 * many


def _most_rows(spark, make):
    """The most rows that any operator of the executed plan puts out."""
    df = make()
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind.startswith("AdaptiveSparkPlan"):
            todo.append(plan.executedPlan())
        elif "QueryStage" in kind:
            todo.append(plan.plan())
        metric = plan.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_an_index_is_scored_where_it_is(spark):
    docs = frame(spark, [(1, "a b a"), (2, "b c"), (3, None), (4, "c c d")], "id long, content string")
    asked = frame(spark, [(10, "a b"), (11, "c"), (12, "zzz")], "q int, content string")
    index = text.inverted_index(docs)
    found, scored = text.search_text(index, asked), text.bm25(index, asked, frame(spark, [(4, 2.0)], "n long, avg_length double"))
    assert rows(found) == [(10, 1), (11, 2), (11, 4)]
    assert rows(scored.select("q", "id")) == [(10, 1), (10, 2), (11, 2), (11, 4)]
    for df in (found, scored):
        assert "hashpartitioning(q" not in df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(history, "PAIRS_OF_TASK", 50)
    log = spark.range(400).select((F.col("id") % 20).alias("cid"), (F.col("id") / 20).cast("int").alias("path"))
    found = history.support(log.unionByName(log))
    # 20 commits of 20 files: 3,800 pairs, 190 different ones
    assert found.rdd.getNumPartitions() >= 3800 // 50
    assert rows(found.groupBy("support").count()) == [(20, 190)]


def test_endings_are_tried_in_order_without_a_row_each(spark):
    files = frame(spark, [("src/b.ts",), ("src/b.js",), ("src/b/index.ts",), ("src/c/index.js",), ("src/d.vue",), ("src/d",)], "path string")
    tried = [("./b", "src/b.ts"), ("./b.js", "src/b.js"), ("./b/index", "src/b/index.ts"), ("./c", "src/c/index.js"), ("./d", "src/d"), ("./none", None), ("@/b", "src/b.ts")]
    imports = frame(spark, [("src/a.ts", "javascript", m, i, False) for i, (m, _) in enumerate(tried * 40)], "source string, language string, module string, ord int, type_only boolean")
    make = lambda: text.resolve_imports(imports, files)
    assert {(r.module, r.target) for r in make().collect()} == set(tried)
    assert _most_rows(spark, make) <= 4 * len(tried) * 40


def test_words_end_at_letters_beyond_ascii(spark):
    asked = [("die testö u", True), ("ñqueue ar", True), ("the tests", False), ("a_test", False), ("Queue?", True), ("api2", False), (None, None)]
    got = frame(spark, [(q,) for q, _ in asked], "q string").select("q", tours.is_relevant(F.col("q")).alias("r"))
    assert {r.q: r.r for r in got.collect()} == dict(asked)
    counts = metrics.file_text_counts(frame(spark, [(1, "éimport a\nexportñ b\nimports")], "key int, content string"))
    assert rows(counts.select("imports", "exports")) == [(1, 1)]


def test_tours(spark):
    ask = lambda q: frame(spark, [(q,)], "q string").select(tours.classify_query(F.col("q"))).first()[0]
    assert [ask("show the architecture structure"), ask("trace the request lifecycle"), ask("hi"), ask("which api endpoints are external"), ask("tell me about the weather today")] == ["overview", "data-flow", "overview", "api-surface", "custom"]
    steps = frame(
        spark,
        [("t", 1, "A", "x" * 40, "y" * 20, ["a", "b"]), ("t", 2, "B", "x" * 50, "y" * 20, ["a", "b"]), ("t", 3, "C", "x" * 35, "y" * 20, ["c"]), ("u", 1, "D", "short", "y" * 20, [])],
        "tour string, ord int, title string, what string, why string, files array<string>",
    )
    assert rows(tours.dedupe_steps(steps).select("tour", "ord")) == [("t", 2), ("t", 3), ("u", 1)]
    # what a step that is itself taken up would cover stays
    letters = "abcdefghijk"
    chain = [("v", 1, "A", "x" * 40, "y" * 20, list(letters[:9])), ("v", 2, "B", "x" * 30, "y" * 20, list(letters[:10])), ("v", 3, "C", "x" * 20, "y" * 20, list(letters[1:10]))]
    assert rows(tours.dedupe_steps(frame(spark, chain, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in steps.schema))).select("ord")) == [(1,), (3,)]
    checked = {r.tour: (sorted(r.errors), r.valid) for r in tours.validate_tours(steps, frame(spark, [("a",), ("b",)], "file string")).collect()}
    assert checked == {"t": (["unknown files"], False), "u": (["explanation too short", "too few steps"], False)}
    made = tours.fallback_tour(frame(spark, [("e", 1)], "file string, rank int"), frame(spark, [("h", 1), ("e", 2), ("i", 3), ("j", 4)], "file string, rank int"))
    assert [(r.step, r.file) for r in made.orderBy("step").collect()] == [(1, "e"), (2, "h"), (3, "i")]


def test_paths_and_numbers(spark):
    got = frame(spark, [("a/./b/../c",), ("../x/..",)], "p string").select(fold_dots(F.col("p"))).collect()
    assert [r[0] for r in got] == ["a/c", ".."]
    names = frame(spark, [("node_modules/@a/b/c",), ("x/y",)], "p string").select(package_name(F.col("p"))).collect()
    assert [r[0] for r in names] == ["@a/b", "x"]
    assert frame(spark, [(0.0005,)], "x double").select(half_up(F.col("x"), 3)).first()[0] == 0.001
    assert rows(readers.file_tree(frame(spark, [("a/b",), ("a/c",)], "path string"))) == [("a", "", 1, False), ("a/b", "a", 2, True), ("a/c", "a", 2, True)]
    scores = frame(spark, [("package.json",), ("src/tests/a.ts",), ("packages/x/src/a.ts",), ("z.ts",)], "path string").select(readers.path_priority(F.col("path"))).collect()
    assert [r[0] for r in scores] == [-100, 100, 70, 100]


def test_sources_and_sinks(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "src").mkdir(parents=True)
    (repo / "node_modules" / "x").mkdir(parents=True)
    (repo / "src" / "a.ts").write_text("export const a = 1\n")
    (repo / "src" / "b.bin").write_bytes(b"a\0b")
    (repo / "node_modules" / "x" / "i.js").write_text("no")
    files = readers.scan_files(spark, str(repo))
    assert rows(readers.read_text(files)) == [("src/a.ts", "export const a = 1\n")]
    for step in (["init", "-q"], ["add", "src/a.ts"], ["-c", "user.email=a@x", "-c", "user.name=A", "commit", "-qm", "one"]):
        subprocess.run(["git", "-C", str(repo), *step], check=True)
    (repo / "src" / "c.ts").write_text("x\n")
    for step in (["add", "src/c.ts"], ["-c", "user.email=a@x", "-c", "user.name=A", "commit", "-qm", "two"]):
        subprocess.run(["git", "-C", str(repo), *step], check=True)
    assert [(r.cid, r.path) for r in readers.scan_git_log(spark, str(repo)).orderBy("cid").collect()] == [(1, "src/c.ts"), (3, "src/a.ts")]
    (repo / "src" / "c.ts").write_text("x\ny\n")
    assert [(r.file, r.start_line, r.end_line) for r in risk.parse_diff(readers.scan_git_diff(spark, str(repo))).collect()] == [("src/c.ts", 2, 2)]
    table = frame(spark, [(1, "x")], "a int, b string")
    readers.sink_cache(table, str(tmp_path / "cache"), "k1")
    assert rows(readers.scan_cache(spark, str(tmp_path / "cache"), "k1")) == [(1, "x")]
    assert readers.scan_cache(spark, str(tmp_path / "cache"), "k2") is None
    readers.sink_jsonl(table, str(tmp_path / "lines"))
    readers.sink_jsonl(table, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2


def test_reports(spark):
    bundle = {"hot": frame(spark, [("a.ts", 3), ("b.ts", 1)], "file string, fan_in int"), "none": frame(spark, [], "x int")}
    assert report.render_toon(bundle) == "hot[2]{file,fan_in}:\n  a.ts,3\n  b.ts,1\nnone[0]{x}:\n"
    assert "| a.ts | 3 |" in report.render_markdown(bundle)
    assert '"fan_in": 3' in report.render_json(bundle)
    assert report.render_markdown(bundle, most_chars=10) == ""
    signals = report.summary({"hot": report.signal(bundle["hot"], "hot-files", "architecture", "fact")})
    assert signals.count() == 2
    text_of = frame(spark, [("/w/me/src/a and /w/me",)], "t string").select(report.sanitize_paths(F.col("t"), "/w/me/")).first()[0]
    assert text_of == "src/a and "


def test_hot_files_keep_the_crossing_row(spark):
    counted = frame(spark, [(i, n, 0, 1) for i, n in enumerate([50, 20, 5, 5, 5, 5, 5, 5])], "node long, fan_in long, fan_out long, lines long")
    assert sorted(r.node for r in metrics.hot_files(counted).collect()) == [0, 1, 2, 3, 4]
    assert metrics.hot_files(counted, at_least=1).count() == 4


def test_the_symbols_that_are_shown_and_their_edges(spark):
    every = frame(
        spark,
        [("a.ts", "run", "A", False, False), ("a.ts", "A", None, False, True), ("b.ts", "main", None, True, False), ("b.ts", "low", None, False, False), ("b.ts", "run", "B", False, False), ("b.ts", "run", "Z", False, False)],
        "file string, name string, parent string, is_entry_point boolean, is_exported boolean",
    )
    edges = frame(spark, [("b.ts", "main", "a.ts", "run", "calls"), ("a.ts", "A", "b.ts", "run", "uses_type"), ("b.ts", "main", "b.ts", "run", "odd"), ("b.ts", "low", "a.ts", "run", "calls"), ("x.ts", "none", "a.ts", "A", "calls")], "source_file string, source string, target_file string, target string, edge_type string")
    nodes, links = report.selected_symbol_graph(every, edges, frame(spark, [("a.ts", "service")], "path string, category string"), 4)
    assert {tuple(r) for r in nodes.collect()} == {("b.ts#main", "main", "unknown", 0), ("a.ts#A", "A", "service", 0), ("a.ts#A.run", "A.run", "service", 2), ("b.ts#B.run", "B.run", "unknown", 2)}
    assert sorted(tuple(r) for r in links.collect()) == [("a.ts#A", "b.ts#B.run", "uses"), ("b.ts#main", "a.ts#A.run", "calls"), ("b.ts#main", "b.ts#B.run", "uses")]


def test_a_listing_keeps_its_order_without_repeats(spark):
    listing = frame(spark, [("b", 1), ("a", 2), ("b", 3), (None, 4), ("a", 5)], "path string, ord int")
    assert [r.path for r in readers.dedupe_paths(listing, "ord").orderBy("ord").collect()] == ["b", "a", None]


def test_rows_of_a_log_are_dealt_by_their_number(spark, monkeypatch):
    log = spark.createDataFrame([(c, f"f{c * k % 11}", f"2024-01-{1 + c % 28:02d}", f"n{c % 5}", f"e{c % 5}") for c in range(60) for k in range(1, 4)], "cid long, path string, ts string, author string, email string").distinct()
    monkeypatch.setattr(history, "ROWS_OF_TASK", 8)
    parts = history.tasks(log)
    assert parts > 10
    for f in (history.ownership, history.churn, history.file_frequency):
        assert sorted(map(tuple, f(log, parts).collect())) == sorted(map(tuple, f(log).collect()))
    plan = history.ownership(log, parts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {parts})") == 2
