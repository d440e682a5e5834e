"""Registered queries of the operators that read text: sources, logs, diffs, manifests.

Their inputs are texts put together from the driver's tables; the oracles take the
expected rows from the tables' columns, without any parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.operators import classify, entries, graph, metrics, report, risk, scan, symbols, syntax, text, tours
from graphmill.plans import relations as rel
from graphmill.plans.registry import BM25_SQL, CLASSIFIED_SQL, COUNTED, EDGES, INDEX_SQL, SCC_SQL, SEEDS_SQL, SELECTED_SQL, chunked, classified, counts, query, scored, selected, with_tables
from graphmill.sources import readers

# ---- TypeScript: a file of imports and one function that calls what they name


def modules(spark: SparkSession, d: str) -> DataFrame:
    """s, path, t, target, module, type_only: what files import, by alias."""
    files = rel.files(spark, d)
    e = rel.edges(spark, d).join(files.select(F.col("node").alias("s"), "path"), "s").join(files.select(F.col("node").alias("t"), F.col("path").alias("target")), "t")
    return e.withColumn("module", F.concat(F.lit("@/"), F.regexp_replace("target", r"^src/|\.ts$", ""))).withColumn("type_only", (F.col("s") + F.col("t")) % 3 == 0)


def sources(spark: SparkSession, d: str) -> DataFrame:
    """path, content."""
    word = F.when(F.col("type_only"), "import type").otherwise("import")
    line = F.format_string("%s { f%d } from '%s';", word, "t", "module")
    listed = modules(spark, d).groupBy(F.col("s").alias("node")).agg(F.sort_array(F.collect_list(line)).alias("imports"), F.transform(F.sort_array(F.collect_list("t")), lambda t: F.format_string("  f%d();", t)).alias("calls"))
    none = F.array().cast("array<string>")
    own = rel.files(spark, d).join(listed, "node", "left")
    head = F.array(F.format_string("import lib from 'lib%d/sub';", F.col("node") % 7))
    body = F.concat(head, F.coalesce("imports", none), F.array(F.format_string("export function f%d() {", "node")), F.coalesce("calls", none), F.array(F.lit("}")))
    return own.select("path", F.array_join(body, "\n").alias("content"))


MODULES_SQL = """modules AS (SELECT e.s, a.path, e.t, b.path AS target, '@/' || regexp_replace(regexp_replace(b.path, '^src/', ''), '\\.ts$', '') AS module, (e.s + e.t) % 3 = 0 AS type_only
  FROM edges e JOIN files a ON a.node = e.s JOIN files b ON b.node = e.t)"""
MODULES = with_tables(rel.FILES_SQL, EDGES, MODULES_SQL)


@query("imports_regex", MODULES + "SELECT path AS source, module, type_only FROM modules UNION ALL SELECT path, 'lib' || (node % 7) || '/sub', false FROM files")
def _(spark, d):
    return text.imports_regex(sources(spark, d)).select("source", "module", "type_only")


def resolved(spark: SparkSession, d: str) -> DataFrame:
    own = graph.cut(sources(spark, d))
    return text.resolve_imports(text.imports_regex(own), own)


@query("resolve_imports", MODULES + "SELECT path AS source, target, NULL::VARCHAR AS external FROM modules UNION ALL SELECT path, NULL, 'lib' || (node % 7) FROM files")
def _(spark, d):
    return resolved(spark, d).select("source", "target", "external")


def references(files: DataFrame) -> DataFrame:
    own = syntax.parsed(files)
    return syntax.scoped_references(own, graph.cut(syntax.declarations(own)))


DECLARED_SQL = "outs AS (SELECT f.node, f.path, (SELECT count(*) FROM edges WHERE s = f.node) AS n FROM files f)"


@query(
    "symbols_declared",
    with_tables(rel.FILES_SQL, EDGES, DECLARED_SQL) + "SELECT path AS file, 'f' || node AS name, 'function' AS kind, CAST(n + 2 AS INTEGER) AS line_start, CAST(2 * n + 3 AS INTEGER) AS line_end, true AS is_exported FROM outs",
)
def _(spark, d):
    return syntax.declared_symbols(sources(spark, d)).drop("parent")


@query(
    "symbol_edges_declared",
    with_tables(rel.FILES_SQL, EDGES, DECLARED_SQL)
    + "SELECT path AS file, 'f' || s AS source, 'f' || t AS target, 'calls' AS edge_type, CAST(n + 2 + row_number() OVER (PARTITION BY s ORDER BY t) AS INTEGER) AS line FROM edges JOIN outs ON node = s",
)
def _(spark, d):
    return references(sources(spark, d)).drop("binding")


@query("resolve_symbols", MODULES + "SELECT path AS file, 'f' || t AS name, target AS target_file FROM modules")
def _(spark, d):
    own = graph.cut(sources(spark, d))
    tokens = syntax.parsed(own)
    declared = graph.cut(syntax.declarations(tokens))
    raw = syntax.scoped_references(tokens, declared)
    refs = raw.select(F.xxhash64("file", "target").alias("ref"), "file", F.col("target").alias("name"))
    reachable = text.resolve_imports(text.imports_regex(own), own).where("target is not null").select(F.col("source").alias("file"), "target")
    return symbols.resolve(refs, syntax.symbols_of(declared).select("name", "file"), reachable).select("file", "name", "target_file")


# ---- the same relations under comments, strings, templates, nesting and shadowed names


def tangled(spark: SparkSession, d: str) -> DataFrame:
    """path, content: a class whose method calls what the file imports under other names, among much that only looks like it."""
    head = F.array(F.format_string("/* import { f%d } from 'nope';\n   f%d() */ // import x from \"no\"", "node", "node"), F.format_string("import lib, * as all from 'lib%d/sub';", F.col("node") % 7))
    word = F.when(F.col("type_only"), "import type").otherwise("import")
    stmt = F.format_string("%s {\n  f%d as g%d, // f0()\n  type T%d,\n} from '%s'", word, "t", "t", "t", "module")
    call = F.format_string("    g%d(`f%d() ${all.deep(\"lib()\")} import('no')`, /f0()/.x);", "t", "t")
    listed = modules(spark, d).groupBy(F.col("s").alias("node")).agg(F.array_sort(F.collect_list(F.struct("t", stmt.alias("stmt"), call.alias("call")))).alias("e"))
    part = lambda name: F.coalesce(F.transform("e", lambda x: x[name]), F.array().cast("array<string>"))
    begin = F.array(F.lit("const note = \"import { f1 } from 'quoted'; f1()\";"), F.format_string("export class C%d extends Base<{ a: number }> {", "node"), F.lit("  async run(q: () => void, lib): Promise<{ ok: boolean }> {"), F.lit("    lib(); q()"))
    end = F.array(F.lit("    function inner() { return 1 }"), F.lit("    return inner()"), F.lit("  }"), F.lit("}"), F.format_string("export const f%d = async (g) => {\n  g(); }", "node"), F.format_string("const lazy = () => import('./lazy%d');", "node"))
    own = rel.files(spark, d).join(listed, "node", "left")
    return own.select("path", F.array_join(F.concat(head, part("stmt"), begin, part("call"), end), "\n").alias("content"))


#: Where an import and a call stand: four lines an import after three, four lines, then a line a call.
TANGLED_SQL = """placed AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY s) AS m FROM modules),
sized AS (SELECT f.node, f.path, (SELECT count(*) FROM modules WHERE s = f.node) AS m FROM files f)"""
TANGLED = with_tables(rel.FILES_SQL, EDGES, MODULES_SQL, TANGLED_SQL)


@query(
    "imports_ast",
    TANGLED
    + """SELECT path AS source, module, CAST(4 + 4 * i AS INTEGER) AS line, false AS is_dynamic, type_only, (CASE WHEN type_only THEN 'import type' ELSE 'import' END) || ' {' || chr(10) || '  f' || t || ' as g' || t || ', // f0()' || chr(10) || '  type T' || t || ',' || chr(10) || '} from ' || chr(39) || module || chr(39) AS raw FROM placed
UNION ALL SELECT path, 'lib' || (node % 7) || '/sub', 3, false, false, 'import lib, * as all from ' || chr(39) || 'lib' || (node % 7) || '/sub' || chr(39) || ';' FROM sized
UNION ALL SELECT path, './lazy' || node, CAST(14 + 5 * m AS INTEGER), true, false, 'import(' || chr(39) || './lazy' || node || chr(39) || ')' FROM sized""",
)
def _(spark, d):
    own = graph.cut(tangled(spark, d))
    return syntax.import_statements(syntax.parsed(own), own).select("source", "module", "line", "is_dynamic", "type_only", "raw")


@query(
    "import_specifiers",
    TANGLED
    + """SELECT path AS source, unnest(['g' || t, 'T' || t]) AS local, unnest(['f' || t, 'T' || t]) AS imported, unnest([type_only, true]) AS type_only FROM placed
UNION ALL SELECT path, unnest(['lib', 'all']), unnest(['default', '*']), false FROM sized""",
)
def _(spark, d):
    return syntax.import_specifiers(syntax.parsed(tangled(spark, d))).drop("ord")


@query(
    "symbols_ast",
    TANGLED
    + """SELECT path AS file, unnest(['C' || node, 'run', 'inner', 'f' || node]) AS name, unnest(['class', 'method', 'function', 'function']) AS kind,
  CAST(4 * m + unnest([5, 6, 8 + m, 12 + m]) AS INTEGER) AS line_start, CAST(4 * m + unnest([11 + m, 10 + m, 8 + m, 13 + m]) AS INTEGER) AS line_end,
  unnest([true, false, false, true]) AS is_exported, unnest([NULL, 'C' || node, NULL, NULL]) AS parent FROM sized""",
)
def _(spark, d):
    return syntax.declared_symbols(tangled(spark, d))


@query(
    "symbol_edges_ast",
    TANGLED
    + """SELECT path AS file, 'run' AS source, 'f' || t AS target, 'calls' AS edge_type, CAST(8 + 4 * m + i AS INTEGER) AS line, target AS target_file FROM placed
UNION ALL SELECT path, 'run', 'inner', 'calls', CAST(9 + 5 * m AS INTEGER), path FROM sized""",
)
def _(spark, d):
    own = graph.cut(tangled(spark, d))
    tokens = syntax.parsed(own)
    declared = graph.cut(syntax.declarations(tokens))
    imports = graph.cut(text.resolve_imports(syntax.import_statements(tokens, own), own))
    at = imports.groupBy("source", "ord").agg(F.min("target").alias("target_file"))
    specifiers = syntax.import_specifiers(tokens).join(at, ["source", "ord"], "left").select(F.col("source").alias("file"), "local", "imported", "target_file")
    reachable = imports.where("target is not null").select(F.col("source").alias("file"), "target")
    return syntax.resolve(syntax.scoped_references(tokens, declared), syntax.symbols_of(declared), specifiers, reachable).where("target_file is not null")


# ---- Python, Go, Java and Rust


def python_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    content = F.format_string("from pkg.mod%d import thing\nimport os\n\nclass C%d(Base%d):\n    def run(self):\n        return helper%d()\n\ndef helper%d():\n    return C%d()\n", k, k, k % 5, k, k, k)
    return rel.read(spark, d, "supplier").select(F.format_string("py/s%d.py", k).alias("path"), content.alias("content"))


@query(
    "symbols_python",
    """WITH s AS (SELECT s_suppkey AS k, 'py/s' || s_suppkey || '.py' AS file FROM supplier)
SELECT file, 'C' || k AS name, 'class' AS kind, 4 AS line_start, 6 AS line_end, true AS is_exported, NULL::VARCHAR AS parent FROM s
UNION ALL SELECT file, 'run', 'method', 5, 6, false, 'C' || k FROM s UNION ALL SELECT file, 'helper' || k, 'function', 8, 9, true, NULL FROM s""",
)
def _(spark, d):
    return symbols.python_symbols(python_files(spark, d))


@query(
    "symbol_edges_python",
    """WITH s AS (SELECT s_suppkey AS k, 'py/s' || s_suppkey || '.py' AS file FROM supplier)
SELECT file, 'C' || k AS source, 'Base' || (k % 5) AS target, 'extends' AS edge_type, 4 AS line FROM s
UNION ALL SELECT file, 'run', 'helper' || k, 'calls', 6 FROM s UNION ALL SELECT file, 'helper' || k, 'C' || k, 'calls', 9 FROM s""",
)
def _(spark, d):
    return symbols.python_edges(python_files(spark, d))


@query(
    "imports_languages",
    """WITH c AS (SELECT c_custkey AS k FROM customer), s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'm' || k || '.go' AS source, 'go' AS language, unnest(['fmt', 'example.com/x' || k]) AS module FROM c WHERE k % 3 = 0
UNION ALL SELECT 'M' || k || '.java', 'java', unnest(['a.b' || k || '.C', 'x.Y.*']) FROM c WHERE k % 3 = 1
UNION ALL SELECT 'm' || k || '.rs', 'rust', unnest(['std::io' || k, 'm' || k]) FROM c WHERE k % 3 = 2
UNION ALL SELECT 'py/s' || k || '.py', 'python', unnest(['pkg.mod' || k, 'os']) FROM s""",
)
def _(spark, d):
    k = F.col("c_custkey")
    kinds = [("m%d.go", 'package m\n\nimport (\n\t"fmt"\n\t"example.com/x%d"\n)\n'), ("M%d.java", "import a.b%d.C;\nimport static x.Y.*;\n"), ("m%d.rs", "use std::io%d;\nmod m%d;\n")]
    path, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, body) in enumerate(kinds):
        path, content = F.when(k % 3 == i, F.format_string(name, k)).otherwise(path), F.when(k % 3 == i, F.format_string(body, *[k] * body.count("%d"))).otherwise(content)
    files = rel.read(spark, d, "customer").select(path.alias("path"), content.alias("content")).unionByName(python_files(spark, d))
    return text.imports_regex(files).select("source", "language", "module")


# ---- logs, diffs, diagnostics, schemas


def log_lines(spark: SparkSession, d: str, head: F.Column) -> DataFrame:
    """log, line_no, line: a log per customer, a commit per order, the files of its rows."""
    orders = rel.read(spark, d, "orders").join(rel.read(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    at = lambda k: F.col("o_orderkey") * 100 + k
    log = F.col("o_custkey").alias("log")
    heads = orders.select(log, at(F.lit(0)).alias("line_no"), head.alias("line"))
    ends = orders.select(log, at(F.lit(99)).alias("line_no"), F.lit("").alias("line"))
    rows = rel.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey").join(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    return heads.unionByName(ends).unionByName(rows.select(log, at(F.col("l_linenumber")).alias("line_no"), F.format_string("src/f_%d.ts", "l_partkey").alias("line")))


@query(
    "parse_git_log",
    """WITH c AS (SELECT o_custkey AS log, o_orderkey, 2 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS cid FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT DISTINCT log, cid, 'src/f_' || l_partkey || '.ts' AS path FROM c JOIN lineitem ON l_orderkey = o_orderkey""",
)
def _(spark, d):
    return readers.parse_git_log(log_lines(spark, d, F.format_string("%040x", "o_orderkey")))


@query(
    "parse_author_log",
    """WITH c AS (SELECT o_custkey AS log, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS cid, c_name AS author, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT log, cid, lower(author) || '@x' AS email, author, CAST(epoch(o_orderdate) AS BIGINT) AS ts, 'src/f_' || l_partkey || '.ts' AS path FROM c JOIN lineitem ON l_orderkey = o_orderkey""",
)
def _(spark, d):
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")
    head = F.concat_ws("|", F.lit("COMMIT"), F.concat(F.lower("c_name"), F.lit("@x")), F.col("c_name"), seconds)
    return readers.parse_author_log(log_lines(spark, d, head)).withColumn("ts", F.unix_seconds("ts"))


@query(
    "parse_diff",
    """SELECT o_orderkey AS diff, 'src/f_' || o_custkey || '.ts' AS file, 10::BIGINT AS start_line, 9 + o_orderkey % 5 AS end_line FROM orders WHERE o_orderkey % 5 > 0
UNION ALL SELECT o_orderkey, 'src/g_' || o_custkey || '.ts', 20, 20 FROM orders""",
)
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    shown = F.array(
        F.format_string("diff --git a/src/f_%d.ts b/src/f_%d.ts", c, c), F.format_string("@@ -1,2 +10,%d @@", k % 5), F.lit("+x"), F.format_string("diff --git a/src/old.ts b/src/g_%d.ts", c), F.format_string("+++ b/src/g_%d.ts", c), F.lit("@@ -5 +20 @@ f()")
    )
    return risk.parse_diff(rel.read(spark, d, "orders").select(k.alias("diff"), F.posexplode(shown).alias("line_no", "line")))


@query("parse_tsc", "SELECT 'src/f_' || p_partkey || '.ts' AS file, CAST(p_size AS INTEGER) AS line, 7 AS col, CASE WHEN p_partkey % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, '6133' AS code, p_name || ' is unused' AS message FROM part")
def _(spark, d):
    log = rel.read(spark, d, "part").select(
        F.explode(F.array(F.format_string("src/f_%d.ts:%d:7 - %s TS6133: %s is unused", "p_partkey", "p_size", F.when(F.col("p_partkey") % 2 == 0, "error").otherwise("warning"), "p_name"), F.lit("noise"))).alias("line")
    )
    return risk.parse_diagnostics(log)


@query(
    "prisma_entities",
    """WITH s AS (SELECT 'db/s' || s_suppkey || '.prisma' AS path, 'M' || s_suppkey AS entity, s_suppkey FROM supplier)
SELECT path, entity, 'id' AS field, 'Int' AS type, false AS is_relation, NULL::VARCHAR AS relation, true AS is_primary, false AS is_nullable FROM s
UNION ALL SELECT path, entity, 'name', 'String', false, NULL, false, true FROM s
UNION ALL SELECT path, entity, 'items', 'Item' || s_suppkey, true, 'one-to-many', false, false FROM s""",
)
def _(spark, d):
    k = F.col("s_suppkey")
    content = F.format_string("model M%d {\n  id Int @id\n  name String?\n  // note\n  items Item%d[]\n}\n", k, k)
    return text.prisma_entities(rel.read(spark, d, "supplier").select(F.format_string("db/s%d.prisma", k).alias("path"), content.alias("content"))).drop("ord")


# ---- entry points, content classes and scans

#: What a customer's file is: path, content, then the expected entry type, confidence, stage and content category.
KINDS = (
    ("app/api/c%d/route.ts", "export const x = 1", "route", "high", 2, "unknown"),
    ("lib/c%d/server.ts", "app.listen(3000)", "main", "medium", 3, "unknown"),
    ("lib/c%d.py", "app = FastAPI()", "main", "high", 3, "entry"),
    ("lib/c%d.test.ts", "app.listen(3000)", None, None, None, "unknown"),
    ("docs/c%d/routes.ts", "@Controller('x')", None, None, None, "controller"),
    ("pkg/c%d/jest.config.js", "yargs.argv", "cli", "medium", 3, "unknown"),
    ("lib/c%d/routes.ts", "@Injectable()", "route", "medium", 2, "service"),
    ("build/c%d.bin", "", None, None, None, "unknown"),
)


def customer_files(spark: SparkSession, d: str) -> DataFrame:
    """path, content."""
    k, kind = F.col("c_custkey"), F.col("c_custkey") % len(KINDS)
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in KINDS)), kind.cast("int") + 1)
    return rel.read(spark, d, "customer").select(F.replace(pick(0), F.lit("%d"), k.cast("string")).alias("path"), pick(1).alias("content"))


def _kind_sql(i: int) -> str:
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"([{', '.join(quote(x[i]) for x in KINDS)}])[c_custkey % {len(KINDS)} + 1]"


CUSTOMER_FILES_SQL = f"kinds AS (SELECT replace({_kind_sql(0)}, '%d', c_custkey::VARCHAR) AS file, {_kind_sql(2)} AS type, {_kind_sql(3)} AS confidence, CAST({_kind_sql(4)} AS INTEGER) AS stage, {_kind_sql(5)} AS category FROM customer)"


@query("entry_pattern", with_tables(CUSTOMER_FILES_SQL) + "SELECT * EXCLUDE (category) FROM kinds WHERE stage = 2")
def _(spark, d):
    return entries.pattern_entries(customer_files(spark, d))


@query("entry_content", with_tables(CUSTOMER_FILES_SQL) + "SELECT * EXCLUDE (category) FROM kinds WHERE stage = 3")
def _(spark, d):
    return entries.content_entries(customer_files(spark, d))


@query(
    "entry_points",
    with_tables(CUSTOMER_FILES_SQL)
    + """SELECT file, type, confidence, 'runtime' AS surface, CAST(row_number() OVER (ORDER BY confidence <> 'high', CASE type WHEN 'route' THEN 1 WHEN 'cli' THEN 2 ELSE 5 END, file) AS INTEGER) AS rank
FROM kinds WHERE stage IS NOT NULL""",
)
def _(spark, d):
    return entries.entry_points(customer_files(spark, d))


@query("classify_content", with_tables(CUSTOMER_FILES_SQL) + "SELECT file AS path, category, CASE WHEN category = 'unknown' THEN 'low' ELSE 'high' END AS confidence FROM kinds")
def _(spark, d):
    unknown = customer_files(spark, d).withColumn("category", F.lit("unknown")).withColumn("confidence", F.lit("low"))
    return classify.classify_content(unknown).select("path", "category", "confidence")


#: Where a customer's file lies, by the length of its path; only a whole segment excludes.
PLACES = ("", "test-repos/", "my-test-repos/", "lib/test-repos/deep/", "test-repos.old/")
PLACES_SQL = "([" + ", ".join(f"'{p}'" for p in PLACES) + f"])[length(file) % {len(PLACES)} + 1]"


@query("is_code_file", with_tables(CUSTOMER_FILES_SQL) + f"SELECT {PLACES_SQL} || file AS path, file NOT LIKE '%.bin' AS is_code, length(file) % {len(PLACES)} IN (1, 3) AS is_excluded FROM kinds")
def _(spark, d):
    place = F.element_at(F.array(*map(F.lit, PLACES)), F.length("path") % len(PLACES) + 1)
    placed = customer_files(spark, d).select(F.concat(place, F.col("path")).alias("path"))
    return placed.select("path", readers.is_code_file(F.col("path")).alias("is_code"), readers.is_excluded(F.col("path")).alias("is_excluded"))


#: How an import names a package: as such, below it, from a folder of dependencies, and a package that only begins like it.
SHAPES = ("%s", "%s/sub/file", "/w/node_modules/%s/index.js", "%s-other")
PACKAGES = sorted((name, role) for role, names in classify.BOUNDARY_PACKAGES.items() for name in names)
PACKAGES_SQL = "packages AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{role}')" for i, (_, role) in enumerate(PACKAGES)) + ") AS p(k, role))"


@query(
    "boundary_lookup",
    with_tables(PACKAGES_SQL) + f"SELECT 'f' || l_orderkey AS source, role, CAST(l_linenumber AS INTEGER) AS edge_ord FROM lineitem JOIN packages ON k = l_partkey % {len(PACKAGES)} WHERE l_suppkey % {len(SHAPES)} < 3",
)
def _(spark, d):
    """Each row of lineitem is an import of one of all known packages, in one of the shapes."""
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int") + 1)
    target = F.replace(pick(SHAPES, "l_suppkey"), F.lit("%s"), pick([name for name, _ in PACKAGES], "l_partkey"))
    imports = rel.read(spark, d, "lineitem").select(F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("source"), target.alias("target"), F.col("l_linenumber").cast("int").alias("edge_ord"))
    return classify.with_roles(imports, classify.boundary_lookup(spark))


# ---- selections, reports, tours


@query("mean", with_tables(rel.FILES_SQL, CLASSIFIED_SQL) + "SELECT category, avg(lines) AS mean FROM classified GROUP BY category")
def _(spark, d):
    return metrics.mean(classified(spark, d), "lines", "category")


@query(
    "rank_prompt_files",
    COUNTED.rstrip()
    + f""",
{CLASSIFIED_SQL}
SELECT path, (CASE WHEN category = 'route' THEN 500 ELSE 0 END + CASE WHEN fan_in >= 12 THEN 180 ELSE 0 END + 20 * fan_in + 8 * fan_out + least(c.lines, 400) / 8 - CASE WHEN category = 'test' THEN 150 ELSE 0 END)::DOUBLE AS score
FROM classified c JOIN counts USING (node) ORDER BY score DESC, path LIMIT 8""",
)
def _(spark, d):
    own = classified(spark, d).select("node", "path", "category").join(counts(spark, d), "node")
    flags = own.select(
        "path", (F.col("category") == "route").alias("is_entry"), F.lit(False).alias("is_key"), (F.col("fan_in") >= 12).alias("is_hot"), F.lit(0).alias("weight"), "fan_in", "fan_out", "lines", (F.col("category") == "test").alias("is_test")
    )
    return metrics.rank_prompt_files(flags).select("path", F.col("score").cast("double").alias("score"))


@query(
    "select_symbols",
    with_tables(EDGES, rel.SYMBOLS_SQL, "called AS (SELECT s.file, s.name, count(*) AS n FROM edges JOIN symbols s ON s.node = t GROUP BY ALL)")
    + """, every AS (SELECT s.file, s.name, row_number() OVER (ORDER BY is_entry_point DESC, is_exported DESC, coalesce(n, 0) DESC, s.file, s.name) AS rank FROM (SELECT file, name, is_entry_point, bool_or(is_exported) AS is_exported FROM symbols GROUP BY ALL) s LEFT JOIN called c USING (file, name))
SELECT file, name, CAST(rank AS INTEGER) AS rank FROM every WHERE rank <= 200""",
)
def _(spark, d):
    every = rel.symbols(spark, d)
    calls = rel.edges(spark, d).select(F.col("t").alias("node")).join(every.select("node", "file", "name"), "node")
    return symbols.select_symbols(every.groupBy("file", "name", "is_entry_point").agg(F.bool_or("is_exported").alias("is_exported")), calls)


@query("symbol_candidates", with_tables(rel.SYMBOLS_SQL, rel.HUNKS_SQL) + "SELECT name, file FROM symbols WHERE file NOT IN (SELECT file FROM hunks WHERE start_line < 10)")
def _(spark, d):
    return symbols.symbol_candidates(rel.symbols(spark, d).select("name", "file"), rel.hunks(spark, d).where("start_line < 10").select("file"))


@query("sort_enriched", with_tables(rel.SYMBOLS_SQL) + "SELECT file, line_start, name FROM symbols ORDER BY file, line_start, name LIMIT 50")
def _(spark, d):
    return symbols.sort_enriched(rel.symbols(spark, d).select("file", "line_start", "name"), 50)


@query(
    "cycle_members",
    COUNTED.rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f",\n{CLASSIFIED_SQL},\n{SELECTED_SQL},\n{SCC_SQL}\n"
    + "SELECT node FROM selected UNION SELECT c.node FROM comps c JOIN large USING (comp) WHERE comp IN (SELECT comp FROM comps JOIN selected USING (node))",
)
def _(spark, d):
    e = graph.cut(rel.edges(spark, d))
    return graph.with_cycle_members(graph.cut(selected(spark, d, e).select("node")), graph.cut(graph.scc(rel.files(spark, d), e)))


@query("flow_merge", "SELECT conv_id AS entry, role AS file, CAST(min(turn) // 2 AS BIGINT) AS seq, CAST(min(turn) % 2 AS INTEGER) AS pos FROM conversations GROUP BY conv_id, role")
def _(spark, d):
    turns = rel.read(spark, d, "conversations")
    return graph.flow_merge(turns.select(F.col("conv_id").alias("entry"), F.floor(F.col("turn") / 2).alias("seq"), (F.col("turn") % 2).cast("int").alias("pos"), F.col("role").alias("file")))


@query("sanitize_paths", with_tables(rel.FILES_SQL) + "SELECT node, 'see ' || path || ' in ' AS text FROM files")
def _(spark, d):
    shown = rel.files(spark, d).select("node", F.concat(F.lit("see /w/me/"), "path", F.lit(" in /w/me")).alias("text"))
    return shown.select("node", report.sanitize_paths(F.col("text"), "/w/me/").alias("text"))


@query("enrich_symbols", with_tables(rel.SYMBOLS_SQL) + "SELECT file, name, kind, CAST(line_start AS BIGINT) AS line_start, max(CASE WHEN node % 2 = 0 THEN line_end END) AS line_end, true AS is_exported, max(parent) AS parent FROM symbols GROUP BY ALL")
def _(spark, d):
    every = rel.symbols(spark, d)
    base = every.withColumn("line_end", F.lit(None).cast("long")).withColumn("is_exported", F.lit(False)).drop("node")
    enriched = every.withColumn("line_end", F.when(F.col("node") % 2 == 0, F.col("line_end")).cast("long")).withColumn("is_exported", F.lit(True)).drop("node")
    return symbols.merge_enrichment(base, enriched).drop("is_entry_point")


@query(
    "federation_edges",
    "SELECT 'src/a/f' || c_custkey || '.ts' AS source, (['../../../s0/x', '@s/s1/y', '~s/z', './own'])[c_custkey % 4 + 1] AS target, 's' || (c_custkey % 4) AS repo, CAST(c_custkey % 4 + 1 AS INTEGER) AS rule FROM customer WHERE c_custkey % 4 < 3",
)
def _(spark, d):
    k = F.col("c_custkey")
    edges = rel.read(spark, d, "customer").select(F.format_string("src/a/f%d.ts", k).alias("source"), F.element_at(F.array(*map(F.lit, ("../../../s0/x", "@s/s1/y", "~s/z", "./own"))), (k % 4).cast("int") + 1).alias("target"))
    sisters = spark.createDataFrame([("s0", "/w/s0", "none"), ("s1", "/w/s1", "@s/s1"), ("s2", "/w/s2", "other")], "name string, path string, package string")
    return graph.federation_edges(edges, sisters, spark.createDataFrame([("~s", "/w/s2/lib")], "prefix string, base string"), "/w/me")


@query(
    "validate_tour",
    """SELECT conv_id AS tour, array_to_string(list_filter([CASE WHEN count(*) < 3 THEN 'too few steps' END, CASE WHEN count(*) > 8 THEN 'too many steps' END, CASE WHEN count(*) FILTER (length(coalesce(text, '')) < 30) > 0 THEN 'explanation too short' END,
  CASE WHEN count(*) FILTER (length(role) < 5) > 0 THEN 'reason too short' END], lambda x: x IS NOT NULL), ', ') AS errors FROM conversations GROUP BY conv_id""",
)
def _(spark, d):
    turns = rel.read(spark, d, "conversations")
    steps = turns.select(F.col("conv_id").alias("tour"), F.col("turn").alias("ord"), F.col("role").alias("title"), F.coalesce("text", F.lit("")).alias("what"), F.col("role").alias("why"), F.array("role").alias("files"))
    return tours.validate_tours(steps, least_why=5, most_tokens=1 << 40).select("tour", F.array_join("errors", ", ").alias("errors"))


@query(
    "fallback_tour",
    COUNTED.rstrip()
    + ", e AS (SELECT node AS file, row_number() OVER (ORDER BY fan_out DESC, node) AS rank FROM counts ORDER BY rank LIMIT 2), h AS (SELECT node AS file, row_number() OVER (ORDER BY fan_in DESC, node) AS rank FROM counts WHERE node NOT IN (SELECT file FROM e) ORDER BY rank LIMIT 1) "
    + "SELECT file, CAST(row_number() OVER (ORDER BY k, rank) AS INTEGER) AS step FROM (SELECT 0 AS k, * FROM e UNION ALL SELECT 1, * FROM h)",
)
def _(spark, d):
    c = graph.cut(counts(spark, d))
    best = lambda column, n: c.orderBy(F.desc(column), "node").limit(n).select(F.col("node").alias("file"), F.row_number().over(Window.orderBy(F.desc(column), "node")).alias("rank"))
    return tours.fallback_tour(best("fan_out", 2), best("fan_in", 10)).select("file", "step")


@query("dedupe_steps")
def _(spark, d):
    """Turns of a conversation as steps, their distinct words as files; held against plain Python in tests."""
    turns = rel.read(spark, d, "conversations")
    content = F.coalesce("text", F.lit(""))
    steps = turns.select(F.col("conv_id").alias("tour"), F.col("turn").alias("ord"), content.alias("what"), F.array_distinct(F.split(content, " ")).alias("files"))
    return tours.dedupe_steps(steps).select("tour", "ord")


@query(
    "context_pack",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, text FROM documents WHERE text IS NOT NULL AND trim(text) <> ''),
b AS (SELECT rank, '### ' || doc_id || chr(10) || '```' || chr(10) || substr(text, 1, 1000) || chr(10) || '```' || chr(10) AS block FROM r),
u AS (SELECT rank, block, sum(length(block)) OVER (ORDER BY rank) AS used FROM b)
SELECT CAST(rank AS INTEGER) AS rank, sha256(block) AS block FROM u WHERE used <= 6500""",
)
def _(spark, d):
    docs = rel.read(spark, d, "documents").where("text is not null and trim(text) <> ''")
    # a report's ranking is short: the first thousand are more than any budget holds
    first = docs.orderBy(F.desc("n_chars"), "doc_id").limit(1000)
    ranked = first.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return text.context_pack(ranked, 10_000).select("rank", F.sha2("block", 256).alias("block"))


@query(
    "retrieve",
    with_tables(
        EDGES, SEEDS_SQL, INDEX_SQL, BM25_SQL, "one AS (SELECT DISTINCT t AS node FROM edges JOIN seeds ON s = node)",
        "walked AS (SELECT node FROM (SELECT node FROM one UNION SELECT t FROM edges JOIN one ON s = node) WHERE node NOT IN (SELECT node FROM seeds))",
        "found AS (SELECT q, id || '::__file__' AS id, rank FROM listed)",
        "near AS (SELECT node || '::__file__' AS id, row_number() OVER (ORDER BY node) - 1 AS rank FROM walked)",
        "together AS (SELECT * FROM found UNION ALL SELECT q, n.id, n.rank FROM near n JOIN found f ON f.id = n.id)",
        "merged AS (SELECT q, id, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS fused FROM together GROUP BY q, id)",
        "ranked AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY fused DESC, id) AS rank FROM merged)",
        "blocks AS (SELECT q, rank, '## ' || doc_id || ' [L1-' || len(string_split(text, chr(10))) || ']' || chr(10) || text || chr(10) || chr(10) AS block FROM ranked JOIN documents ON doc_id || '::__file__' = id)",
        "used AS (SELECT *, sum(length(block)) OVER (PARTITION BY q ORDER BY rank) AS used FROM blocks)",
    )
    + "SELECT q, sha256(string_agg(block, '' ORDER BY rank)) AS context FROM used WHERE used <= 24000 GROUP BY q",
)
def _(spark, d):
    """Whole documents as chunks, the file of a node that with its number; near are the files two steps from the five entry points."""
    name = F.concat(F.col("id").cast("string"), F.lit("::__file__")).alias("id")
    found = scored(spark, d).select("q", name, "rank")
    e = graph.cut(rel.edges(spark, d))
    seeds = e.groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(5).select("node")
    near = scan.ranked(graph.two_hop(e, seeds).select(F.col("node").alias("id")), ["id"]).select(name, (F.col("rank") - 1).alias("rank"))
    none = spark.createDataFrame([], "file string, name string, line_start int, line_end int")
    return text.retrieve(found, near, text.chunks(chunked(spark, d), none), 24_000).select("q", F.sha2("context", 256).alias("context"))
