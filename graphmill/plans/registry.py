"""The registered queries of the repository operators, each with its DuckDB oracle.

Inputs are the canonical relations of plans.relations; oracles build the same
relations as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.functions.columns import package_name, token_estimate
from graphmill.lineage import scratch
from graphmill.operators import classify, graph, history, metrics, postings, report, risk, symbols, text, tours
from graphmill.plans import relations as rel
from graphmill.sources import readers, versions
from graphmill.streaming import telemetry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def with_tables(*tables: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(tables) + "\n"


EDGES = rel.EDGES_SQL
FREQ_SQL = "freq AS (SELECT path, count(DISTINCT cid) AS freq FROM commits GROUP BY path)"

# ---- coupling


@query("file_frequency", with_tables(rel.COMMITS_SQL, FREQ_SQL) + "SELECT path, freq FROM freq")
def _(spark, d):
    return history.file_frequency(rel.commits(spark, d))


PAIRS_SQL = "pairs AS (SELECT a.path AS file_a, b.path AS file_b, count(*) AS support FROM log a JOIN log b ON a.cid = b.cid AND a.path < b.path GROUP BY ALL)"
LOG_SQL = "log AS (SELECT DISTINCT cid, path FROM commits)"


@query("support", with_tables(rel.COMMITS_SQL, LOG_SQL, PAIRS_SQL) + "SELECT * FROM pairs")
def _(spark, d):
    return history.support(rel.commits(spark, d))


@query("min_support", with_tables(rel.COMMITS_SQL, LOG_SQL, PAIRS_SQL) + "SELECT * FROM pairs WHERE support >= 2")
def _(spark, d):
    return history.min_support(history.support(rel.commits(spark, d)))


KINDS_SQL = "kinds AS (SELECT DISTINCT l_orderkey AS cid, p_type AS path FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(
    "ubiquity_filter",
    with_tables(KINDS_SQL) + "SELECT path, count(*) AS freq FROM kinds GROUP BY path HAVING count(*) <= 0.5 * (SELECT count(DISTINCT cid) FROM kinds)",
)
def _(spark, d):
    kinds = rel.read(spark, d, "lineitem").join(rel.read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return history.ubiquity_filter(kinds.select(F.col("l_orderkey").alias("cid"), F.col("p_type").alias("path")), 0.5)


COUPLING_SQL = f"""{FREQ_SQL},
usual AS (SELECT path FROM freq WHERE freq <= 0.8 * (SELECT count(DISTINCT cid) FROM commits)),
log AS (SELECT DISTINCT cid, path FROM commits WHERE path IN (SELECT path FROM usual)),
{PAIRS_SQL},
coupling AS (SELECT file_a, file_b, support, floor(support / freq * 1000 + 0.5) / 1000 AS confidence FROM pairs JOIN freq ON path = file_a WHERE support >= 2)"""


@query("coupling", with_tables(rel.COMMITS_SQL, COUPLING_SQL) + "SELECT * FROM coupling")
def _(spark, d):
    return history.coupling(rel.commits(spark, d))


@query(
    "commit_window",
    with_tables(rel.COMMITS_SQL, "newest AS (SELECT cid FROM commits GROUP BY cid ORDER BY max(ts) DESC, cid DESC LIMIT 2000)") + "SELECT cid, path FROM commits JOIN newest USING (cid)",
)
def _(spark, d):
    return history.commit_window(rel.commits(spark, d), 2000).select("cid", "path")


# ---- metrics

COUNTS_SQL = """counts AS (
  SELECT node, lines, (SELECT count(*) FROM edges WHERE t = node) AS fan_in, (SELECT count(*) FROM edges WHERE s = node) AS fan_out FROM files)"""
COUNTED = with_tables(rel.FILES_SQL, EDGES, COUNTS_SQL)


def counts(spark: SparkSession, d: str) -> DataFrame:
    files = rel.files(spark, d)
    return metrics.fan_counts(files, rel.edges(spark, d)).join(files.select("node", "lines"), "node")


@query("fan_counts", COUNTED + "SELECT node, fan_in, fan_out FROM counts")
def _(spark, d):
    return metrics.fan_counts(rel.files(spark, d), rel.edges(spark, d))


INSTABILITY = "CASE WHEN fan_in + fan_out > 0 THEN fan_out / (fan_in + fan_out) END"


@query("instability", COUNTED + f"SELECT node, fan_in, fan_out, {INSTABILITY} AS instability FROM counts")
def _(spark, d):
    return metrics.instability(metrics.fan_counts(rel.files(spark, d), rel.edges(spark, d)))


@query("orphans", COUNTED + "SELECT node FROM counts WHERE fan_in = 0 AND fan_out = 0")
def _(spark, d):
    return metrics.orphans(metrics.fan_counts(rel.files(spark, d), rel.edges(spark, d)))


HOT_SQL = """ranked AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(fan_in) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM counts WINDOW w AS (ORDER BY fan_in DESC, fan_out DESC, lines DESC, node)),
hot AS (SELECT node, fan_in, fan_out, lines, rank FROM ranked WHERE (rank <= 5 OR before < 0.8 * (SELECT sum(fan_in) FROM counts)) AND rank <= 100)"""


@query("hot_files", COUNTED.rstrip() + ",\n" + HOT_SQL + " SELECT node, fan_in, fan_out, lines, CAST(rank AS INTEGER) AS rank FROM hot")
def _(spark, d):
    return metrics.hot_files(counts(spark, d))


@query("hot_files_coverage", COUNTED.rstrip() + ",\n" + HOT_SQL + " SELECT sum(fan_in) / greatest((SELECT sum(fan_in) FROM counts), 1) AS coverage FROM hot")
def _(spark, d):
    all_counts = counts(spark, d)
    return metrics.hot_files_coverage(metrics.hot_files(all_counts), all_counts)


@query("total_lines", with_tables(rel.FILES_SQL) + "SELECT CAST(sum(lines) AS BIGINT) AS lines FROM files")
def _(spark, d):
    return rel.files(spark, d).agg(F.sum("lines").alias("lines"))


@query("avg_fan_out", with_tables(rel.FILES_SQL, EDGES) + "SELECT (SELECT count(*) FROM edges) / greatest((SELECT count(*) FROM files), 1) AS avg_fan_out")
def _(spark, d):
    n = rel.files(spark, d).agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    return rel.edges(spark, d).agg(F.count(F.lit(1)).alias("m")).join(n).select((F.col("m") / F.col("n")).alias("avg_fan_out"))


@query("rank_instability", COUNTED + f"SELECT node, {INSTABILITY} AS instability, fan_out FROM counts WHERE fan_in > 0 ORDER BY 2 DESC, fan_out DESC, node LIMIT 5")
def _(spark, d):
    return metrics.rank_instability(metrics.instability(metrics.fan_counts(rel.files(spark, d), rel.edges(spark, d))))


@query(
    "adjacency_maps",
    with_tables(EDGES, "nodes AS (SELECT s AS node FROM edges UNION SELECT t FROM edges)")
    + "SELECT node, (SELECT count(*) FROM edges WHERE t = node) AS n_upstream, (SELECT count(*) FROM edges WHERE s = node) AS n_downstream FROM nodes",
)
def _(spark, d):
    return metrics.adjacency(rel.edges(spark, d)).select("node", F.size("upstream").cast("long").alias("n_upstream"), F.size("downstream").cast("long").alias("n_downstream"))


@query(
    "import_edge_groups", with_tables(EDGES) + "SELECT s, count(*) AS n, array_to_string(list(t ORDER BY t), ',') AS targets FROM edges GROUP BY s"
)
def _(spark, d):
    return rel.edges(spark, d).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("t")), ",").alias("targets"))


# ---- classification


def _duck(pattern: str) -> str:
    return pattern.replace("'", "''")


NAME_SQL = "regexp_extract(path, '[^/]*$')"
CATEGORY_SQL = (
    "CASE WHEN split_part(path, '/', 1) IN ("
    + ", ".join(f"'{p}'" for p in classify.LIBRARY_PACKAGES)
    + ") THEN 'libSource'\n"
    + "\n".join(f"  WHEN regexp_matches({'path' if what == 'path' else NAME_SQL}, '{_duck(p)}') THEN '{category}'" for category, _, what, p in classify.PATH_RULES)
    + "\n  ELSE 'unknown' END"
)
CLASSIFIED_SQL = f"classified AS (SELECT node, path, lines, {CATEGORY_SQL} AS category FROM files)"
LAYER_SQL = "CASE category " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in classify.LAYERS.items()) + " ELSE -1 END"
LAYERS_SQL = f"layers AS (SELECT node, category, {LAYER_SQL} AS layer FROM classified)"


def classified(spark: SparkSession, d: str) -> DataFrame:
    """Files with their categories; dealt to tasks first, as the patterns cost more than the rows and a small file is read by one task."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return classify.classify_path(rel.files(spark, d).repartition(parts, "node"))


def layers(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("node", "category", classify.layer_of(F.col("category")).alias("layer"))


@query("classify_path", with_tables(rel.FILES_SQL, CLASSIFIED_SQL) + "SELECT path, category FROM classified")
def _(spark, d):
    return classified(spark, d).select("path", "category")


@query("classification_summary", with_tables(rel.FILES_SQL, CLASSIFIED_SQL) + "SELECT category, count(*) AS files FROM classified GROUP BY category")
def _(spark, d):
    return classify.classification_summary(classified(spark, d))


@query("primary_language", with_tables(rel.FILES_SQL) + "SELECT 'TypeScript' AS language, count(*) AS files FROM files WHERE path LIKE '%.ts'")
def _(spark, d):
    return classify.primary_language(rel.files(spark, d))


@query("layer_assign", with_tables(rel.FILES_SQL, CLASSIFIED_SQL, LAYERS_SQL) + "SELECT node, category, layer FROM layers")
def _(spark, d):
    return layers(spark, d)


VIOLATIONS_SQL = """violations AS (
  SELECT s, t, a.layer AS source_layer, b.layer AS target_layer, CASE WHEN b.layer < a.layer THEN 'backward' WHEN b.layer - a.layer >= 2 AND a.layer <> -2 THEN 'skip-layer' END AS direction
  FROM edges JOIN layers a ON a.node = s JOIN layers b ON b.node = t WHERE a.layer NOT IN (-1, 0) AND b.layer NOT IN (-1, 0))"""


@query("layer_violations", with_tables(rel.FILES_SQL, EDGES, CLASSIFIED_SQL, LAYERS_SQL, VIOLATIONS_SQL) + "SELECT * FROM violations WHERE direction IS NOT NULL")
def _(spark, d):
    return classify.layer_violations(rel.edges(spark, d), layers(spark, d))


ROLE_COUNTS_SQL = "role_counts AS (SELECT source, role, count(*) AS n, min(edge_ord) AS first FROM roles GROUP BY source, role)"


@query(
    "boundary_roles",
    with_tables(EDGES, rel.ROLES_SQL, ROLE_COUNTS_SQL) + "SELECT source, role, n FROM role_counts QUALIFY rank() OVER (PARTITION BY source ORDER BY n DESC) = 1",
)
def _(spark, d):
    return classify.boundary_roles(rel.roles(spark, d))


ROLE_CATEGORY_SQL = "CASE role " + " ".join(f"WHEN '{r}' THEN '{c}'" for r, c in classify.ROLE_CATEGORY.items()) + " END"


@query(
    "classify_boundary",
    with_tables(rel.FILES_SQL, EDGES, CLASSIFIED_SQL, rel.ROLES_SQL, ROLE_COUNTS_SQL, "best AS (SELECT source, role FROM role_counts QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first, role) = 1)")
    + f"SELECT node AS key, CASE WHEN category = 'unknown' THEN coalesce({ROLE_CATEGORY_SQL}, category) ELSE category END AS category FROM classified LEFT JOIN best ON source = node",
)
def _(spark, d):
    known = classified(spark, d).select(F.col("node").alias("key"), "category", "confidence")
    return classify.classify_boundary(known, rel.roles(spark, d)).select("key", "category")


CANDIDATES_SQL = f"""typed AS (SELECT s, t, (s + t) % 3 = 0 AS type_only FROM edges),
degree AS (
  SELECT c.node, c.category, count(i.s) AS fan_in, bool_and(i.type_only) AS all_types, min(i.s) AS one_source, (SELECT count(*) FROM typed WHERE s = c.node) AS fan_out
  FROM classified c LEFT JOIN typed i ON i.t = c.node GROUP BY c.node, c.category),
unknown AS (SELECT * FROM degree WHERE category = 'unknown'),
near AS (SELECT t AS node, s AS near FROM typed UNION SELECT s, t FROM typed),
votes AS (SELECT n.node, c.category AS other, count(*) AS n FROM near n JOIN classified c ON c.node = n.near WHERE c.category <> 'unknown' GROUP BY ALL),
most AS (SELECT node, other, n, sum(n) OVER (PARTITION BY node) AS whole, row_number() OVER (PARTITION BY node ORDER BY n DESC, other) AS k FROM votes),
external AS (SELECT t AS package, s AS node FROM typed WHERE t % 5 = 0),
sole AS (SELECT min(node) AS node FROM external GROUP BY package HAVING count(DISTINCT node) = 1),
candidates AS (
  SELECT node AS key, 'h1' AS heuristic, 'utility' AS category, 'medium' AS confidence FROM unknown WHERE fan_in >= 3 AND fan_out = 0
  UNION ALL SELECT DISTINCT node, 'h2', 'service', 'medium' FROM unknown JOIN sole USING (node)
  UNION ALL SELECT node, 'h3', 'type', 'medium' FROM unknown WHERE fan_in > 0 AND all_types
  UNION ALL SELECT node, 'h4', 'utility', 'low' FROM unknown u WHERE fan_in > 0 AND NOT EXISTS (SELECT 1 FROM typed JOIN classified c ON c.node = s WHERE t = u.node AND c.category <> 'test')
  UNION ALL SELECT node, 'h5', other, 'low' FROM unknown JOIN most USING (node) WHERE k = 1 AND n >= 0.6 * whole
  UNION ALL SELECT u.node, 'h6', 'config', 'low' FROM unknown u JOIN classified c ON c.node = one_source WHERE fan_in = 1 AND fan_out = 0 AND c.category = 'entry')"""
CANDIDATES = with_tables(rel.FILES_SQL, EDGES, CLASSIFIED_SQL, CANDIDATES_SQL)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    typed = rel.edges(spark, d).withColumn("type_only", (F.col("s") + F.col("t")) % 3 == 0)
    external = typed.where("t % 5 = 0").select(F.col("t").alias("package"), F.col("s").alias("key"))
    return classify.graph_candidates(classified(spark, d).select(F.col("node").alias("key"), "path", "category"), typed, external)


@query("graph_candidates", CANDIDATES + "SELECT key, heuristic, category, confidence FROM candidates")
def _(spark, d):
    return candidates(spark, d).select("key", "heuristic", "category", "confidence")


for _h in ("h1_sink", "h2_sole_importer", "h3_type_only", "h4_test_only", "h5_neighbor_majority", "h6_entry_adjacent"):

    @query(_h, CANDIDATES + f"SELECT key, category FROM candidates WHERE heuristic = '{_h[:2]}'")
    def _(spark, d, short=_h[:2]):
        return candidates(spark, d).where(F.col("heuristic") == short).select("key", "category")


SPECIFICITY_SQL = "CASE category " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in classify.SPECIFICITY.items()) + " ELSE 0 END"


@query(
    "classify_graph",
    CANDIDATES + f"SELECT key, category, confidence, heuristic FROM candidates QUALIFY row_number() OVER (PARTITION BY key ORDER BY confidence = 'low', {SPECIFICITY_SQL} DESC, heuristic, category) = 1",
)
def _(spark, d):
    return classify.classify_graph(candidates(spark, d))


@query(
    "repo_character",
    with_tables(rel.FILES_SQL, CLASSIFIED_SQL, "c AS (SELECT count(*) FILTER (category <> 'test') AS files, count(*) FILTER (category = 'unknown') AS unknown FROM classified)")
    + "SELECT files, unknown, unknown / files AS rate, files >= 10 AND unknown / files > 0.4 AS is_library FROM c",
)
def _(spark, d):
    return classify.repo_character(classified(spark, d))


@query("entry_surface", with_tables(rel.FILES_SQL) + "SELECT path, CASE WHEN regexp_matches(path, '^(bin|scripts|presentation|presentation-v2|docs|dev|\\.github)/') THEN 'tooling' ELSE 'runtime' END AS surface FROM files")
def _(spark, d):
    return rel.files(spark, d).select("path", classify.entry_surface(F.col("path")).alias("surface"))


@query(
    "path_priority",
    with_tables(rel.FILES_SQL) + "SELECT path, CAST(CASE WHEN path LIKE 'src/%' THEN 0 ELSE 100 END + CASE WHEN list_contains(string_split(path, '/'), 'tests') THEN 100 ELSE 0 END AS INTEGER) AS priority FROM files",
)
def _(spark, d):
    return rel.files(spark, d).select("path", readers.path_priority(F.col("path")).alias("priority"))


@query("scan_candidates", with_tables(rel.FILES_SQL) + "SELECT path, CAST(CASE WHEN path LIKE 'src/%' THEN 0 ELSE 200 END AS INTEGER) AS priority FROM files ORDER BY 2, path LIMIT 500")
def _(spark, d):
    return readers.scan_candidates(rel.files(spark, d))


@query(
    "file_tree",
    with_tables(rel.FILES_SQL, "parts AS (SELECT string_split(path, '/') AS p FROM files)", "each AS (SELECT p, unnest(range(1, len(p) + 1)) AS depth FROM parts)")
    + "SELECT array_to_string(p[:depth], '/') AS node, array_to_string(p[:depth - 1], '/') AS parent, CAST(depth AS INTEGER) AS depth, bool_and(depth = len(p)) AS is_leaf FROM each GROUP BY 1, 2, 3",
)
def _(spark, d):
    return readers.file_tree(rel.files(spark, d))


# ---- history

CHURN_SQL = "churn AS (SELECT path, count(DISTINCT cid) AS commits, max(ts) AS last_changed FROM commits GROUP BY path)"
RECENCY_SQL = f"""CASE WHEN epoch(TIMESTAMP '{rel.COMMITS_AS_OF}') - epoch(last_changed) < 30 * 86400 THEN 1.5 WHEN epoch(TIMESTAMP '{rel.COMMITS_AS_OF}') - epoch(last_changed) < 90 * 86400 THEN 1.2
  WHEN epoch(TIMESTAMP '{rel.COMMITS_AS_OF}') - epoch(last_changed) < 180 * 86400 THEN 1.0 ELSE 0.8 END::DOUBLE"""


@query("churn", with_tables(rel.COMMITS_SQL, CHURN_SQL) + "SELECT * FROM churn")
def _(spark, d):
    return history.churn(rel.commits(spark, d))


@query("avg_churn", with_tables(rel.COMMITS_SQL, CHURN_SQL) + "SELECT floor(sum(commits) / count(*) * 10 + 0.5) / 10 AS avg_churn FROM churn")
def _(spark, d):
    return history.avg_churn(history.churn(rel.commits(spark, d)))


@query("recency_bucket", with_tables(rel.COMMITS_SQL, CHURN_SQL) + f"SELECT path, {RECENCY_SQL} AS weight FROM churn")
def _(spark, d):
    return history.churn(rel.commits(spark, d)).select("path", history.recency(F.col("last_changed"), rel.COMMITS_AS_OF).cast("double").alias("weight"))


@query("bot_filter", with_tables(rel.COMMITS_SQL) + "SELECT cid, path, email FROM commits WHERE NOT contains(email, '@machinery')")
def _(spark, d):
    return history.without_bots(rel.commits(spark, d), ("@machinery",)).select("cid", "path", "email")


OWNED_SQL = """each AS (SELECT path, email, min(author) AS author, count(DISTINCT cid) AS commits FROM commits GROUP BY path, email),
owned AS (SELECT *, CAST(floor(100 * commits / sum(commits) OVER (PARTITION BY path) + 0.5) AS BIGINT) AS percentage,
  row_number() OVER (PARTITION BY path ORDER BY commits DESC, email) AS rank, sum(commits) OVER (PARTITION BY path) AS total FROM each)"""


@query("ownership", with_tables(rel.COMMITS_SQL, OWNED_SQL) + "SELECT path, email, author, commits, percentage, CAST(rank AS INTEGER) AS rank FROM owned")
def _(spark, d):
    return history.ownership(rel.commits(spark, d))


@query(
    "rank_ownership",
    with_tables(rel.COMMITS_SQL, OWNED_SQL)
    + "SELECT path, author AS owner, percentage, CAST(total AS BIGINT) AS total FROM owned WHERE rank = 1 AND percentage >= 12 AND total >= 4 ORDER BY percentage DESC, total DESC, path LIMIT 5",
)
def _(spark, d):
    # orders come from many customers: a lower share keeps rows in the result
    return history.rank_ownership(history.ownership(rel.commits(spark, d)), least_percentage=12)


COMPLEXITY_SQL = "floor(lines / 100 * commits + 0.5)"


@query(
    "temporal",
    with_tables(rel.COMMITS_SQL, CHURN_SQL, rel.FILES_SQL)
    + f"SELECT c.path, commits, last_changed, lines, CAST({COMPLEXITY_SQL} AS BIGINT) AS complexity, CAST(floor({COMPLEXITY_SQL} * {RECENCY_SQL} + 0.5) AS BIGINT) AS risk FROM churn c JOIN files f ON f.node = c.path",
)
def _(spark, d):
    return history.temporal(rel.commits(spark, d), rel.files(spark, d).select(F.col("node").alias("path"), "lines"), rel.COMMITS_AS_OF)


@query(
    "rank_hotspots",
    with_tables(rel.COMMITS_SQL, CHURN_SQL, rel.FILES_SQL)
    + f"SELECT c.path, commits, CAST(floor({COMPLEXITY_SQL} * {RECENCY_SQL} + 0.5) AS BIGINT) AS risk FROM churn c JOIN files f ON f.node = c.path ORDER BY risk DESC, c.path LIMIT 50",
)
def _(spark, d):
    hot = history.temporal(rel.commits(spark, d), rel.files(spark, d).select(F.col("node").alias("path"), "lines"), rel.COMMITS_AS_OF)
    return history.rank_hotspots(hot).select("path", "commits", "risk")


@query(
    "rank_dangerous",
    with_tables(rel.COMMITS_SQL, CHURN_SQL, EDGES, "fans AS (SELECT t AS path, count(*) AS fan_in FROM edges GROUP BY t)", f"scored AS (SELECT c.path, commits, fan_in, floor(commits * {RECENCY_SQL} * 100 + 0.5) / 100 AS recent_churn FROM churn c JOIN fans USING (path))")
    + """SELECT path, floor(recent_churn * fan_in * 100 + 0.5) / 100 AS value, recent_churn, fan_in FROM scored
WHERE recent_churn * fan_in > 0 AND (commits > 1 OR fan_in > 1) ORDER BY value DESC, fan_in DESC, path LIMIT 5""",
)
def _(spark, d):
    fans = rel.edges(spark, d).groupBy(F.col("t").alias("path")).agg(F.count(F.lit(1)).alias("fan_in"))
    return history.rank_dangerous(history.churn(rel.commits(spark, d)), fans, rel.COMMITS_AS_OF)


# ---- graph

SEEDS_SQL = "seeds AS (SELECT s AS node FROM edges GROUP BY s ORDER BY count(*) DESC, s LIMIT 5)"


@query(
    "two_hop",
    with_tables(EDGES, SEEDS_SQL, "one AS (SELECT DISTINCT t AS node FROM edges JOIN seeds ON s = node)")
    + "SELECT node FROM (SELECT node FROM one UNION SELECT t FROM edges JOIN one ON s = node) WHERE node NOT IN (SELECT node FROM seeds)",
)
def _(spark, d):
    e = rel.edges(spark, d)
    seeds = e.groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(5).select("node")
    return graph.two_hop(e, seeds)


HUB_SQL = "hub AS (SELECT t AS node FROM edges GROUP BY t ORDER BY count(*) DESC, t LIMIT 1)"


def hub(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("t").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(1).select("node")


@query("callers", with_tables(EDGES, HUB_SQL) + "SELECT s AS caller, t AS target FROM edges JOIN hub ON t = node")
def _(spark, d):
    e = rel.edges(spark, d)
    return e.join(hub(e).withColumnRenamed("node", "t"), "t", "left_semi").select(F.col("s").alias("caller"), F.col("t").alias("target"))


@query("callees", with_tables(EDGES, HUB_SQL) + "SELECT s AS source, t AS callee FROM edges JOIN hub ON s = node")
def _(spark, d):
    e = rel.edges(spark, d)
    return e.join(hub(e).withColumnRenamed("node", "s"), "s", "left_semi").select(F.col("s").alias("source"), F.col("t").alias("callee"))


HOPS_SQL = "walk(node, hop) AS (SELECT node, 0 FROM hub UNION SELECT e.s, w.hop + 1 FROM walk w JOIN edges e ON e.t = w.node WHERE w.hop < 40), hops AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node)"


@query("impact", with_tables(EDGES, HUB_SQL, HOPS_SQL, recursive=True) + "SELECT node, hop FROM hops WHERE hop > 0")
def _(spark, d):
    e = rel.edges(spark, d)
    return graph.dependents(e, hub(e)).select("node", "hop")


@query(
    "file_blast",
    with_tables(EDGES, HUB_SQL, HOPS_SQL, recursive=True) + "SELECT CASE WHEN hop = 1 THEN 'direct' ELSE 'transitive' END AS kind, count(*) AS files FROM hops WHERE hop > 0 GROUP BY 1",
)
def _(spark, d):
    e = rel.edges(spark, d)
    return graph.dependents(e, hub(e)).groupBy(F.when(F.col("hop") == 1, "direct").otherwise("transitive").alias("kind")).agg(F.count(F.lit(1)).alias("files"))


@query(
    "bfs_shortest",
    with_tables(EDGES, "hub AS (SELECT s AS node FROM edges GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)", HOPS_SQL.replace("e.s, w.hop", "e.t, w.hop").replace("e.t = w.node", "e.s = w.node"), recursive=True)
    + "SELECT h.node, h.hop, count(p.node) AS predecessors FROM hops h LEFT JOIN edges e ON e.t = h.node LEFT JOIN hops p ON p.node = e.s AND p.hop = h.hop - 1 GROUP BY h.node, h.hop",
)
def _(spark, d):
    e = rel.edges(spark, d)
    root = e.groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(1).select(F.col("node").alias("root"), "node")
    found = graph.cut(graph.reach(e, root).select("node", "hop"))
    before = found.select(F.col("node").alias("s"), (F.col("hop") + 1).alias("hop")).join(e, "s").groupBy(F.col("t").alias("node"), "hop").agg(F.count(F.lit(1)).alias("predecessors"))
    return found.join(before, ["node", "hop"], "left").na.fill(0, ["predecessors"])


@query(
    "blast_scores",
    with_tables(EDGES, rel.SYMBOL_EDGES_SQL)
    + "SELECT target, count(*) AS callers, round(sum(CASE edge_type WHEN 'calls' THEN 1.0 WHEN 'extends' THEN 1.5 WHEN 'implements' THEN 1.2 ELSE 0.5 END::DOUBLE), 6) AS score FROM symbol_edges GROUP BY target",
)
def _(spark, d):
    return graph.blast_scores(rel.symbol_edges(spark, d))


@query(
    "max_blast",
    with_tables(EDGES, rel.SYMBOL_EDGES_SQL, "scores AS (SELECT round(sum(CASE edge_type WHEN 'calls' THEN 1.0 WHEN 'extends' THEN 1.5 WHEN 'implements' THEN 1.2 ELSE 0.5 END::DOUBLE), 6) AS score FROM symbol_edges GROUP BY target)")
    + "SELECT max(score) AS max_blast FROM scores",
)
def _(spark, d):
    return graph.max_blast(rel.symbol_edges(spark, d))


SCC_SQL = """walk(a, b) AS (SELECT s, t FROM edges UNION SELECT w.a, e.t FROM walk w JOIN edges e ON e.s = w.b),
mutual AS (SELECT x.a AS node, x.b AS other FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a),
comps AS (SELECT node, least(node, coalesce((SELECT min(other) FROM mutual m WHERE m.node = f.node), node)) AS comp FROM files f),
large AS (SELECT comp FROM comps GROUP BY comp HAVING count(*) > 1)"""
SCC = with_tables(rel.FILES_SQL, EDGES, SCC_SQL, recursive=True)


def comps(spark: SparkSession, d: str) -> DataFrame:
    return graph.scc(rel.files(spark, d), rel.edges(spark, d))


@query("scc", SCC + "SELECT node, comp FROM comps")
def _(spark, d):
    return comps(spark, d)


@query("reach", SCC + "SELECT DISTINCT b.comp AS root, a.comp AS node FROM walk w JOIN comps a ON a.node = w.a JOIN comps b ON b.node = w.b WHERE a.comp <> b.comp")
def _(spark, d):
    """Which components depend on which; members of a component reach each other and the same others (see scc)."""
    found = graph.cut(comps(spark, d))
    dag = graph.condensation(found, rel.edges(spark, d)).select(F.col("from_comp").alias("s"), F.col("to_comp").alias("t"))
    upward = graph.reach_through(graph.reversed_edges(dag), found.select(F.col("comp").alias("node")))
    return upward.where("root <> node").select("root", "node")


@query(
    "rank_reach",
    with_tables(EDGES, rel.FILES_SQL, "walk(a, b) AS (SELECT s, t FROM edges UNION SELECT w.a, e.t FROM walk w JOIN edges e ON e.s = w.b)", recursive=True)
    + "SELECT b AS node, count(*) AS dependents, count(*) / (SELECT count(*) FROM files) AS value FROM walk WHERE a <> b GROUP BY b ORDER BY 2 DESC, 1 LIMIT 25",
)
def _(spark, d):
    return graph.dependent_counts(rel.files(spark, d), comps(spark, d), rel.edges(spark, d)).where("dependents > 0").orderBy(F.desc("value"), "node").limit(25)


@query("condensation", SCC + "SELECT DISTINCT a.comp AS from_comp, b.comp AS to_comp FROM edges JOIN comps a ON a.node = s JOIN comps b ON b.node = t WHERE a.comp <> b.comp")
def _(spark, d):
    return graph.condensation(comps(spark, d), rel.edges(spark, d))


@query("cycles", SCC + "SELECT comp AS cycle, node FROM comps JOIN large USING (comp)")
def _(spark, d):
    return graph.cycles(comps(spark, d), rel.edges(spark, d))


@query("circular_edges", SCC + "SELECT s, t, a.comp = b.comp AS circular FROM edges JOIN comps a ON a.node = s JOIN comps b ON b.node = t")
def _(spark, d):
    return graph.circular_edges(comps(spark, d), rel.edges(spark, d))


@query(
    "circular_neighbors",
    SCC + "SELECT s AS node, t AS neighbor FROM edges JOIN comps a ON a.node = s JOIN comps b ON b.node = t WHERE a.comp = b.comp UNION SELECT t, s FROM edges JOIN comps a ON a.node = s JOIN comps b ON b.node = t WHERE a.comp = b.comp",
)
def _(spark, d):
    return graph.circular_neighbors(graph.circular_edges(comps(spark, d), rel.edges(spark, d)))


@query("flow_entries", with_tables(rel.FILES_SQL, CLASSIFIED_SQL) + "SELECT node, path FROM classified WHERE category IN ('entry', 'route', 'controller')")
def _(spark, d):
    return graph.flow_entries(classified(spark, d))


FLOWS_SQL = f"""{SCC_SQL},
entries AS (SELECT c.node, o.comp FROM classified c JOIN comps o USING (node) WHERE category IN ('entry', 'route', 'controller')),
leads AS (SELECT o.comp, coalesce(min(l.layer) FILTER (l.layer > 0), arg_min(coalesce(l.layer, -1), o.node)) AS layer FROM comps o LEFT JOIN layers l USING (node) GROUP BY o.comp),
dag AS (SELECT DISTINCT a.comp AS s, b.comp AS t FROM edges JOIN comps a ON a.node = edges.s JOIN comps b ON b.node = edges.t WHERE a.comp <> b.comp),
trace(entry, comp, hop) AS (SELECT node, comp, 0 FROM entries UNION SELECT r.entry, g.t, r.hop + 1 FROM trace r JOIN leads l ON l.comp = r.comp JOIN dag g ON g.s = r.comp WHERE l.layer NOT IN (4, 5) AND r.hop < 20),
steps AS (SELECT entry, r.comp, min(hop) AS hop, any_value(layer) AS layer FROM trace r JOIN leads l ON l.comp = r.comp GROUP BY entry, r.comp HAVING min(hop) < 20)"""
FLOWS = with_tables(rel.FILES_SQL, EDGES, CLASSIFIED_SQL, LAYERS_SQL, FLOWS_SQL, recursive=True)


def traced(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    known = graph.cut(classified(spark, d))
    placed = known.select("node", classify.layer_of(F.col("category")).alias("layer"))
    return graph.flows(graph.flow_entries(known), graph.cut(comps(spark, d)), placed, rel.edges(spark, d))


@query("flows", FLOWS + "SELECT entry, comp, hop, layer FROM steps")
def _(spark, d):
    return traced(spark, d)[0]


@query(
    "flow_anomalies",
    FLOWS + "SELECT entry, s AS from_comp, t AS to_comp, CASE WHEN b.layer < a.layer THEN 'backward' ELSE 'skip-layer' END AS direction FROM steps JOIN dag ON s = comp JOIN leads a ON a.comp = s JOIN leads b ON b.comp = t WHERE a.layer NOT IN (4, 5) AND (b.layer < a.layer OR b.layer - a.layer >= 3)",
)
def _(spark, d):
    return traced(spark, d)[1]


@query(
    "flow_edges",
    "WITH steps AS (SELECT conv_id, role || '-' || turn AS file, lead(role || '-' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations) SELECT DISTINCT file AS source, target FROM steps WHERE target IS NOT NULL",
)
def _(spark, d):
    return graph.flow_edges(rel.read(spark, d, "conversations").select(F.col("conv_id").alias("entry"), F.col("turn").alias("pos"), F.concat_ws("-", "role", F.col("turn").cast("string")).alias("file")))


BRIDGES_SQL = """near(root, node, hop) AS (SELECT DISTINCT s, s, 0 FROM edges WHERE s % 100 = 0 UNION SELECT n.root, e.t, n.hop + 1 FROM near n JOIN edges e ON e.s = n.node WHERE n.hop < 40),
hops AS (SELECT root, node, min(hop) AS hop FROM near GROUP BY root, node),
parents AS (SELECT h.root, h.node, min(e.s) AS parent FROM hops h JOIN edges e ON e.t = h.node JOIN hops p ON p.root = h.root AND p.node = e.s AND p.hop = h.hop - 1 GROUP BY h.root, h.node),
climb(root, start, node) AS (SELECT root, node, node FROM parents UNION ALL SELECT c.root, c.start, p.parent FROM climb c JOIN parents p ON p.root = c.root AND p.node = c.node WHERE p.parent <> c.root),
bridges AS (SELECT p.parent AS s, c.node AS t, count(*) AS betweenness FROM climb c JOIN parents p ON p.root = c.root AND p.node = c.node GROUP BY 1, 2)"""


@query("bridge_edges", with_tables(EDGES, BRIDGES_SQL, recursive=True) + "SELECT * FROM bridges ORDER BY betweenness DESC, s, t LIMIT 20")
def _(spark, d):
    e = graph.cut(rel.edges(spark, d))
    return graph.bridge_edges(graph.bridge_sources(e.select(F.col("s").alias("node"))), e)


@query(
    "seams",
    with_tables(
        rel.FILES_SQL, EDGES, rel.COMMITS_SQL, COUPLING_SQL, SCC_SQL, BRIDGES_SQL,
        "crossing AS (SELECT b.*, x.comp AS a, y.comp AS b FROM bridges b JOIN comps x ON x.node = s JOIN comps y ON y.node = t WHERE x.comp <> y.comp)",
        "means AS (SELECT least(x.comp, y.comp) AS low, greatest(x.comp, y.comp) AS high, avg(confidence) AS mean FROM coupling JOIN comps x ON x.node = file_a JOIN comps y ON y.node = file_b GROUP BY ALL)",
        "raw AS (SELECT s, t, betweenness, coalesce(mean, 0) AS mean, (SELECT count(DISTINCT s) FROM edges WHERE s % 100 = 0) AS n FROM crossing LEFT JOIN means ON low = least(a, b) AND high = greatest(a, b))",
        "scored AS (SELECT s, t, betweenness, round(mean, 9) AS avg_coupling, CAST(floor(least(100.0::DOUBLE, betweenness / n * 100) * 0.7::DOUBLE + greatest(0, 1 - round(mean, 9)) * 30 + 0.5) AS BIGINT) AS score FROM raw)",
        recursive=True,
    )
    + "SELECT * FROM scored WHERE score > 30 ORDER BY score DESC, s, t LIMIT 10",
)
def _(spark, d):
    e = graph.cut(rel.edges(spark, d))
    sources = graph.cut(graph.bridge_sources(e.select(F.col("s").alias("node"))))
    # betweenness and its scale, the number of nodes, are both those of the sources
    return graph.seams(graph.bridge_edges(sources, e, None), graph.cut(comps(spark, d)), history.coupling(rel.commits(spark, d)), sources.count())


@query(
    "neighbor_partition",
    with_tables(EDGES, HUB_SQL, "bits AS (SELECT s AS neighbor, 1 AS bit FROM edges JOIN hub ON t = node UNION ALL SELECT t, 2 FROM edges JOIN hub ON s = node)")
    + "SELECT neighbor, CASE bit_or(bit) WHEN 1 THEN 'up' WHEN 2 THEN 'down' ELSE 'both' END AS side FROM bits GROUP BY neighbor",
)
def _(spark, d):
    e = rel.edges(spark, d)
    return graph.neighbor_partition(e, hub(e).first()["node"])


@query(
    "neighbor_sides",
    SCC.rstrip() + f""", {HUB_SQL},
sided AS (SELECT s AS neighbor, 1 AS bit FROM edges JOIN hub ON t = node UNION ALL SELECT t, 2 FROM edges JOIN hub ON s = node),
home AS (SELECT comp FROM comps JOIN hub USING (node))
SELECT neighbor, CASE WHEN any_value(c.comp) = (SELECT comp FROM home) THEN 'circular' ELSE CASE bit_or(bit) WHEN 1 THEN 'up' WHEN 2 THEN 'down' ELSE 'both' END END AS side FROM sided JOIN comps c ON c.node = neighbor GROUP BY neighbor""",
)
def _(spark, d):
    e = graph.cut(rel.edges(spark, d))
    return graph.neighbor_sides(graph.circular_edges(graph.scc(rel.files(spark, d), e), e), hub(e).first()["node"])


ROLLED_SQL = f"{CLASSIFIED_SQL},\nplaced AS (SELECT node, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, category, lines FROM classified)"


@query(
    "directory_rollup",
    with_tables(rel.FILES_SQL, ROLLED_SQL, "kinds AS (SELECT dir, category, count(*) AS n, sum(lines) AS w FROM placed GROUP BY ALL)")
    + "SELECT dir, CAST(sum(n) AS BIGINT) AS files, CAST(sum(w) AS BIGINT) AS weight, arg_min(category, (-n, category)) AS kind FROM kinds GROUP BY dir",
)
def _(spark, d):
    files = classified(spark, d).select("node", "path", F.col("category").alias("kind"), F.col("lines").alias("weight"))
    return metrics.directory_rollup(files, rel.edges(spark, d).withColumn("circular", F.lit(False)))[0]


@query(
    "directory_edges",
    with_tables(rel.FILES_SQL, EDGES, ROLLED_SQL)
    + "SELECT a.dir AS source, b.dir AS target, bool_or((s + t) % 10 = 0) AS circular, count(*) AS edges FROM edges JOIN placed a ON a.node = s JOIN placed b ON b.node = t WHERE a.dir <> b.dir GROUP BY ALL",
)
def _(spark, d):
    files = classified(spark, d).select("node", "path", F.col("category").alias("kind"), F.col("lines").alias("weight"))
    return metrics.directory_rollup(files, rel.edges(spark, d).withColumn("circular", (F.col("s") + F.col("t")) % 10 == 0))[1]


SELECTED_SQL = """entries AS (SELECT c.node, k.category = 'route' AS is_entry, c.fan_in FROM counts c JOIN classified k USING (node)),
selected AS (SELECT node FROM entries WHERE is_entry UNION ALL
  (SELECT node FROM entries WHERE NOT is_entry ORDER BY fan_in DESC, node LIMIT (SELECT greatest(0, 600 - count(*)) FROM entries WHERE is_entry)))"""


def selected(spark: SparkSession, d: str, edges: DataFrame | None = None) -> DataFrame:
    """Files are classified once, and before they are filtered: a filter on the category would go below the step that deals them to tasks."""
    known = graph.cut(classified(spark, d).select("node", (F.col("category") == "route").alias("is_entry")))
    counted = metrics.fan_counts(rel.files(spark, d), rel.edges(spark, d) if edges is None else edges)
    return metrics.select_nodes(graph.cut(counted.join(known, "node").select("node", "is_entry", "fan_in")), 600)


@query("select_nodes", with_tables(rel.FILES_SQL, EDGES, COUNTS_SQL, CLASSIFIED_SQL, SELECTED_SQL) + "SELECT node FROM selected")
def _(spark, d):
    return selected(spark, d).select("node")


@query(
    "file_graph",
    with_tables(rel.FILES_SQL, EDGES, COUNTS_SQL, CLASSIFIED_SQL, SELECTED_SQL) + "SELECT s, t FROM edges WHERE s IN (SELECT node FROM selected) AND t IN (SELECT node FROM selected)",
)
def _(spark, d):
    chosen = graph.cut(selected(spark, d).select("node"))
    return rel.edges(spark, d).join(chosen.withColumnRenamed("node", "s"), "s", "left_semi").join(chosen.withColumnRenamed("node", "t"), "t", "left_semi").select("s", "t")


SHOWN_SQL = """ids AS (SELECT *, file || '#' || coalesce(parent || '.', '') || name AS id FROM symbols),
linked AS (SELECT a.id AS source, b.id AS target, CASE edge_type WHEN 'uses_type' THEN 'uses' ELSE edge_type END AS label FROM symbol_edges e JOIN ids a ON a.node = e.source JOIN ids b ON b.node = e.target),
shown AS (SELECT id, file, substr(id, length(file) + 2) AS label, coalesce(n, 0) AS weight FROM ids LEFT JOIN (SELECT target, count(*) AS n FROM linked GROUP BY target) ON target = id ORDER BY is_entry_point DESC, is_exported DESC, weight DESC, id LIMIT 300)"""


def shown_symbols(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    every = graph.cut(rel.symbols(spark, d))
    end = lambda side: every.select(F.col("node").alias(side), F.col("file").alias(f"{side}_file"), F.col("name").alias(f"{side}_name"))
    edges = rel.symbol_edges(spark, d).join(end("source"), "source").join(end("target"), "target").select("source_file", F.col("source_name").alias("source"), "target_file", F.col("target_name").alias("target"), "edge_type")
    categories = every.select(F.col("file").alias("path"), F.concat(F.lit("brand"), F.substring("file", -1, 1)).alias("category")).distinct().where("path not like '%5'")
    return report.selected_symbol_graph(every, edges, categories, 300)


@query("symbol_graph_nodes", with_tables(EDGES, rel.SYMBOLS_SQL, rel.SYMBOL_EDGES_SQL, SHOWN_SQL) + "SELECT id, label, CASE WHEN file LIKE '%5' THEN 'unknown' ELSE 'brand' || right(file, 1) END AS type, weight FROM shown")
def _(spark, d):
    return shown_symbols(spark, d)[0]


@query("symbol_graph", with_tables(EDGES, rel.SYMBOLS_SQL, rel.SYMBOL_EDGES_SQL, SHOWN_SQL) + "SELECT source, target, label FROM linked WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)")
def _(spark, d):
    return shown_symbols(spark, d)[1]


@query("path_dedupe", "SELECT 'src/f_' || l_partkey || '.ts' AS path, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    listing = rel.read(spark, d, "lineitem").select(F.format_string("src/f_%d.ts", "l_partkey").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return readers.dedupe_paths(listing, "ord")


# ---- symbols and risk


@query("symbols_by_kind", with_tables(rel.SYMBOLS_SQL) + "SELECT kind, count(*) AS n FROM symbols GROUP BY kind")
def _(spark, d):
    return symbols.symbols_by_kind(rel.symbols(spark, d))


DEAD_SQL = """dead AS (SELECT name, file, line_start, 1.0::DOUBLE AS confidence FROM symbols
  WHERE name NOT IN (SELECT name FROM symbols JOIN edges ON t = node WHERE (s + t) % 4 = 0) AND NOT is_exported AND kind NOT IN ('type_alias', 'interface') AND parent IS NULL AND file NOT IN ('Brand#11', 'Brand#12'))"""


def dead(spark: SparkSession, d: str) -> DataFrame:
    every = rel.symbols(spark, d)
    calls = rel.symbol_edges(spark, d).where("edge_type = 'calls'").select(F.col("target").alias("node"))
    callees = every.join(calls, "node", "left_semi").select("name")
    return symbols.dead_code(every, callees, spark.createDataFrame([("Brand#11",), ("Brand#12",)], "file string"))


@query("dead_code", with_tables(EDGES, rel.SYMBOLS_SQL, DEAD_SQL) + "SELECT * FROM dead")
def _(spark, d):
    return dead(spark, d)


@query(
    "fuse_diagnostics",
    with_tables(EDGES, rel.SYMBOLS_SQL, DEAD_SQL, "unused AS (SELECT p_brand AS file, p_partkey % 100 AS line, min('unused ' || p_partkey) AS message FROM part WHERE p_partkey % 11 = 0 GROUP BY ALL)")
    + "SELECT d.name, d.file, d.line_start, CASE WHEN message IS NOT NULL THEN 0.95 ELSE confidence END AS confidence, message FROM dead d LEFT JOIN unused u ON u.file = d.file AND u.line = d.line_start",
)
def _(spark, d):
    found = rel.read(spark, d, "part").where("p_partkey % 11 = 0").select(
        F.col("p_brand").alias("file"), (F.col("p_partkey") % 100).alias("line"), F.lit(symbols.UNUSED).alias("code"), F.concat(F.lit("unused "), F.col("p_partkey").cast("string")).alias("message")
    )
    return symbols.fuse_diagnostics(dead(spark, d), found)


TOUCHED_SQL = "touched AS (SELECT DISTINCT s.file, s.name FROM symbols s JOIN hunks h ON h.file = s.file AND line_start <= h.end_line AND line_end >= h.start_line)"


@query("touched_symbols", with_tables(rel.SYMBOLS_SQL, rel.HUNKS_SQL, TOUCHED_SQL) + "SELECT * FROM touched")
def _(spark, d):
    return risk.touched_symbols(rel.hunks(spark, d), rel.symbols(spark, d))


IMPACT_SQL = "changed AS (SELECT p_partkey AS file FROM part WHERE p_partkey % 10 = 0),\nimpact AS (SELECT * FROM coupling WHERE (file_a IN (SELECT file FROM changed)) <> (file_b IN (SELECT file FROM changed)))"


def impacted(spark: SparkSession, d: str) -> DataFrame:
    changed = rel.read(spark, d, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("file"))
    return risk.coupling_impact(changed, history.coupling(rel.commits(spark, d)))


@query("coupling_impact", with_tables(rel.COMMITS_SQL, COUPLING_SQL, IMPACT_SQL) + "SELECT * FROM impact")
def _(spark, d):
    return impacted(spark, d).select("file_a", "file_b", "support", "confidence")


@query(
    "diff_risk",
    with_tables(
        EDGES, rel.SYMBOLS_SQL, rel.SYMBOL_EDGES_SQL, rel.HUNKS_SQL, rel.COMMITS_SQL, COUPLING_SQL, IMPACT_SQL,
        "scores AS (SELECT target AS node, round(sum(CASE edge_type WHEN 'calls' THEN 1.0 WHEN 'extends' THEN 1.5 WHEN 'implements' THEN 1.2 ELSE 0.5 END::DOUBLE), 6) AS score FROM symbol_edges GROUP BY target)",
        "one AS (SELECT coalesce(max(score), 0.0) AS max_blast FROM symbols s JOIN hunks h ON h.file = s.file AND line_start <= h.end_line AND line_end >= h.start_line JOIN scores USING (node))",
        "two AS (SELECT coalesce(round(sum(confidence), 6), 0.0) AS coupling FROM impact)",
        "raw AS (SELECT *, least(100.0::DOUBLE, max_blast * 5 + coupling * 20) AS r FROM one, two)",
    )
    + "SELECT max_blast, coupling, CAST(floor(r + 0.5) AS BIGINT) AS score, CASE WHEN r > 80 THEN 'critical' WHEN r > 60 THEN 'high' WHEN r > 40 THEN 'medium' WHEN r > 10 THEN 'low' ELSE 'negligible' END AS level FROM raw",
)
def _(spark, d):
    every = rel.symbols(spark, d)
    touched = every.join(risk.touched_symbols(rel.hunks(spark, d), every), ["file", "name"], "left_semi")
    scores = touched.join(graph.blast_scores(rel.symbol_edges(spark, d)).withColumnRenamed("target", "node"), "node")
    return risk.diff_risk(scores, impacted(spark, d))


@query(
    "gate_check",
    with_tables(rel.FILES_SQL, EDGES, CLASSIFIED_SQL, LAYERS_SQL, VIOLATIONS_SQL, rel.SYMBOLS_SQL, DEAD_SQL, "v AS (SELECT count(*) AS n FROM violations WHERE direction IS NOT NULL)", "c AS (SELECT count(*) AS n FROM dead)")
    + "SELECT v.n AS violations, c.n AS dead_code, v.n <= 132 AND c.n <= 240 AS passed FROM v, c",
)
def _(spark, d):
    v = classify.layer_violations(rel.edges(spark, d), layers(spark, d)).agg(F.count(F.lit(1)).alias("violations"))
    one = v.join(dead(spark, d).agg(F.count(F.lit(1)).alias("dead"))).withColumn("blast", F.lit(0.0))
    checked = one.join(risk.gate_check("violations", "dead", "blast", one))
    return checked.select("violations", F.col("dead").alias("dead_code"), "passed")


# ---- text


@query(
    "imports_regex",
    "SELECT page_id, CAST(unnest(range(len(links))) AS INTEGER) AS ord, unnest(links) AS target FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS links FROM pages)",
)
def _(spark, d):
    return rel.read(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("ord", "target"))


@query(
    "package_name",
    """WITH t AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages), b AS (SELECT regexp_replace(target, '^.*node_modules/', '') AS bare FROM t)
SELECT CASE WHEN bare LIKE '@%' THEN array_to_string(string_split(bare, '/')[1:2], '/') ELSE split_part(bare, '/', 1) END AS package, count(*) AS n FROM b GROUP BY 1""",
)
def _(spark, d):
    targets = rel.read(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("target"))
    return targets.groupBy(package_name(F.col("target")).alias("package")).agg(F.count(F.lit(1)).alias("n"))


def chunked(spark: SparkSession, d: str) -> DataFrame:
    return rel.read(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))


@query(
    "chunk",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, x, unnest(range(1, len(x) + 1, 10)) AS a FROM l)
SELECT doc_id, doc_id || '::body::' || a AS chunk_id, array_to_string(x[a:a + 9], chr(10)) AS content FROM k""",
)
def _(spark, d):
    """Ten lines a chunk, to the end of each text."""
    docs = chunked(spark, d)
    spans = docs.select(F.col("path").alias("file"), F.lit("body").alias("name"), F.explode(F.sequence(F.lit(1), F.size(F.split("content", "\n")), F.lit(10))).alias("line_start")).withColumn("line_end", F.col("line_start") + 9)
    return text.chunks(docs, spans).select(F.col("path").cast("long").alias("doc_id"), "chunk_id", "content")


@query("chunk_files", "SELECT doc_id, doc_id || '::__file__' AS chunk_id, text AS content, len(string_split(text, chr(10)))::INTEGER AS line_end FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    """Without spans each document is one chunk."""
    none = spark.createDataFrame([], "file string, name string, line_start int, line_end int")
    return text.chunks(chunked(spark, d), none).select(F.col("path").cast("long").alias("doc_id"), "chunk_id", "content", "line_end")


@query(
    "file_text_counts",
    """SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), lambda x: regexp_matches(x, '\\S'))) AS lines,
  len(regexp_extract_all(coalesce(text, ''), '\\bimport\\b|require\\s*\\(')) AS imports, len(regexp_extract_all(coalesce(text, ''), '\\bexport\\b|module\\.exports|exports\\.')) AS exports FROM documents""",
)
def _(spark, d):
    return metrics.file_text_counts(rel.read(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content"))).withColumnRenamed("key", "doc_id")


@query(
    "compact_text",
    """WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\\s+$', '')) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, substr(array_to_string(list_filter(x, lambda v, i: v <> '' OR (i > 1 AND x[i - 1] <> '')), chr(10)), 1, 5000) AS compact FROM l""",
)
def _(spark, d):
    return rel.read(spark, d, "documents").where("text is not null").select("doc_id", text.compact_text(F.col("text")).alias("compact"))


_SKELETON_SQL = "|".join(f"(?:{p})" for p in text.SKELETON).replace("'", "''")


@query(
    "skeletonize",
    f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
k AS (SELECT doc_id, list_filter(list_transform(x, lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g'))), lambda y: regexp_matches(y, '{_SKELETON_SQL}')) AS kept, list_transform(x, lambda y: regexp_replace(y, '\\s+$', '')) AS x FROM l)
SELECT doc_id, CASE WHEN len(kept) > 0 THEN array_to_string(list_transform(kept[1:48], lambda y: regexp_replace(y, '\\s*\\{{\\s*$', '')), chr(10))
  ELSE substr(array_to_string(list_filter(x, lambda v, i: v <> '' OR (i > 1 AND x[i - 1] <> '')), chr(10)), 1, 600) END AS skeleton FROM k""",
)
def _(spark, d):
    return rel.read(spark, d, "documents").select("doc_id", text.skeletonize(F.coalesce("text", F.lit(""))).alias("skeleton"))


TERMS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
INDEX_SQL = f"""tokens AS (SELECT doc_id AS id, {TERMS_SQL} AS w FROM documents),
flat AS (SELECT id, len(w) AS length, unnest(w) AS term FROM tokens),
index AS (SELECT term, id, length, count(*) AS tf FROM flat GROUP BY ALL),
questions AS (SELECT item_id AS q, list_distinct({TERMS_SQL}) AS w FROM benchmark),
asked AS (SELECT q, len(w) AS wanted, unnest(w) AS term FROM questions)"""


def indexed(spark: SparkSession, d: str) -> DataFrame:
    return text.inverted_index(rel.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return rel.read(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("content"))


@query(
    "search_text",
    with_tables(INDEX_SQL) + "SELECT q, id FROM index JOIN asked USING (term) GROUP BY q, id, wanted HAVING count(*) = wanted",
)
def _(spark, d):
    return text.search_text(indexed(spark, d), questions(spark, d))


BM25_SQL = """size AS (SELECT count(*) AS n, avg(len(w)) AS avg_length FROM tokens),
df AS (SELECT term, count(*) AS df FROM index GROUP BY term),
scored AS (SELECT q, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score
  FROM asked JOIN df USING (term) JOIN index USING (term), size GROUP BY q, id),
listed AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) - 1 AS rank FROM scored QUALIFY rank < 20)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    sizes = rel.read(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(text.terms(F.coalesce("text", F.lit(""))))).alias("avg_length"))
    return text.top_per_query(text.bm25(indexed(spark, d), questions(spark, d), sizes))


@query("bm25", with_tables(INDEX_SQL, BM25_SQL) + "SELECT q, id, score, CAST(rank AS INTEGER) AS rank FROM listed")
def _(spark, d):
    return scored(spark, d)


FUSED_SQL = """lists AS (SELECT q, 0 AS list, rank, id FROM listed UNION ALL SELECT q, 1, row_number() OVER (PARTITION BY q ORDER BY id) - 1, id FROM listed),
fused AS (SELECT q, id, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS fused FROM lists GROUP BY q, id)"""


def fused(spark: SparkSession, d: str) -> DataFrame:
    best = scored(spark, d)
    by_id = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("id")) - 1)
    return text.rrf(best.select("q", F.lit(0).alias("list"), "rank", "id").unionByName(by_id.select("q", F.lit(1).alias("list"), "rank", "id")))


@query("bm25_index", with_tables(INDEX_SQL, BM25_SQL) + "SELECT q, id, score, CAST(rank AS INTEGER) AS rank FROM listed")
def _(spark, d):
    """The same by a persisted index: half of the documents with another text first, then an update with all."""
    docs = rel.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    store = scratch(spark, "index")
    postings.update(docs.where(F.pmod("id", F.lit(2)) == 0).withColumn("content", F.reverse("content")), store)
    postings.update(docs, store)
    asked = rel.read(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("content"))
    return postings.search(spark, store, asked).select("q", "id", "score", "rank")


@query("rrf", with_tables(INDEX_SQL, BM25_SQL, FUSED_SQL) + "SELECT * FROM fused")
def _(spark, d):
    return fused(spark, d)


def packed(spark: SparkSession, d: str) -> DataFrame:
    ranked = fused(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("fused"), "id")))
    sizes = rel.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.char_length("text").alias("size"))
    return text.budget_pack(ranked.join(sizes, "id"), 24_000)


@query(
    "budget_pack",
    with_tables(INDEX_SQL, BM25_SQL, FUSED_SQL, "r AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY fused DESC, id) AS rank FROM fused)", "p AS (SELECT q, r.id, rank, sum(length(text)) OVER (PARTITION BY q ORDER BY rank) AS used FROM r JOIN documents ON doc_id = r.id)")
    + "SELECT q, id, CAST(rank AS INTEGER) AS rank, CAST(used AS BIGINT) AS used FROM p WHERE used <= 24000",
)
def _(spark, d):
    return packed(spark, d)


@query("token_estimate", "SELECT conv_id, turn, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM conversations")
def _(spark, d):
    return rel.read(spark, d, "conversations").select("conv_id", "turn", token_estimate(F.col("text")).alias("tokens"))


@query("step_reorder", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS step FROM conversations")
def _(spark, d):
    return tours.step_reorder(rel.read(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


HASH_PARTS = " || '|' || ".join(f"CAST(sum(('0x' || substr(h, {i}, 8))::BIGINT) AS VARCHAR)" for i in (1, 9, 17, 25))


@query("state_hash", with_tables(EDGES, "h AS (SELECT sha256(s || '->' || t) AS h FROM edges)") + f"SELECT substr(sha256('what calls this|overview|||' || count(*) || '|' || {HASH_PARTS}), 1, 16) AS hash FROM h")
def _(spark, d):
    return text.state_hash(rel.edges(spark, d), "what calls this", "overview")


@query("content_hash", "SELECT doc_id, sha1(text) AS sha1 FROM documents")
def _(spark, d):
    return rel.read(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha1"))


WRITES_SQL = "writes AS (SELECT o_custkey AS key, o_orderkey AS ord, 'order ' || o_orderkey AS value FROM orders)"


def writes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Values of customers, and later ones in the order of their orders."""
    old = rel.read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return old, rel.read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ord"), F.format_string("order %d", "o_orderkey").alias("value"))


@query("upsert", with_tables(WRITES_SQL) + "SELECT key, arg_max(value, ord) AS value FROM writes GROUP BY key UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT key FROM writes)")
def _(spark, d):
    old, new = writes(spark, d)
    return text.upsert(old, new, ["key"], "ord")


@query("insert_ignore", with_tables(WRITES_SQL) + "SELECT c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT key, arg_min(value, ord) FROM writes WHERE key NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY key")
def _(spark, d):
    old, new = writes(spark, d)
    return text.insert_ignore(old.where("value = 'BUILDING'"), new, ["key"], "ord")


@query("tour_evict", "SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def _(spark, d):
    return tours.evict(rel.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))).select("id")


@query("completeness", with_tables(rel.FILES_SQL, EDGES) + "SELECT 'fullWorkspace' AS scope, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files) AS nodes, (SELECT count(*) FROM edges) AS edges, 'complete' AS coverage, false AS sampled")
def _(spark, d):
    files = rel.files(spark, d)
    return report.completeness(files, files, rel.edges(spark, d))


@query(
    "steering_filter",
    with_tables(rel.FILES_SQL, CLASSIFIED_SQL) + "SELECT node, path FROM classified WHERE category NOT IN ('test', 'e2e', 'fixture', 'example', 'archive', 'entry')",
)
def _(spark, d):
    known = classified(spark, d).select("node", "path", "category")
    return report.steering(known.select("node", "path"), known)


@query(
    "classify_query",
    """WITH k AS (SELECT item_id, lower(text) AS x FROM benchmark),
h AS (SELECT item_id, x, """
    + ", ".join("(" + " + ".join(f"contains(x, '{w}')::INTEGER" for w in words) + f") AS h{i}" for i, words in enumerate(tours.TOUR_KEYWORDS.values()))
    + """ FROM k), g AS (SELECT *, greatest(h0, h1, h2, h3, h4) AS m FROM h)
SELECT item_id, CASE WHEN m > 0 THEN CASE m WHEN h0 THEN 'overview' WHEN h1 THEN 'data-flow' WHEN h2 THEN 'onboarding' WHEN h3 THEN 'dependency-audit' ELSE 'api-surface' END
  WHEN length(x) < 10 THEN 'overview' ELSE 'custom' END AS kind FROM g""",
)
def _(spark, d):
    return rel.read(spark, d, "benchmark").select("item_id", tours.classify_query(F.col("text")).alias("kind"))


@query(
    "join_suffix_unique",
    with_tables(
        rel.FILES_SQL,
        "names AS (SELECT DISTINCT regexp_extract(path, '[^/]*$') AS name FROM files)",
        "wanted AS (SELECT name FROM names UNION ALL SELECT 'misc/' || name FROM names)",
        "parts AS (SELECT path, string_split(path, '/') AS p FROM files)",
        "suffixes AS (SELECT path, array_to_string(p[k:], '/') AS name FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS k FROM parts))",
    )
    + "SELECT name, CASE WHEN count(DISTINCT path) = 1 THEN min(path) END AS path FROM wanted LEFT JOIN suffixes USING (name) GROUP BY name",
)
def _(spark, d):
    files = rel.files(spark, d)
    name = F.substring_index("path", "/", -1)
    wanted = files.select(name.alias("name")).union(files.select(F.concat(F.lit("misc/"), name))).distinct()
    return text.resolve_suffix(wanted, files)


@query(
    "dead_overlay",
    with_tables(EDGES, rel.SYMBOLS_SQL, DEAD_SQL) + "SELECT node, file, file IN (SELECT file FROM dead) AS is_dead FROM symbols",
)
def _(spark, d):
    return report.dead_overlay(rel.symbols(spark, d).select("node", "file"), dead(spark, d))


@query(
    "rank_symbols",
    with_tables(EDGES, rel.SYMBOLS_SQL)
    + "SELECT name, file, count(s) AS incoming FROM symbols LEFT JOIN edges ON t = node GROUP BY node, name, file, is_entry_point, is_exported ORDER BY incoming DESC, is_entry_point DESC, is_exported DESC, name, file LIMIT 8",
)
def _(spark, d):
    return report.rank_symbols(rel.symbols(spark, d), rel.edges(spark, d).select(F.col("t").alias("node")), ["node"])


@query("relevance_gate", "SELECT conv_id, turn, regexp_matches(lower(text), '\\b(" + "|".join(tours.CODE_TERMS) + ")\\b') AS relevant FROM conversations")
def _(spark, d):
    return rel.read(spark, d, "conversations").select("conv_id", "turn", tours.is_relevant(F.col("text")).alias("relevant"))


@query(
    "visible_nodes",
    with_tables(rel.FILES_SQL, EDGES, CLASSIFIED_SQL) + "SELECT node, category FROM classified WHERE category <> 'test' AND node IN (SELECT unnest([s, t]) FROM edges WHERE (s + t) % 10 = 0)",
)
def _(spark, d):
    marked = rel.edges(spark, d).withColumn("circular", (F.col("s") + F.col("t")) % 10 == 0)
    return report.visible_nodes(classified(spark, d).select("node", "category"), marked, hide_tests=True, circular_only=True)


# ---- usage events


@query("telemetry_p95_by_tool", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return telemetry.p95_by_tool(rel.read(spark, d, "events"))


@query("telemetry_tokens_by_session", "SELECT user_id, round(sum(value), 4) AS tokens FROM events GROUP BY user_id ORDER BY tokens DESC, user_id LIMIT 10")
def _(spark, d):
    return telemetry.tokens_by_session(rel.read(spark, d, "events"))


@query("telemetry_provider_dist", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return telemetry.provider_dist(rel.read(spark, d, "events"))


@query(
    "debounce_invalidate",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS head FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, ts, sum(head) OVER (PARTITION BY user_id ORDER BY ts, head DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, k""",
)
def _(spark, d):
    return telemetry.debounced(rel.read(spark, d, "events"))


@query("incremental_temporal", "SELECT user_id, count(*) AS commits, max(ts) AS last_changed FROM events GROUP BY user_id")
def _(spark, d):
    """A stream over half of the events, ended and started again after the other half has come; the table it was folded into."""
    events = rel.read(spark, d, "events")
    inbox, store, checkpoint = (scratch(spark, name) for name in ("inbox", "churn", "offsets"))
    for half in (0, 1):
        events.where(F.pmod("event_id", F.lit(2)) == half).repartition(3).write.mode("append").parquet(inbox)
        telemetry.fold_churn(telemetry.stream(spark, inbox, events.schema, files=2), store, checkpoint)
    return versions.folded(spark, store, "churn", telemetry.merged_churn).withColumn("last_changed", F.col("last_changed").cast("timestamp_ntz"))


@query(
    "telemetry_p95_sketch",
    """WITH x AS (SELECT event_type, CAST(round(value * 1000) AS BIGINT) AS v FROM events),
b AS (SELECT event_type, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket, count(*) AS n FROM x GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS last, sum(n) OVER (PARTITION BY event_type) AS total FROM b),
h AS (SELECT *, (1::BIGINT << greatest(length(bin(bucket)) - 7, 0)) - 1 AS w FROM c WHERE last - n <= floor((total - 1) * 0.95) AND floor((total - 1) * 0.95) < last)
SELECT event_type, round((bucket / 1000.0::DOUBLE + (bucket + w) / 1000.0::DOUBLE) / 2, 6) AS estimate, CAST(total AS BIGINT) AS n FROM h""",
)
def _(spark, d):
    state = telemetry.p95_sketch(rel.read(spark, d, "events"))
    return telemetry.p95_estimates(state).select("event_type", F.round("estimate", 6).alias("estimate"), "n")


from graphmill.plans import listings, parsing, storing  # noqa: E402, F401  their queries join these
