"""Registered queries of report sections: the lines that a report shows of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators import classify, graph, history, metrics, sections
from graphmill.plans import relations as rel
from graphmill.plans.registry import CHURN_SQL, CLASSIFIED_SQL, COMPLEXITY_SQL, COUNTS_SQL, COUPLING_SQL, DEAD_SQL, EDGES, HOT_SQL, LAYERS_SQL, OWNED_SQL, RECENCY_SQL, VIOLATIONS_SQL
from graphmill.plans.registry import classified, counts, dead, layers, query, with_tables


def section_sql(name: str, table: str, order: str, top: int, line: str, heading: str, end: str = "", rest: bool = False) -> str:
    """The lines of a section: an SQL expression gives a line, heading with n the first one."""
    more = f"UNION ALL SELECT '{name}', {top + 1}, '- …and ' || (n - {top}) || ' more' FROM (SELECT count(*) AS n FROM {table}) WHERE n > {top}\n" if rest else ""
    return f"""SELECT '{name}' AS section, ord, line FROM (SELECT row_number() OVER (ORDER BY {order}) AS ord, {line} AS line FROM {table}) WHERE ord <= {top}
UNION ALL SELECT '{name}', 0, {heading} FROM (SELECT count(*) AS n FROM {table}) WHERE n > 0
{more}UNION ALL SELECT '{name}', {top + 2}, '{end}' FROM (SELECT count(*) AS n FROM {table}) WHERE n > 0"""


def together(*parts: str) -> str:
    return "SELECT section, CAST(ord AS INTEGER) AS ord, line FROM (" + "\nUNION ALL ".join(f"({p})" for p in parts) + ")"


PERCENT = "CAST(floor(100 * confidence + 0.5) AS BIGINT)"
TEMPORAL_SQL = f"hotspots AS (SELECT c.path, commits, CAST(floor({COMPLEXITY_SQL} * {RECENCY_SQL} + 0.5) AS BIGINT) AS risk FROM churn c JOIN files f ON f.node = c.path)"


@query(
    "report_sections",
    with_tables(rel.FILES_SQL, EDGES, COUNTS_SQL, HOT_SQL, CLASSIFIED_SQL, LAYERS_SQL, VIOLATIONS_SQL, "broken AS (SELECT * FROM violations WHERE direction IS NOT NULL)", rel.SYMBOLS_SQL, DEAD_SQL, "alone AS (SELECT node FROM counts WHERE fan_in = 0 AND fan_out = 0)")
    + together(
        section_sql("hot-files", "hot", "rank", 5, "'- `' || node || '` — ' || fan_in || ' dependents, ' || fan_out || ' deps, ' || lines || ' lines'", "'## Hot Files (Most Connected)'"),
        section_sql("layer-violations", "broken", "s, t", 8, "'- `' || s || '` (' || source_layer || ') → `' || t || '` (' || target_layer || ') — ' || direction", "'## Layer Violations (' || n || ' total)'", rest=True),
        section_sql("dead-code", "dead", "file, line_start, name", 8, f"'- `' || name || '` in `' || file || '`:' || line_start || ' (' || {PERCENT} || '% confidence)'", "'## Dead Code Candidates (' || n || ' total)'", rest=True),
        section_sql("orphans", "alone", "node", 5, "'- `' || node || '`'", "'## Orphan Files (Disconnected from import graph)'"),
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = graph.cut(counts(spark, d))
    parts = [
        sections.section("hot-files", metrics.hot_files(c)), sections.section("layer-violations", graph.cut(classify.layer_violations(rel.edges(spark, d), layers(spark, d)))),
        sections.section("dead-code", sections.with_percent(graph.cut(dead(spark, d)))), sections.section("orphans", metrics.orphans(c)),
    ]
    return sections.union(parts).drop("place")


@query(
    "report_history",
    with_tables(rel.FILES_SQL, rel.COMMITS_SQL, COUPLING_SQL, CHURN_SQL, OWNED_SQL, TEMPORAL_SQL, "first_owner AS (SELECT path, author, percentage, total FROM owned WHERE rank = 1)")
    + together(
        section_sql("coupling", "coupling", "confidence DESC, support DESC, file_a, file_b", 8, f"'- `' || file_a || '` ↔ `' || file_b || '` — ' || {PERCENT} || '% confidence, ' || support || ' commits'", "'## Co-Change Pairs (' || n || ' total, sorted by confidence)'", rest=True),
        section_sql("hotspots", "hotspots", "risk DESC, path", 5, "'- `' || path || '` — ' || commits || ' commits, Risk: ' || risk || ' (Complexity x Churn)'", "'### Risk Hotspots'"),
        section_sql("ownership", "first_owner", "total DESC, path", 3, "'- `' || path || '` — Top: ' || author || ' (' || percentage || '%)'", "'### Ownership Distribution'"),
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    commits = graph.cut(rel.commits(spark, d))
    parts = history.tasks(commits)
    hot = history.temporal(commits, rel.files(spark, d).select(F.col("node").alias("path"), "lines"), rel.COMMITS_AS_OF, parts)
    parts = [
        sections.section("coupling", sections.with_percent(graph.cut(history.coupling(commits)))), sections.section("hotspots", graph.cut(hot)), sections.section("ownership", graph.cut(sections.owners(graph.cut(history.ownership(commits, parts))))),
    ]
    return sections.union(parts).drop("place")


CATEGORY_LIST = "[" + ", ".join(f"'{c}'" for c in sections.CATEGORIES) + "]"


@query(
    "report_compact",
    with_tables(
        rel.FILES_SQL, EDGES, COUNTS_SQL, HOT_SQL, CLASSIFIED_SQL,
        f"numbered AS (SELECT category, path, row_number() OVER (PARTITION BY category ORDER BY path) AS k, count(*) OVER (PARTITION BY category) AS n FROM classified WHERE list_contains({CATEGORY_LIST}, category))",
        f"listed AS (SELECT category, list_position({CATEGORY_LIST}, category) AS pos, string_agg(path, '|' ORDER BY k) || CASE WHEN max(n) > 8 THEN '+' || (max(n) - 8) ELSE '' END AS short FROM numbered WHERE k <= 8 GROUP BY category)",
    )
    + together(
        section_sql("hot-files", "hot", "rank", 5, "'  #f:' || node || ' #in:' || fan_in || ' #out:' || fan_out || ' #L:' || lines", "'@hot ['", "]"),
        section_sql("layers", "listed", "pos", 11, "'  #' || category || ':' || short", "'@layers ['", "]"),
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = classified(spark, d).select("path", "category")
    parts = [sections.section("hot-files", metrics.hot_files(graph.cut(counts(spark, d))), "toon"), sections.section("layers", graph.cut(sections.layers(own)), "toon")]
    return sections.union(parts).drop("place")
