"""The canonical relations, made from the driver's tables.

files(path, node, category inputs), edges(s, t), commits, symbols, symbol edges,
hunks and telemetry. Each has a DuckDB twin in SQL with the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Instants that stand for "now".
COMMITS_AS_OF, EVENTS_AS_OF = "2001-08-02 00:00:00", "2024-02-01 00:00:00"


#: Rows of orders that a task takes at once, on average.
LINES_OF_TASK = 1 << 18


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, node, lines."""
    kind = F.substring_index("p_type", " ", 1)
    folder = (
        F.when(kind == "ECONOMY", "src/services/").when(kind == "LARGE", "src/models/").when(kind == "MEDIUM", "src/routes/").when(kind == "PROMO", "tests/").when(kind == "SMALL", "src/utils/").otherwise("src/misc/")
    )
    name = F.concat(folder, F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".ts"))
    return read(spark, sf_dir, "part").select(name.alias("path"), F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("lines"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, t: distinct; a returned row of an order imports what the row after it names."""
    line = read(spark, sf_dir, "lineitem")
    a = line.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("s"))
    b = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("t"))
    return a.join(b, ["l_orderkey", "n"]).where("s <> t").select("s", "t").distinct()


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cid, path, ts, author, email: distinct files of commits."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cid"), F.col("l_partkey").alias("path"))
    # dealt by order, so many rows a task however many there are; what is distinct and the join need no more
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // LINES_OF_TASK + 1)
    line = lines.repartition(parts, "cid").distinct()
    order = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cid"), "o_custkey", F.col("o_orderdate").alias("ts"))
    who = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author"), F.concat(F.lower("c_name"), F.lit("@"), F.lower("c_mktsegment")).alias("email")
    )
    # customers meet orders before lines, which are more and are dealt once
    signed = order.repartition(parts, "o_custkey").join(who.repartition(parts, "o_custkey"), "o_custkey")
    return line.join(signed.repartition(parts, "cid"), "cid").select("cid", "path", "ts", "author", "email")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, kind, file, line_start, line_end, is_exported, is_entry_point, parent."""
    kind = F.substring_index("p_type", " ", 1)
    return read(spark, sf_dir, "part").select(
        F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.when(kind == "ECONOMY", "function").when(kind == "LARGE", "class").when(kind == "MEDIUM", "interface").when(kind == "PROMO", "type_alias").when(kind == "SMALL", "method").otherwise("constant").alias("kind"),
        F.col("p_brand").alias("file"),
        (F.col("p_partkey") % 100).alias("line_start"),
        (F.col("p_partkey") % 100 + F.col("p_size")).alias("line_end"),
        (F.col("p_size") % 2 == 0).alias("is_exported"),
        F.lit(False).alias("is_entry_point"),
        F.when(kind == "SMALL", F.col("p_brand")).alias("parent"),
        F.col("p_partkey").alias("node"),
    )


def symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target (nodes), edge_type, edge_ord."""
    kind = F.element_at(F.array(*map(F.lit, ("calls", "extends", "implements", "uses_type"))), ((F.col("s") + F.col("t")) % 4 + 1).cast("int"))
    return edges(spark, sf_dir).select(F.col("s").alias("source"), F.col("t").alias("target"), kind.alias("edge_type"), F.lit(0).alias("edge_ord"))


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, start_line, end_line."""
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), (key % 25 + 1).cast("string")).alias("file"), (key % 97).alias("start_line"), (key % 97 + 5).alias("end_line"))


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, role: the boundary role of each edge's target, by t % 7; none for 6."""
    names = ("persistence", "http", "messaging", "auth", "validation", "observability")
    at = (F.col("t") % 7).cast("int")
    return edges(spark, sf_dir).where(at < len(names)).select(F.col("s").alias("source"), F.element_at(F.array(*map(F.lit, names)), at + 1).alias("role"), F.col("t").alias("edge_ord"))


FILES_SQL = """files AS (
  SELECT CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'src/services/' WHEN 'LARGE' THEN 'src/models/' WHEN 'MEDIUM' THEN 'src/routes/'
    WHEN 'PROMO' THEN 'tests/' WHEN 'SMALL' THEN 'src/utils/' ELSE 'src/misc/' END || replace(p_name, ' ', '_') || '_' || p_partkey || '.ts' AS path,
    p_partkey AS node, CAST(p_size AS BIGINT) AS lines FROM part)"""


EDGES_SQL = """edges AS (
  SELECT DISTINCT a.l_partkey AS s, b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_returnflag = 'R' AND a.l_partkey <> b.l_partkey)"""


COMMITS_SQL = """commits AS (
  SELECT DISTINCT l_orderkey AS cid, l_partkey AS path, o_orderdate AS ts, c_name AS author, lower(c_name) || '@' || lower(c_mktsegment) AS email
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

SYMBOLS_SQL = """symbols AS (
  SELECT p_name || '_' || p_partkey AS name, CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'function' WHEN 'LARGE' THEN 'class' WHEN 'MEDIUM' THEN 'interface'
    WHEN 'PROMO' THEN 'type_alias' WHEN 'SMALL' THEN 'method' ELSE 'constant' END AS kind, p_brand AS file, p_partkey % 100 AS line_start,
    p_partkey % 100 + p_size AS line_end, p_size % 2 = 0 AS is_exported, false AS is_entry_point,
    CASE WHEN p_type LIKE 'SMALL%' THEN p_brand END AS parent, p_partkey AS node FROM part)"""

SYMBOL_EDGES_SQL = """symbol_edges AS (
  SELECT s AS source, t AS target, (['calls', 'extends', 'implements', 'uses_type'])[(s + t) % 4 + 1] AS edge_type FROM edges)"""

HUNKS_SQL = "hunks AS (SELECT 'Brand#' || (s_suppkey % 25 + 1) AS file, s_suppkey % 97 AS start_line, s_suppkey % 97 + 5 AS end_line FROM supplier)"

ROLES_SQL = """roles AS (
  SELECT s AS source, (['persistence', 'http', 'messaging', 'auth', 'validation', 'observability'])[t % 7 + 1] AS role, t AS edge_ord FROM edges WHERE t % 7 < 6)"""
