"""Registered queries of sources and sinks: tables are written to the shared folder and read back through the library's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.columns import dirname
from graphmill.lineage import scratch
from graphmill.operators import classify, entries, history, symbols
from graphmill.plans import relations as rel
from graphmill.plans.registry import CHURN_SQL, query, with_tables
from graphmill.sources import readers, versions
from graphmill.streaming import telemetry

# ---- files


def customer_tree(spark: SparkSession, d: str) -> str:
    """The root of a tree with a folder for each nation: a text file with its customers' names, and a JSON file with their keys."""
    root = scratch(spark, "tree")
    own = rel.read(spark, d, "customer").repartition("c_nationkey")
    own.select("c_nationkey", "c_name").write.partitionBy("c_nationkey").text(f"{root}/src")
    own.select("c_nationkey", "c_custkey").write.partitionBy("c_nationkey").json(f"{root}/src/keys")
    own.select("c_nationkey", "c_custkey").write.partitionBy("c_nationkey").json(f"{root}/node_modules")
    return root


def folder_lines(files: DataFrame) -> DataFrame:
    """folder, lines, hash of the sorted lines of all files in it."""
    text = readers.read_text(files, 1 << 30)
    lines = text.select(dirname(F.col("path")).alias("folder"), F.array_sort(F.split(F.rtrim("content", F.lit("\n")), "\n")).alias("lines"))
    return lines.select("folder", F.size("lines").alias("lines"), F.md5(F.array_join("lines", "\n")).alias("hash"))


NAMES_SQL = "SELECT 'src/c_nationkey=' || c_nationkey AS folder, CAST(count(*) AS INTEGER) AS lines, md5(string_agg(c_name, chr(10) ORDER BY c_name)) AS hash FROM customer GROUP BY c_nationkey"
KEYS_SQL = """SELECT 'src/keys/c_nationkey=' || c_nationkey, CAST(count(*) AS INTEGER), md5(string_agg(line, chr(10) ORDER BY line))
FROM (SELECT c_nationkey, '{"c_custkey":' || c_custkey || '}' AS line FROM customer) GROUP BY c_nationkey"""


@query("scan_fs_walk", f"{NAMES_SQL} UNION ALL {KEYS_SQL}")
def _(spark, d):
    """All files of the tree but those of ignored folders."""
    return folder_lines(readers.scan_files(spark, customer_tree(spark, d)))


@query("scan_glob", NAMES_SQL)
def _(spark, d):
    return folder_lines(readers.scan_files(spark, customer_tree(spark, d), "*.txt"))


@query("read_text", "SELECT CAST(doc_id AS VARCHAR) AS path, length(text) AS n, sha256(text) AS hash FROM documents WHERE text <> '' AND length(text) <= 20000 AND doc_id % 5 > 0")
def _(spark, d):
    """Of five documents one begins with a NUL: binary."""
    head = F.when(F.col("doc_id") % 5 == 0, F.lit("\0")).otherwise("")
    files = rel.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.concat(head, F.col("text")), "UTF-8").alias("bytes"))
    return readers.read_text(files, 20_000).select("path", F.char_length("content").cast("long").alias("n"), F.sha2("content", 256).alias("hash"))


@query("read_preview", with_tables(rel.FILES_SQL) + "SELECT path, CASE WHEN node % 7 = 0 THEN 'manifest ' || node ELSE '' END AS content FROM files")
def _(spark, d):
    files = rel.files(spark, d)
    return readers.read_preview(files, files.where("node % 7 = 0").select("path", F.concat(F.lit("manifest "), F.col("node").cast("string")).alias("content")))


KEYS = ("README.md", "readme.MD", "src/README.md", "package.json", "go.mod", "docker-compose.yaml", "Dockerfile", "lib/go.mod", "a.ts", "package.json5")
KEYS_LIST = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"


@query("key_files", f"SELECT {KEYS_LIST}[l_partkey % {len(KEYS)} + 1] AS path, left(repeat(l_orderkey || ',', 100), 300) AS content FROM lineitem WHERE l_partkey % {len(KEYS)} IN (0, 1, 3, 4, 5, 6)")
def _(spark, d):
    path = F.element_at(F.array(*map(F.lit, KEYS)), (F.col("l_partkey") % len(KEYS)).cast("int") + 1)
    files = rel.read(spark, d, "lineitem").select(path.alias("path"), F.repeat(F.concat(F.col("l_orderkey").cast("string"), F.lit(",")), 100).alias("content"))
    return readers.key_files(files, 300)


@query("project_root", "SELECT 'c' || min(c_custkey::VARCHAR) AS root FROM customer WHERE c_custkey % 3 = 1")
def _(spark, d):
    """A marker lies at the top of every third customer's folder, deeper in the next one's."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 1, "/go.mod").when(k % 3 == 2, "/a/package.json").otherwise("/src/x.ts")
    return readers.project_root(rel.read(spark, d, "customer").select(F.concat(F.lit("c"), k.cast("string"), name).alias("path")))


MANIFESTS = ("package.json", "go.mod", "pyproject.toml", "setup.py", "x.md", "requirements.txt")


@query(
    "scan_sister_repos",
    """WITH k AS (SELECT l_orderkey, min([1, 2, 3, 3, NULL, 3][l_partkey % 6 + 1]) AS k FROM lineitem GROUP BY l_orderkey)
SELECT 'r' || l_orderkey AS name, '/w/r' || l_orderkey AS path, ['npm', 'go', 'python'][k] AS kind FROM k WHERE k IS NOT NULL""",
)
def _(spark, d):
    file = F.element_at(F.array(*map(F.lit, MANIFESTS)), (F.col("l_partkey") % len(MANIFESTS)).cast("int") + 1)
    return readers.sister_repositories(spark, rel.read(spark, d, "lineitem").select(F.concat(F.lit("/w/r"), F.col("l_orderkey").cast("string")).alias("folder"), file.alias("file")))


@query("partition_surface", with_tables(rel.FILES_SQL) + "SELECT (['', 'bin/', '.github/', 'my-docs/'])[node % 4 + 1] || path AS path, CASE WHEN node % 4 IN (1, 2) THEN 'tooling' ELSE 'runtime' END AS side FROM files")
def _(spark, d):
    place = F.element_at(F.array(*map(F.lit, ("", "bin/", ".github/", "my-docs/"))), (F.col("node") % 4).cast("int") + 1)
    files = rel.files(spark, d).select(F.concat(place, F.col("path")).alias("path"))
    runtime, tooling = entries.by_surface(files.withColumn("surface", classify.entry_surface(F.col("path"))))
    return runtime.select("path", F.lit("runtime").alias("side")).unionByName(tooling.select("path", F.lit("tooling").alias("side")))


# ---- sinks


@query("sink_jsonl", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    """Two appends to one folder of lines."""
    path, events = scratch(spark, "lines"), rel.read(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    for half in (0, 1):
        readers.sink_jsonl(events.where(F.pmod("event_id", F.lit(2)) == half), path)
    return spark.read.schema(events.schema).json(path)


@query("sink_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def _(spark, d):
    path, orders = scratch(spark, "rows"), rel.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    readers.sink_table(orders, path)
    return spark.read.option("sep", "\t").option("header", True).schema(orders.schema).csv(path)


@query(
    "token_alias",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS p, CASE WHEN event_id % 3 = 0 THEN user_id + 1 END AS i, CASE WHEN event_id % 5 = 0 THEN user_id + 2 END AS c, event_id % 7 AS o, CASE WHEN event_id % 4 = 0 THEN 9 END AS t FROM events)
SELECT event_id, coalesce(p, i) AS prompt_tokens, coalesce(p, i) AS input_tokens, coalesce(c, o) AS completion_tokens, coalesce(c, o) AS output_tokens, coalesce(t, coalesce(p, i) + coalesce(c, o)) AS total_tokens FROM t""",
)
def _(spark, d):
    e, u = F.col("event_id"), F.col("user_id").cast("long")
    usage = rel.read(spark, d, "events").select(
        e, F.when(e % 2 == 0, u).alias("prompt_tokens"), F.when(e % 3 == 0, u + 1).alias("input_tokens"), F.when(e % 5 == 0, u + 2).alias("completion_tokens"), (e % 7).alias("output_tokens"), F.when(e % 4 == 0, 9).cast("long").alias("total_tokens")
    )
    return telemetry.with_token_aliases(usage)


# ---- versions

HALF_SQL = "half AS (SELECT path, count(DISTINCT cid) AS commits, max(ts) AS last_changed FROM commits WHERE cid % 2 = 0 GROUP BY path)"


@query("scan_json_cache", with_tables(rel.COMMITS_SQL, CHURN_SQL) + "SELECT path, commits FROM churn")
def _(spark, d):
    """Of three versions the one whose commit, number of files and tier match."""
    root, churn = scratch(spark, "cache"), history.churn(rel.commits(spark, d)).select("path", "commits")
    stamps = [({"head": "a", "files": 9, "tier": 2}, churn), ({"head": "a", "files": 8, "tier": 2}, churn.where("commits > 1")), ({"head": "b", "files": 9, "tier": 1}, churn.where("commits > 2"))]
    for stamp, df in stamps:
        versions.publish({"churn": df}, root, stamp)
    if versions.matching(spark, root, "b", 9, 2) is not None:
        raise AssertionError("a version of a lower tier was served")
    return versions.matching(spark, root, "a", 9, 1).read(spark, "churn")


@query("stale_while_revalidate", with_tables(rel.COMMITS_SQL, CHURN_SQL, HALF_SQL) + "SELECT 'stale' AS seen, path, commits FROM half UNION ALL SELECT 'fresh', path, commits FROM churn")
def _(spark, d):
    """Half of the commits are there; a reader of the newer head sees them until the rest has been computed."""
    root, commits = scratch(spark, "served"), rel.commits(spark, d)
    compute = lambda some: lambda: {"churn": history.churn(some).select("path", "commits")}
    versions.serve(spark, root, "old", 1, 0, compute(commits.where("cid % 2 = 0")))
    stale, revalidate = versions.serve(spark, root, "new", 1, 0, compute(commits))
    seen = stale.read(spark, "churn")
    fresh = revalidate().read(spark, "churn")
    return seen.withColumn("seen", F.lit("stale")).unionByName(fresh.withColumn("seen", F.lit("fresh")))


# ---- streams


@query(
    "stream_ndjson",
    "SELECT CAST(event_id AS INTEGER) AS ord, event_type AS title, 'f' || (user_id + k) AS file FROM events, (SELECT unnest([0, 1]) AS k) WHERE event_id % 7 > 0 AND (user_id + k) % 2 = 0",
)
def _(spark, d):
    """Events as lines of step records, every seventh cut short, taken line by line as a stream; only files with an even number are known."""
    inbox, steps, offsets = (scratch(spark, name) for name in ("lines", "steps", "offsets"))
    file = lambda k: F.concat(F.lit("f"), (F.col("user_id") + k).cast("string"))
    events = rel.read(spark, d, "events")
    record = F.to_json(F.struct(F.col("event_id").cast("int").alias("order"), F.col("event_type").alias("title"), F.array(file(0), file(1)).alias("files")))
    whole = events.select(F.when(F.col("event_id") % 7 > 0, record).otherwise(F.left(record, F.lit(20))).alias("value"))
    whole.repartition(4).write.text(inbox)
    known = events.select(F.explode(F.array(file(0), file(1))).alias("file")).distinct().where(F.substring("file", 2, 20).cast("long") % 2 == 0)
    lines = spark.readStream.option("maxFilesPerTrigger", 2).text(inbox)
    found = telemetry.ndjson_steps(lines, known)
    running = found.writeStream.format("parquet").option("path", steps).option("checkpointLocation", offsets).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(found.schema).parquet(steps).select("ord", "title", "file")


@query(
    "stream_graph_then_steps",
    with_tables(rel.EDGES_SQL) + "SELECT 0 AS pos, 'graph' AS kind, s AS a, t AS b FROM edges UNION ALL SELECT 1, 'step', o_orderkey, o_custkey FROM orders UNION ALL SELECT 2, 'end', NULL, NULL",
)
def _(spark, d):
    """What a client sees, with the place of each kind among the kinds: the graph whole, then the steps as they come, then the end."""
    seen: list[str] = []
    inbox, outbox = scratch(spark, "steps"), scratch(spark, "seen")
    rel.read(spark, d, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b")).repartition(3).write.parquet(inbox)
    steps = spark.readStream.schema("a long, b long").option("maxFilesPerTrigger", 1).parquet(inbox)

    def emit(kind: str, df: DataFrame | None) -> None:
        if kind not in seen:
            seen.append(kind)
        rows = spark.createDataFrame([(None, None)], "a long, b long") if df is None else df.toDF("a", "b")
        rows.select(F.lit(seen.index(kind)).alias("pos"), F.lit(kind).alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).write.mode("append").parquet(outbox)

    telemetry.graph_then_steps(rel.edges(spark, d), steps, emit)
    return spark.read.schema("pos int, kind string, a long, b long").parquet(outbox)


@query("event_append", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    """Usage appended as JSON lines in two goes and read as a stream of them; each batch's windows are a version."""
    inbox, store, offsets = (scratch(spark, name) for name in ("usage", "windows", "offsets"))
    events = rel.read(spark, d, "events")
    for half in (0, 1):
        readers.sink_jsonl(events.where(F.pmod("event_id", F.lit(2)) == half).repartition(2), inbox)
    windows = telemetry.windowed(telemetry.stream(spark, inbox, fmt="json", files=2), "6 hours").drop("p95")
    publish = lambda batch, epoch: versions.publish({"windows": batch}, store, {"epoch": epoch}) and None
    windows.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    return versions.current(spark, store).read(spark, "windows").withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- look-ups


@query(
    "impact_lookup",
    """WITH s AS (SELECT p_partkey, p_type || '/' || p_brand AS file, p_partkey % 100 AS line_start, split_part(p_name, ' ', 1) AS name, p_brand FROM part),
asked AS (SELECT c_custkey AS q, name, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN file WHEN 2 THEN p_brand ELSE right(p_brand, 2) END AS wanted FROM customer JOIN s ON p_partkey = c_custkey),
f AS (SELECT q, s.file, s.line_start, s.name, row_number() OVER (PARTITION BY q ORDER BY s.file, s.line_start) AS k FROM asked JOIN s USING (name) WHERE wanted IS NULL OR s.file = wanted OR suffix(s.file, '/' || wanted))
SELECT q, file, line_start, name FROM f WHERE k = 1""",
)
def _(spark, d):
    """A question for each customer: by name alone, with the whole path, with its end, or with half of a file's name, which fits none."""
    found = rel.read(spark, d, "part").select(
        "p_partkey", "p_brand", F.concat_ws("/", "p_type", "p_brand").alias("file"), (F.col("p_partkey") % 100).alias("line_start"), F.substring_index("p_name", " ", 1).alias("name")
    )
    kind = F.col("q") % 4
    wanted = F.when(kind == 1, F.col("file")).when(kind == 2, F.col("p_brand")).when(kind == 3, F.right("p_brand", F.lit(2)))
    keys = rel.read(spark, d, "customer").select(F.col("c_custkey").alias("q"), F.col("c_custkey").alias("p_partkey"))
    return symbols.lookup(found, keys.join(found, "p_partkey").select("q", "name", wanted.alias("file")))
