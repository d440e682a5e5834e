"""Streams give what their batch twins give."""

from pyspark.sql import functions as F

from graphmill.streaming import telemetry
from tests.conftest import rows

PATH, GLOB = "/root/testdata/sf0.001", "events.parquet"


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def events(spark):
    return telemetry.stream(spark, PATH, glob=GLOB)


def batch(spark):
    return spark.read.parquet(f"{PATH}/{GLOB}")


def test_incremental_churn_equals_batch(spark):
    updates = run(spark, telemetry.incremental_churn(events(spark)), "churn", "update")
    assert rows(telemetry.latest(updates, "user_id", "commits")) == rows(telemetry.churn_of(batch(spark)))


def test_windows_equal_batch_before_the_watermark(spark):
    got = run(spark, telemetry.windowed(events(spark), "6 hours"), "windows", "append").drop("p95")
    whole = batch(spark).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    last = got.agg(F.max("start")).first()[0]
    assert rows(got) == rows(whole.select(F.col("w.start").alias("start"), "event_type", "n", "total").where(F.col("start") <= F.lit(last)))


def test_sessions_equal_batch(spark):
    got = run(spark, telemetry.debounced_stream(events(spark), "30 minutes"), "sessions", "append")
    whole = telemetry.debounced(batch(spark)).withColumn("start", F.col("start").cast("timestamp"))
    assert got.count() > 0 and got.exceptAll(whole.select(*got.columns)).count() == 0


def test_token_names_and_steps(spark):
    usage = spark.createDataFrame([(5, None, None, 7, None)], "prompt_tokens int, input_tokens int, completion_tokens int, output_tokens int, total_tokens int")
    assert tuple(telemetry.with_token_aliases(usage).first()) == (5, 5, 7, 7, 12)
    lines = spark.createDataFrame([('{"order": 1, "title": "A", "files": ["a", "b"]}',), ("broken",), ("{}",)], "value string")
    assert rows(telemetry.ndjson_steps(lines, spark.createDataFrame([("a",)], "file string"))) == [("a", 1, "A")]


CHUNKS = [("a", 0, '{"order": 1, "ti', False), ("a", 1, 'tle": "A", "files": ["x"]}\n\nbro', False), ("b", 0, "one\ntwo", False), ("a", 2, "ken\n", False), ("a", 3, '{"order": 2, "title": "B", "files": ["y"]}', True)]


def test_lines_come_once_they_are_whole(spark, tmp_path):
    schema = "source string, seq long, chunk string, last boolean"
    for i, part in enumerate((CHUNKS[:3], CHUNKS[3:4], CHUNKS[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    lines = run(spark, telemetry.whole_lines(chunks), "lines", "append")
    assert sorted((r.source, r.value) for r in lines.collect()) == [("a", "broken"), ("a", '{"order": 1, "title": "A", "files": ["x"]}'), ("a", CHUNKS[4][2]), ("b", "one")]
    known = spark.createDataFrame([("x",), ("y",)], "file string")
    assert rows(telemetry.ndjson_steps(lines, known).select("ord", "title", "file")) == rows(spark.createDataFrame([(1, "A", "x"), (2, "B", "y")], "ord int, title string, file string"))


def test_the_graph_comes_before_the_steps(spark, tmp_path):
    spark.createDataFrame([(1, "A"), (2, "B")], "ord int, title string").write.parquet(str(tmp_path / "steps"))
    steps = spark.readStream.schema("ord int, title string").parquet(str(tmp_path / "steps"))
    graph = spark.createDataFrame([("x", "y")], "s string, t string")
    seen = []
    emit = lambda kind, df: seen.append((kind, None if df is None else sorted(map(tuple, df.collect()))))
    telemetry.graph_then_steps(graph, steps, emit, seconds=120)
    assert seen == [("graph", [("x", "y")]), ("step", [(1, "A"), (2, "B")]), ("end", None)]
    failing = steps.withColumn("ord", F.raise_error(F.lit("no")).cast("int"))
    seen.clear()
    fallback = spark.createDataFrame([(9, "Z")], "ord int, title string")
    telemetry.graph_then_steps(graph, failing, emit, fallback, 120)
    assert seen == [("graph", [("x", "y")]), ("step", [(9, "Z")]), ("end", None)]
