"""Usage events as batches and as streams: event_id, ts, user_id, event_type, value."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphmill.operators import sketch
from graphmill.sources import versions

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def p95_by_tool(events: DataFrame) -> DataFrame:
    """event_type, p95, n: the exact 95th percentile of each tool's value, six decimals; no task orders a tool's values."""
    found = sketch.exact_quantile(events, ["event_type"], F.col("value"), 0.95)
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("event_type", "tool")
    return counts.join(found, F.col("tool").eqNullSafe(F.col("event_type")), "left").select(F.col("tool").alias("event_type"), F.round("value", 6).alias("p95"), counts["n"])


def p95_sketch(events: DataFrame) -> DataFrame:
    """event_type, bucket, n: the state that p95 is estimated from, of a batch or a stream; see operators.sketch."""
    return sketch.histogram(events, ["event_type"], F.col("value"))


def p95_estimates(state: DataFrame) -> DataFrame:
    """event_type, estimate, low, high, n of a state as p95_sketch() gives, merged from any number of them."""
    return sketch.quantile(state, ["event_type"], 0.95)


def tokens_by_session(events: DataFrame, top: int = 10) -> DataFrame:
    """user_id, tokens: the sessions with most."""
    sums = events.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("tokens"))
    return sums.orderBy(F.desc("tokens"), "user_id").limit(top)


def provider_dist(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def with_token_aliases(usage: DataFrame) -> DataFrame:
    """Both names of token counts filled from each other, and the total derived where it is missing."""
    given = F.coalesce("prompt_tokens", "input_tokens")
    made = F.coalesce("completion_tokens", "output_tokens")
    return usage.withColumns(
        {"prompt_tokens": given, "input_tokens": given, "completion_tokens": made, "output_tokens": made, "total_tokens": F.coalesce("total_tokens", given + made)}
    )


def debounced(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, n: events closer than the gap as one."""
    grouped = events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def stream(spark: SparkSession, path: str, schema: str = EVENTS, fmt: str = "parquet", glob: str | None = None, files: int | None = None) -> DataFrame:
    """A file stream whose ts is a TIMESTAMP, as watermarks need it; at most so many files a batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total, p95 by tumbling window; late rows beyond the watermark are left out."""
    sums = (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.percentile_approx("value", 0.95, 10_000).alias("p95"))
    )
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "total", "p95")


def debounced_stream(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), "n")


def churn_of(events: DataFrame) -> DataFrame:
    """user_id, commits, last_changed: the batch twin of incremental churn."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("commits"), F.max(F.col("ts").cast("timestamp")).alias("last_changed"))


def merged_churn(parts: DataFrame) -> DataFrame:
    """One row for each user of rows as churn_of() gives; may be applied to its own results."""
    return parts.groupBy("user_id").agg(F.sum("commits").alias("commits"), F.max("last_changed").alias("last_changed"))


def fold_churn(events: DataFrame, root: str, checkpoint: str, seconds: int | None = None) -> None:
    """What a stream of events has, folded into the table churn at root, each epoch once however often it is tried.

    It ends when all that is there has been taken; started again with the same
    checkpoint, it goes on from there.
    """
    combine = lambda batch: merged_churn(churn_of(batch) if "commits" not in batch.columns else batch)
    query = (
        events.writeStream.foreachBatch(lambda batch, epoch: versions.fold(batch, root, "churn", combine, epoch) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination(seconds)
    finally:
        query.stop()


class ChurnState(StatefulProcessor):
    """Keeps a key's number of events and its latest instant."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("churn", "commits long, last_changed timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        n, last = (known[0], known[1]) if known is not None else (0, None)
        for part in rows:
            n += len(part)
            newest = part["ts"].max().to_pydatetime()
            last = newest if last is None else max(last, newest)
        self.state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "commits": [n], "last_changed": [last]})

    def close(self) -> None:
        pass


def incremental_churn(events: DataFrame) -> DataFrame:
    """Updates of churn_of() as events arrive; the last row of a key counts. Needs the RocksDB state store."""
    return events.select("user_id", "ts").groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=ChurnState(), outputStructType="user_id long, commits long, last_changed timestamp", outputMode="Update", timeMode="None"
    )


def latest(versions: DataFrame, key: str, by: str) -> DataFrame:
    """The last version of each key: serve it while a newer one is computed."""
    w = Window.partitionBy(key).orderBy(F.desc(by))
    return versions.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def ndjson_steps(lines: DataFrame, known: DataFrame) -> DataFrame:
    """ord, title, file of step records in lines (value, ...); invalid lines and unknown files (file) drop out."""
    parsed = lines.select("*", F.from_json("value", "order int, title string, files array<string>").alias("r")).where("r is not null and r.title is not null")
    files = parsed.select(F.col("r.order").alias("ord"), F.col("r.title").alias("title"), F.explode("r.files").alias("file"))
    return files.join(known.select("file"), "file", "left_semi")


class LineState(StatefulProcessor):
    """What follows a source's last line break waits for the next chunk."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "rest string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        chunks = pd.concat(list(rows)).sort_values("seq")
        held = self.rest.get()[0] if self.rest.exists() else ""
        *lines, rest = (held + "".join(chunks["chunk"].fillna(""))).split("\n")
        if chunks["last"].fillna(False).astype(bool).any():
            lines, rest = [*lines, rest], ""
        self.rest.update((rest,))
        lines = [line for line in lines if line.strip()]
        yield pd.DataFrame({"source": [key[0]] * len(lines), "value": lines})

    def close(self) -> None:
        pass


def whole_lines(chunks: DataFrame) -> DataFrame:
    """source, value of a stream of text chunks (source, seq, chunk, last): each line once its break has come, the last one with `last`.

    A source's chunks must come in batches in the order of seq; blank lines and null chunks are passed over.
    """
    return chunks.select("source", "seq", "chunk", "last").groupBy("source").transformWithStateInPandas(
        statefulProcessor=LineState(), outputStructType="source string, value string", outputMode="Append", timeMode="None"
    )


def graph_then_steps(graph: DataFrame, steps: DataFrame, emit: Callable[[str, DataFrame | None], None], fallback: DataFrame | None = None, seconds: int | None = None) -> None:
    """emit("graph", graph) at once, emit("step", rows) for each batch of the stream, emit("end", None) last.

    All input that is there is taken, for at most so many seconds. If the stream
    fails, the fallback's steps come in its place; without a fallback the error goes on.
    """
    emit("graph", graph)
    query = None
    try:
        query = steps.writeStream.outputMode("append").foreachBatch(lambda batch, _: emit("step", batch)).trigger(availableNow=True).start()
        query.awaitTermination(seconds)
    except StreamingQueryException:
        if fallback is None:
            raise
        emit("step", fallback)
    finally:
        if query is not None:
            query.stop()
    emit("end", None)
