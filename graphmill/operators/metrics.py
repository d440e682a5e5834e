"""Counts and rankings over a file graph: files (node, ...), edges (s, t)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fan_counts(files: DataFrame, edges: DataFrame, distinct: bool = False) -> DataFrame:
    """node, fan_in, fan_out: edges, or distinct neighbours, zero-filled."""
    e = edges.select("s", "t").distinct() if distinct else edges
    into = e.groupBy(F.col("t").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))
    out = e.groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))
    return files.select("node").join(into, "node", "left").join(out, "node", "left").na.fill(0, ["fan_in", "fan_out"])


def instability_of(fan_in: Column, fan_out: Column) -> Column:
    return F.when(fan_in + fan_out > 0, fan_out / (fan_in + fan_out))


def instability(counts: DataFrame) -> DataFrame:
    """counts with instability: out / (in + out), null for isolated files."""
    return counts.withColumn("instability", instability_of(F.col("fan_in"), F.col("fan_out")))


def orphans(counts: DataFrame) -> DataFrame:
    return counts.where("fan_in = 0 and fan_out = 0").select("node")


def file_text_counts(texts: DataFrame) -> DataFrame:
    """key, lines, imports, exports of texts (key, content): lines that aren't blank, import and export tokens."""
    body = F.coalesce("content", F.lit(""))
    filled = F.filter(F.split(body, r"\r?\n"), lambda line: F.regexp_count(line, F.lit(r"\S")) > 0)
    return texts.select(
        "key",
        F.size(filled).cast("long").alias("lines"),
        F.regexp_count(body, F.lit(r"(?<![0-9A-Za-z_])import(?![0-9A-Za-z_])|require\s*\(")).cast("long").alias("imports"),
        F.regexp_count(body, F.lit(r"(?<![0-9A-Za-z_])export(?![0-9A-Za-z_])|module\.exports|exports\.")).cast("long").alias("exports"),
    )


def hot_files(metrics: DataFrame, share: float = 0.8, at_least: int = 5, at_most: int = 100) -> DataFrame:
    """node, fan_in, fan_out, lines, rank of the smallest prefix that reaches the share of all fan-in.

    Only the first at_most rows can be in the result, so the running sum is over
    these, not over all files in one window.
    """
    total = metrics.agg(F.sum("fan_in").alias("total"))
    order = [F.desc("fan_in"), F.desc("fan_out"), F.desc("lines"), F.asc("node")]
    first = metrics.select("node", "fan_in", "fan_out", "lines").orderBy(*order).limit(at_most)
    w = Window.orderBy(*order)
    ranked = first.withColumn("rank", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("fan_in").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.join(F.broadcast(total)).where((F.col("rank") <= at_least) | (F.col("before") < share * F.col("total"))).select("node", "fan_in", "fan_out", "lines", "rank")


def hot_files_coverage(hot: DataFrame, metrics: DataFrame) -> DataFrame:
    whole = metrics.agg(F.greatest(F.coalesce(F.sum("fan_in"), F.lit(0)), F.lit(1)).alias("total"))
    return hot.agg(F.coalesce(F.sum("fan_in"), F.lit(0)).alias("hot")).join(whole).select((F.col("hot") / F.col("total")).alias("coverage"))


def rank_instability(metrics: DataFrame, top: int = 5) -> DataFrame:
    """node, instability, fan_out of the least stable files that something imports."""
    return metrics.where("fan_in > 0").select("node", "instability", "fan_out").orderBy(F.desc(F.coalesce("instability", F.lit(-1.0))), F.desc("fan_out"), "node").limit(top)


def mean(values: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """mean of a column, 0 without values; one row, or one per value of `by`."""
    grouped = values.groupBy(by) if by else values.groupBy()
    return grouped.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("mean"))


def prompt_scores(files: DataFrame) -> DataFrame:
    """path, score from is_entry, is_key, is_hot, weight, fan_in, fan_out, lines, is_test."""
    score = (
        F.when(F.col("is_entry"), 500).otherwise(0)
        + F.when(F.col("is_key"), 180).otherwise(0)
        + F.when(F.col("is_hot"), 180).otherwise(0)
        + F.col("weight")
        + 20 * F.col("fan_in")
        + 8 * F.col("fan_out")
        + F.least(F.col("lines"), F.lit(400)) / 8
        - F.when(F.col("is_test"), 150).otherwise(0)
    )
    return files.select("path", score.alias("score"))


def rank_prompt_files(files: DataFrame, top: int = 8) -> DataFrame:
    """The files with the highest prompt_scores()."""
    return prompt_scores(files).orderBy(F.desc("score"), "path").limit(top)


def adjacency(edges: DataFrame) -> DataFrame:
    """node, upstream, downstream: sorted neighbour arrays; a node with a hub's degree has a hub's array."""
    up = edges.groupBy(F.col("t").alias("node")).agg(F.sort_array(F.collect_set("s")).alias("upstream"))
    down = edges.groupBy(F.col("s").alias("node")).agg(F.sort_array(F.collect_set("t")).alias("downstream"))
    empty = F.array().cast("array<bigint>")
    return up.join(down, "node", "full").select("node", F.coalesce("upstream", empty).alias("upstream"), F.coalesce("downstream", empty).alias("downstream"))


def directory_rollup(files: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(directories, edges between them).

    files: node, path, kind, weight, circular edges: s, t, circular. A directory has
    its files' number, summed weight and most frequent kind, smallest on ties.
    """
    from graphmill.functions.columns import dirname

    placed = files.withColumn("dir", dirname(F.col("path")))
    kinds = placed.groupBy("dir", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    nodes = kinds.groupBy("dir").agg(F.sum("n").alias("files"), F.sum("weight").alias("weight"), F.min(F.struct(-F.col("n"), "kind"))["kind"].alias("kind"))
    at = placed.select("node", "dir")
    between = (
        edges.join(at.withColumnRenamed("node", "s").withColumnRenamed("dir", "source"), "s").join(at.withColumnRenamed("node", "t").withColumnRenamed("dir", "target"), "t").where("source <> target")
    )
    return nodes, between.groupBy("source", "target").agg(F.bool_or("circular").alias("circular"), F.count(F.lit(1)).alias("edges"))


def select_nodes(nodes: DataFrame, most: int = 200) -> DataFrame:
    """All entry points, and others by fan-in up to `most` rows together; nodes: node, is_entry, fan_in."""
    entries = nodes.where("is_entry")
    room = F.broadcast(entries.agg(F.greatest(F.lit(0), most - F.count(F.lit(1))).alias("room")))
    rest = nodes.where("not is_entry").orderBy(F.desc("fan_in"), "node").limit(most)
    ranked = rest.withColumn("k", F.row_number().over(Window.orderBy(F.desc("fan_in"), "node")))
    return entries.unionByName(ranked.join(room).where("k <= room").select(*nodes.columns))
