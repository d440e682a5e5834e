"""Co-change coupling, churn and ownership over a commit log.

Commits are rows (cid, path, ts, author, email), one per file of a commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.columns import contains_any, half_up
from graphmill.lineage import cut

#: E-mail parts that mark automated authors.
BOT_PATTERNS = ("[bot]", "noreply@github.com", "github-actions@", "dependabot")


#: Pairs of files that a task counts, on average.
PAIRS_OF_TASK = 1 << 19


#: Rows of a log that a task holds, on average.
ROWS_OF_TASK = 1 << 19


def tasks(log: DataFrame) -> int:
    """Tasks for a written log (cut()), whose rows are counted without reading them."""
    return max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), log.count() // ROWS_OF_TASK + 1)


def _dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """df by keys in so many tasks; None leaves that to the shuffles after it."""
    return df if parts is None else df.repartition(parts, *keys)


def file_frequency(commits: DataFrame, parts: int | None = None) -> DataFrame:
    """path, freq: commits of each file. parts: tasks that rows are dealt to, here and below."""
    return _dealt(commits.select("cid", "path"), parts, "cid", "path").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("freq"))


def commit_window(commits: DataFrame, newest: int) -> DataFrame:
    """The rows of the newest commits, by ts, then cid. A top-k report: TakeOrderedAndProject and a semi join."""
    keep = commits.groupBy("cid").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), F.desc("cid")).limit(newest)
    return commits.join(keep.select("cid"), "cid", "left_semi")


def ubiquity_filter(commits: DataFrame, threshold: float = 0.8, parts: int | None = None) -> DataFrame:
    """path, freq of the files in at most that share of all commits."""
    total = _dealt(commits.select("cid"), parts, "cid").agg(F.count_distinct("cid").alias("total"))
    return file_frequency(commits, parts).join(F.broadcast(total), F.col("freq") <= threshold * F.col("total")).select("path", "freq")


def support(commits: DataFrame, most_files: int | None = None) -> DataFrame:
    """file_a < file_b, support: commits that hold both.

    A commit of n files makes n * (n - 1) / 2 pairs, in an equi join that AQE can
    split. Pairs are counted beforehand, and dealt so that a task holds about PAIRS_OF_TASK
    of them however many there are. most_files leaves out larger commits; None takes all.
    """
    least = int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = cut(commits.select("cid", "path"), "support")
    one = given.repartition(max(least, given.count() // PAIRS_OF_TASK + 1), "cid", "path").distinct()
    if most_files is not None:
        small = one.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_files)
        one = one.join(small.select("cid"), "cid", "left_semi")
    a, b = one.withColumnRenamed("path", "file_a"), one.withColumnRenamed("path", "file_b")
    n = F.col("n")
    made = one.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    parts = max(least, int(made // PAIRS_OF_TASK) + 1)
    # few pairs repeat within a task of the join: they are counted after they are dealt
    dealt = a.join(b, "cid").where("file_a < file_b").select("file_a", "file_b").repartition(parts, "file_a", "file_b")
    return dealt.groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("support"))


def min_support(pairs: DataFrame, least: int = 2) -> DataFrame:
    return pairs.where(F.col("support") >= least)


def confidence(pairs: DataFrame, frequency: DataFrame, parts: int | None = None) -> DataFrame:
    """pairs with confidence: support by the commits of file_a, three decimals."""
    return _dealt(pairs, parts, "file_a").join(_dealt(frequency.withColumnRenamed("path", "file_a"), parts, "file_a"), "file_a").select(
        "file_a", "file_b", "support", half_up(F.col("support") / F.col("freq"), 3).alias("confidence")
    )


def coupling(commits: DataFrame, least_support: int = 2, threshold: float = 0.8, newest: int | None = None, most_files: int | None = None) -> DataFrame:
    """file_a, file_b, support, confidence. Frequencies count before the ubiquity filter."""
    log = commits.select("cid", "path", "ts") if newest is not None else commits.select("cid", "path")
    log = commit_window(log, newest) if newest is not None else log
    # both are written and counted, so that tasks hold no more rows of a larger log
    log = cut(log.select("cid", "path"), "log")
    parts = tasks(log)
    usual = _dealt(ubiquity_filter(log, threshold, parts).select("path"), parts, "path")
    pairs = cut(min_support(support(_dealt(log, parts, "path").join(usual, "path", "left_semi"), most_files), least_support), "pairs")
    return confidence(pairs, file_frequency(log, parts), tasks(pairs))


def is_bot(email: Column, patterns: tuple[str, ...] = BOT_PATTERNS) -> Column:
    return contains_any(F.lower(email), patterns)


def without_bots(commits: DataFrame, patterns: tuple[str, ...] = BOT_PATTERNS) -> DataFrame:
    return commits.where(~is_bot(F.col("email"), patterns))


def recency(ts: Column, as_of: str) -> Column:
    """1.5 below 30 days, 1.2 below 90, 1.0 below 180, else 0.8."""
    days = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 86400
    return F.when(days < 30, 1.5).when(days < 90, 1.2).when(days < 180, 1.0).otherwise(0.8)


def churn(commits: DataFrame, parts: int | None = None) -> DataFrame:
    """path, commits, last_changed."""
    return _dealt(commits.select("path", "cid", "ts"), parts, "path", "cid").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("commits"), F.max("ts").alias("last_changed"))


def ownership(commits: DataFrame, parts: int | None = None) -> DataFrame:
    """path, email, author, commits, percentage, rank: a file's authors, most commits first."""
    each = _dealt(commits.select("path", "email", "cid", "author"), parts, "path", "email").groupBy("path", "email").agg(F.count_distinct("cid").alias("commits"), F.min("author").alias("author"))
    each = _dealt(each, parts, "path")
    whole = Window.partitionBy("path")
    order = whole.orderBy(F.desc("commits"), "email")
    return each.select(
        "path", "email", "author", "commits", half_up(100 * F.col("commits") / F.sum("commits").over(whole)).cast("long").alias("percentage"), F.row_number().over(order).alias("rank")
    )


def avg_churn(churned: DataFrame) -> DataFrame:
    """avg_churn: mean commits of a file, one decimal; 0 without files."""
    return churned.agg(F.coalesce(half_up(F.sum("commits") / F.count(F.lit(1)), 1), F.lit(0.0)).alias("avg_churn"))


def temporal(commits: DataFrame, files: DataFrame, as_of: str, parts: int | None = None) -> DataFrame:
    """path, commits, last_changed, lines, complexity, risk; files: path, lines. Files without lines drop out."""
    complexity = half_up(F.col("lines") / 100 * F.col("commits"))
    return (
        churn(commits, parts)
        .join(files.select("path", "lines"), "path")
        .select(
            "path", "commits", "last_changed", "lines", complexity.cast("long").alias("complexity"), half_up(complexity * recency(F.col("last_changed"), as_of)).cast("long").alias("risk")
        )
    )


def rank_hotspots(hotspots: DataFrame, top: int = 50) -> DataFrame:
    return hotspots.orderBy(F.desc("risk"), "path").limit(top)


def rank_ownership(owned: DataFrame, least_percentage: int = 75, least_commits: int = 4, top: int = 5) -> DataFrame:
    """path, owner, percentage, total: files that one author dominates, with enough history."""
    total = F.sum("commits").over(Window.partitionBy("path"))
    leading = owned.withColumn("total", total).where("rank = 1")
    flagged = leading.where((F.col("percentage") >= least_percentage) & (F.col("total") >= least_commits))
    return flagged.select("path", F.coalesce("author", "email").alias("owner"), "percentage", "total").orderBy(F.desc("percentage"), F.desc("total"), "path").limit(top)


def rank_dangerous(churned: DataFrame, fan_in: DataFrame, as_of: str, top: int = 5) -> DataFrame:
    """path, value, recent_churn, fan_in: recent churn times fan-in; one of both above 1."""
    recent = half_up(F.col("commits") * recency(F.col("last_changed"), as_of), 2)
    scored = churned.join(fan_in.select("path", "fan_in"), "path").select("path", "commits", "fan_in", recent.alias("recent_churn")).withColumn("value", half_up(F.col("recent_churn") * F.col("fan_in"), 2))
    return scored.where("value > 0 and (commits > 1 or fan_in > 1)").select("path", "value", "recent_churn", "fan_in").orderBy(F.desc("value"), F.desc("fan_in"), "path").limit(top)
