"""Risk of a change: its hunks, what they touch and what usually changes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions.columns import half_up
from graphmill.operators import scan


def parse_diff(lines: DataFrame) -> DataFrame:
    """file, start_line, end_line of the new side's hunks in lines (diff, line_no, line); deletions only give none.

    A line belongs to the last file named above it in its diff; a diff of any length is
    scanned in ranges of lines.
    """
    named = F.when(F.col("line").startswith("diff --git"), F.nullif(F.trim(F.regexp_extract("line", r"b/(.+)$", 1)), F.lit(""))).when(F.col("line").startswith("+++ b/"), F.trim(F.substr("line", F.lit(7))))
    at = scan.running(lines, ["diff"], ["line_no"], lasts={"file": named}).where(F.col("line").startswith("@@") & F.col("line").rlike(r"\+\d+") & (F.col("file") != ""))
    start = F.regexp_extract("line", r"\+(\d+)", 1).cast("long")
    count = F.regexp_extract("line", r"\+\d+,(\d+)", 1)
    length = F.when(count == "", F.lit(1)).otherwise(F.try_to_number(count, F.lit("999999999"))).cast("long")
    return at.select("diff", "file", start.alias("start_line"), (start + length - 1).alias("end_line"), length.alias("n")).where("n > 0").drop("n")


def parse_diagnostics(lines: DataFrame) -> DataFrame:
    """file, line, col, severity, code, message of a compiler's log lines (line); others drop out."""
    pattern = r"^(.+?):(\d+):(\d+)\s-\s(error|warning|info)\sTS(\d+):\s(.+)$"
    part = lambda k: F.regexp_extract("line", pattern, k)
    return lines.where(F.col("line").rlike(pattern)).select(
        part(1).alias("file"), part(2).cast("int").alias("at"), part(3).cast("int").alias("col"), part(4).alias("severity"), part(5).alias("code"), F.trim(part(6)).alias("message")
    ).withColumnRenamed("at", "line")


def touched_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """file, name: symbols that share a line with a hunk. The file is the join's key, lines are its rest."""
    h = hunks.select("file", "start_line", "end_line").distinct()
    overlap = (F.col("line_start") <= F.col("end_line")) & (F.col("line_end") >= F.col("start_line"))
    return symbols.join(h, "file").where(overlap).select("file", "name").distinct()


def coupling_impact(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """file_a, file_b, support, confidence of pairs with exactly one side among files (file)."""
    changed = files.select("file").distinct()
    a = pairs.join(changed.withColumnRenamed("file", "file_a"), "file_a", "left_semi").join(changed.withColumnRenamed("file", "file_b"), "file_b", "left_anti")
    b = pairs.join(changed.withColumnRenamed("file", "file_b"), "file_b", "left_semi").join(changed.withColumnRenamed("file", "file_a"), "file_a", "left_anti")
    return a.unionByName(b)


def risk_level(score: Column) -> Column:
    return F.when(score > 80, "critical").when(score > 60, "high").when(score > 40, "medium").when(score > 10, "low").otherwise("negligible")


def diff_risk(touched_scores: DataFrame, impact: DataFrame) -> DataFrame:
    """max_blast, coupling, score, level: one row from touched symbols' scores and impacted pairs' confidence."""
    blast = touched_scores.agg(F.greatest(F.lit(0.0), F.coalesce(F.max("score"), F.lit(0.0))).alias("max_blast"))
    coupled = impact.agg(F.coalesce(F.round(F.sum("confidence"), 6), F.lit(0.0)).alias("coupling"))
    raw = F.least(F.lit(100.0), F.col("max_blast") * 5 + F.col("coupling") * 10 * 2)
    return blast.join(coupled).select("max_blast", "coupling", half_up(raw).cast("long").alias("score"), risk_level(raw).alias("level"))


def gate_check(violations: int | Column, dead: int | Column, blast: float | Column, counts: DataFrame, most_violations: int = 132, most_dead: int = 240, most_blast: float = 58.0) -> DataFrame:
    """breaches, passed from one row of counts: the limits that are exceeded."""
    checks = [("violations", violations, most_violations), ("dead_code", dead, most_dead), ("blast_radius", blast, most_blast)]
    named = F.filter(F.array(*(F.when(F.col(v) > limit, F.lit(n)) if isinstance(v, str) else F.when(F.lit(v) > limit, F.lit(n)) for n, v, limit in checks)), lambda x: x.isNotNull())
    return counts.select(named.alias("breaches")).withColumn("passed", F.size("breaches") == 0)
