"""Commands over a workspace: python -m graphmill.cli COMMAND ROOT [options]. Exit 0: done, 1: a check failed, 2: wrong use."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators import report, sections
from graphmill.plans import briefing
from graphmill.plans.workspace import Workspace
from graphmill.sources import readers

COMMANDS = ("analyze", "check", "layer-violations", "impact", "risk", "seams", "flows", "dead-code", "coupling")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphmill")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("root")
    p.add_argument("--format", choices=("json", "toon", "markdown", "table"), default="json")
    p.add_argument("--tier", type=int, default=1)
    p.add_argument("--top", type=int, default=25)
    p.add_argument("--symbol")
    p.add_argument("--file")
    p.add_argument("--diff", help="a file with a unified diff")
    p.add_argument("--history", action="store_true", help="read the local repository's log")
    p.add_argument("--min-support", type=int, default=2)
    p.add_argument("--confidence", type=float, default=0.5)
    p.add_argument("--max-violations", type=int, default=132)
    p.add_argument("--max-dead-code", type=int, default=240)
    p.add_argument("--max-blast-radius", type=float, default=58)
    return p


def tables(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    w = Workspace.read(spark, a.root, a.history or a.command == "coupling")
    if a.command == "analyze":
        return w.bundle(a.tier)
    if a.command == "check":
        return {"check": w.check(a.max_violations, a.max_dead_code, a.max_blast_radius)}
    if a.command == "impact":
        return {"impact": w.impact(a.symbol, a.file).orderBy("hop", "node")}
    if a.command == "risk":
        return {"risk": w.risk(readers.diff_lines(spark, a.diff))}
    if a.command == "coupling":
        return {"coupling": w.coupling.where(F.col("support") >= a.min_support).orderBy(F.desc("support"), "file_a", "file_b")}
    if a.command == "dead-code":
        return {"dead_code": w.dead_code.where(F.col("confidence") >= a.confidence).orderBy("file", "line_start", "name")}
    name = a.command.replace("layer-violations", "violations")
    return {name: getattr(w, name)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
        if a.command == "impact" and not a.symbol or a.command == "risk" and not a.diff:
            raise SystemExit(2)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = spark or SparkSession.builder.appName("graphmill").getOrCreate()
    if a.command == "analyze" and a.format in sections.FORMATS:
        print(briefing.render(Workspace.read(spark, a.root, a.history), a.format, a.tier))
        return 0
    out = tables(spark, a)
    if a.format == "table":
        for df in out.values():
            print("\t".join(df.columns))
            for row in df.limit(a.top).collect():
                print("\t".join(map(str, row)))
    else:
        print({"json": report.render_json, "toon": report.render_toon, "markdown": report.render_markdown}[a.format](out, a.top))
    if a.command == "check":
        return 0 if out["check"].first()["passed"] else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
