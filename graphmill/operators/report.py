"""Reports over bundles of tables: summary rows, and text renderings of their top rows.

A bundle is a dict of lazy DataFrames; asking for one plans only what it needs.
Renderers collect at most `top` rows of each table.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories that rankings don't steer to.
NOT_STEERING = ("test", "e2e", "fixture", "example", "archive", "entry")


def steering(df: DataFrame, categories: DataFrame, key: str = "node") -> DataFrame:
    """df without rows of tests, fixtures, examples, archives and entry points; unclassified rows stay."""
    return df.join(categories.where(F.col("category").isin(*NOT_STEERING)).select(key), key, "left_anti")


def completeness(files: DataFrame, nodes: DataFrame, edges: DataFrame, scope: str = "fullWorkspace") -> DataFrame:
    """scope, files, nodes, edges, coverage, sampled: one row."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    whole = scope == "fullWorkspace"
    counted = one(files, "files").join(one(nodes, "nodes")).join(one(edges, "edges"))
    return counted.select(F.lit(scope).alias("scope"), "files", "nodes", "edges", F.lit("complete" if whole else "sampled").alias("coverage"), F.lit(not whole).alias("sampled"))


def signal(df: DataFrame, id: str, family: str, kind: str, basis: str = "fullWorkspace") -> DataFrame:
    """id, family, kind, basis, data: the rows of df as JSON."""
    return df.select(F.lit(id).alias("id"), F.lit(family).alias("family"), F.lit(kind).alias("kind"), F.lit(basis).alias("basis"), F.to_json(F.struct("*")).alias("data"))


def summary(signals: Mapping[str, DataFrame]) -> DataFrame:
    """All signals by name; a name can't come twice, nor be empty."""
    if "" in signals:
        raise ValueError("a signal needs a name")
    out = None
    for df in signals.values():
        out = df if out is None else out.unionByName(df)
    return out


def visible_nodes(nodes: DataFrame, marked: DataFrame, hide_tests: bool = False, circular_only: bool = False, kind: str | None = None) -> DataFrame:
    """nodes (node, category) that a view shows; marked: s, t, circular."""
    shown = nodes
    if hide_tests:
        shown = shown.where(F.col("category") != "test")
    if kind is not None:
        shown = shown.where(F.col("category") == kind)
    if circular_only:
        on_cycle = marked.where("circular").select(F.explode(F.array("s", "t")).alias("node")).distinct()
        shown = shown.join(on_cycle, "node", "left_semi")
    return shown


def dead_overlay(nodes: DataFrame, dead: DataFrame) -> DataFrame:
    """nodes (node, file) with is_dead: whether a dead symbol (file) lies in the file."""
    files = dead.select("file").distinct().withColumn("is_dead", F.lit(True))
    return nodes.join(files, "file", "left").na.fill(False, ["is_dead"])


def rank_symbols(symbols: DataFrame, calls: DataFrame, key: list[str] | None = None, top: int = 8) -> DataFrame:
    """name, file, incoming: the most called symbols (file, name, is_entry_point, is_exported); calls hold the called symbol's key, file and name unless given."""
    on = key or ["file", "name"]
    counted = symbols.join(calls.groupBy(*on).agg(F.count(F.lit(1)).alias("incoming")), on, "left").na.fill(0, ["incoming"])
    return counted.orderBy(F.desc("incoming"), F.desc("is_entry_point"), F.desc("is_exported"), "name", "file").limit(top).select("name", "file", "incoming")


def symbol_graph(edges: DataFrame) -> DataFrame:
    """source, target, label of symbol edges (source_file, source, target_file, target, edge_type), each once."""
    label = F.when(F.col("edge_type") == "uses_type", "uses").otherwise(F.col("edge_type"))
    return edges.select(F.concat_ws("#", "source_file", "source").alias("source"), F.concat_ws("#", "target_file", "target").alias("target"), label.alias("label")).distinct()


def selected_symbol_graph(symbols: DataFrame, edges: DataFrame, categories: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the symbols to show: id, label, type, weight, and source, target, label between them.

    symbols: file, name, parent, is_entry_point, is_exported; edges as for symbol_graph();
    categories: path, category. Entry points first, then exported, then most called symbols.
    A member's id and label carry its parent; an end that names several symbols of its
    file is the first of them by id. Edges whose ends aren't both shown go.
    """
    member = F.when(F.col("parent").isNotNull(), F.concat("parent", F.lit("."), "name")).otherwise(F.col("name"))
    known = symbols.withColumn("label", member).withColumn("id", F.concat_ws("#", "file", "label"))
    ids = known.groupBy("file", "name").agg(F.min("id").alias("id"))
    end = lambda side: ids.select(F.col("file").alias(f"{side}_file"), F.col("name").alias(side), F.col("id").alias(f"{side}_id"))
    kind = F.when(F.col("edge_type").isin("calls", "extends", "implements"), F.col("edge_type")).otherwise("uses")
    placed = edges.join(end("source"), ["source_file", "source"]).join(end("target"), ["target_file", "target"]).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), kind.alias("label"))
    weights = placed.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("weight"))
    single = known.groupBy("id", "label", "file").agg(F.max("is_entry_point").alias("entry"), F.max("is_exported").alias("exported"))
    counted = single.join(weights, "id", "left").na.fill(0, ["weight"])
    shown = counted.orderBy(F.desc("entry"), F.desc("exported"), F.desc("weight"), "id").limit(most)
    nodes = shown.join(categories.select(F.col("path").alias("file"), "category"), "file", "left").select("id", "label", F.coalesce("category", F.lit("unknown")).alias("type"), "weight")
    ends = shown.select("id")
    return nodes, placed.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "label")


def sanitize_paths(text: Column, root: str) -> Column:
    """The text without the workspace's root."""
    bare = root.rstrip("/")
    return F.replace(F.replace(text, F.lit(bare + "/"), F.lit("")), F.lit(bare), F.lit("")) if bare else text


def _top(df: DataFrame, top: int | None) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df if top is None else df.limit(top)).toLocalIterator()]


def render_json(bundle: Mapping[str, DataFrame], top: int | None = 25) -> str:
    """The first rows of each table; None: all of them."""
    return json.dumps({name: _top(df, top) for name, df in bundle.items()}, default=str, ensure_ascii=False, indent=1)


def render_markdown(bundle: Mapping[str, DataFrame], top: int = 25, most_chars: int = 24_000) -> str:
    """A section with a table per DataFrame; whole sections are left out once the budget is used."""
    out, used = [], 0
    for name, df in bundle.items():
        lines = [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        lines += ["| " + " | ".join(str(row[c]) for c in df.columns) + " |" for row in _top(df, top)]
        section = "\n".join(lines) + "\n"
        if used + len(section) > most_chars:
            break
        out.append(section)
        used += len(section)
    return "\n".join(out)


def render_toon(bundle: Mapping[str, DataFrame], top: int = 25, most_chars: int = 24_000) -> str:
    """Compact rows: name[n]{columns}: and a line of values each."""
    out, used = [], 0
    for name, df in bundle.items():
        rows = _top(df, top)
        section = f"{name}[{len(rows)}]{{{','.join(df.columns)}}}:\n" + "".join("  " + ",".join("" if r[c] is None else str(r[c]) for c in df.columns) + "\n" for r in rows)
        if used + len(section) > most_chars:
            break
        out.append(section)
        used += len(section)
    return "".join(out)
