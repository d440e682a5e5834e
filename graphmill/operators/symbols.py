"""Symbols: extraction, resolution, dead code and its confirmation by diagnostics."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.sources import versions

# Fixed value: paths of test files.
TEST_PATH = r"\.test\.[jt]sx?$|\.spec\.[jt]sx?$|(^|/)test/|(^|/)__tests__/"
# Fixed value: the code of a declared but unused name.
UNUSED = "6133"


def dead_code(symbols: DataFrame, callees: DataFrame, boundary_files: DataFrame) -> DataFrame:
    """name, file, line_start, confidence of symbols that nothing seems to use.

    callees (name): a caller is found by name alone; boundary_files (file): of http
    or persistence roles. Exported symbols, entry points, tests, types, members and
    dependencies' symbols don't count.
    """
    alone = symbols.join(callees.select("name").distinct(), "name", "left_anti").join(boundary_files.select("file").distinct(), "file", "left_anti")
    plain = (
        ~F.col("is_exported")
        & ~F.col("is_entry_point")
        & ~F.col("file").rlike(TEST_PATH)
        & ~F.col("kind").isin("type_alias", "interface")
        & ~F.col("file").contains("node_modules/")
        & F.col("parent").isNull()
    )
    return alone.where(plain).select("name", "file", "line_start", F.lit(1.0).alias("confidence"))


def fuse_diagnostics(dead: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """dead with confidence 0.95 and the first message where a diagnostic (file, line, code, message) confirms it."""
    unused = diagnostics.where(F.col("code") == UNUSED).groupBy("file", F.col("line").alias("line_start")).agg(F.min("message").alias("message"))
    return dead.join(unused, ["file", "line_start"], "left").select("name", "file", "line_start", F.when(F.col("message").isNotNull(), 0.95).otherwise(F.col("confidence")).alias("confidence"), "message")


def lookup(symbols: DataFrame, asked: DataFrame) -> DataFrame:
    """q, file, line_start, name: the first symbol that each question (q, name, file) means.

    Its file is the one asked for or ends with a slash and that; a null file fits all.
    Of the symbols (file, line_start, name) of a name that fit, the first by file, then
    line, is taken; a question that none fits has no row.
    """
    parts = F.split("file", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    # a symbol is listed under all that fits its file, so a name's questions and symbols make no pairs
    listed = symbols.select("name", F.explode(F.array_append(F.coalesce(ends, F.array().cast("array<string>")), F.lit(None).cast("string"))).alias("wanted"), F.struct("file", "line_start", "name").alias("first"))
    best = listed.groupBy("name", "wanted").agg(F.min("first").alias("first"))
    named = asked.select("q", F.col("name").alias("named"), F.col("file").alias("asked"))
    hit = named.join(best, (F.col("named") == F.col("name")) & F.col("asked").eqNullSafe(F.col("wanted")))
    return hit.groupBy("q").agg(F.min("first").alias("first")).select("q", "first.*")


def symbols_by_kind(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def resolve(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """refs (ref, file, name) with target_file: a symbol of that name in an imported file, else the first in another file, else in its own.

    symbols: name, file; imports: file, target.
    """
    asked = refs.select("ref", "file", "name").distinct()
    best = first_target(asked, symbols.select("name", F.col("file").alias("at")), imports.select("file", F.col("target").alias("at")))
    order = F.when(F.col("near").isNotNull(), F.col("near")).when(F.col("other").isNotNull(), F.col("other")).otherwise(F.col("own"))
    return best.select("ref", "file", "name", order.alias("target_file"))


def first_target(asked: DataFrame, known: DataFrame, reachable: DataFrame) -> DataFrame:
    """asked (file, name, ...) with near, other, own: the first file that knows the name among those the file reaches, among all others, and the file itself if it does; else null.

    known: name, at; reachable: file, at. A name that many files know costs two rows, not a row for each of them.
    """
    known = known.distinct()
    pairs = asked.select("file", "name").distinct()
    near = pairs.join(reachable.distinct(), "file").join(known, ["name", "at"]).groupBy("file", "name").agg(F.min("at").alias("near"))
    least = known.groupBy("name").agg(F.min("at").alias("least"))
    second = known.join(least, "name").where("at > least").groupBy("name").agg(F.min("at").alias("second"))
    firsts = least.join(second, "name", "left")
    own = known.select("name", F.col("at").alias("file"), F.col("at").alias("own"))
    placed = asked.join(near, ["file", "name"], "left").join(firsts, "name", "left").join(own, ["name", "file"], "left")
    other = F.when(F.col("least") == F.col("file"), F.col("second")).otherwise(F.col("least"))
    return placed.withColumn("other", other).drop("least", "second")


def merge_enrichment(base: DataFrame, enriched: DataFrame) -> DataFrame:
    """Symbols of both, by file, name, kind and first line: flags of either, the first line end known."""
    every = base.unionByName(enriched)
    return every.groupBy("file", "name", "kind", "line_start").agg(
        F.max("line_end").alias("line_end"), F.bool_or("is_exported").alias("is_exported"), F.bool_or("is_entry_point").alias("is_entry_point"), F.max("parent").alias("parent")
    )


def by_content(files: DataFrame, extract: Callable[[DataFrame], DataFrame], root: str) -> tuple[DataFrame, int]:
    """(what extract gives for files (path, content), how many contents it was asked for): each content once, ever.

    extract sees files whose path is a digest and the ending, and gives rows with a column
    file; what it gave is kept at root by that digest. Copies share it, files that didn't
    change are looked up. Null contents give nothing.
    """
    ending = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    keyed = files.select("path", "content", F.sha2(F.concat(ending, F.lit("\n"), F.col("content")), 256).alias("hash"))
    named = F.concat("hash", ending)

    def compute(unseen: DataFrame) -> DataFrame:
        found = extract(unseen.select(named.alias("path"), "content"))
        each = found.groupBy("file").agg(F.collect_list(F.struct(*(c for c in found.columns if c != "file"))).alias("found"))
        return unseen.select("hash", named.alias("file")).join(each, "file", "left").select("hash", "found")

    out, asked = versions.memoized(keyed, root, "hash", compute)
    return out.select(F.col("path").alias("file"), F.inline("found")), asked


SYMBOL_SCHEMA = "file string, name string, kind string, line_start int, line_end int, is_exported boolean, parent string"
EDGE_SCHEMA = "file string, source string, target string, edge_type string, line int"


def _python_symbols(file: str, content: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return
    waiting = [(node, None) for node in tree.body]
    while waiting:
        node, parent = waiting.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if parent else "function"
            yield file, node.name, kind, node.lineno, node.end_lineno, parent is None and not node.name.startswith("_"), parent
            if isinstance(node, ast.ClassDef):
                waiting += [(child, node.name) for child in node.body]
        elif parent is None and isinstance(node, ast.Assign):
            for target in node.targets:
                if isinstance(target, ast.Name) and target.id.isupper():
                    yield file, target.id, "constant", node.lineno, node.end_lineno, not target.id.startswith("_"), None


def _python_edges(file: str, content: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return
    waiting: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while waiting:
        node, inside = waiting.pop()
        if isinstance(node, ast.ClassDef):
            for base in node.bases:
                if isinstance(base, ast.Name):
                    yield file, node.name, base.id, "extends", node.lineno
        if isinstance(node, ast.Call) and inside:
            called = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if called and called != inside:
                yield file, inside, called, "calls", node.lineno
        named = isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)
        waiting += [(child, node.name if named else inside) for child in ast.iter_child_nodes(node)]


def _each(files: DataFrame, read, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for file, content in zip(batch["path"], batch["content"], strict=True) if content for r in read(file, content)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python files (path, content), lines from 1; files that don't parse have none."""
    return _each(files.where(F.col("path").rlike(r"\.pyi?$")), _python_symbols, SYMBOL_SCHEMA)


def python_edges(files: DataFrame) -> DataFrame:
    """Raw references of Python files: what each function or class calls or extends, by name."""
    return _each(files.where(F.col("path").rlike(r"\.pyi?$")), _python_edges, EDGE_SCHEMA)


def _python_imports(file: str, content: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return
    found = [node for node in ast.walk(tree) if isinstance(node, ast.Import | ast.ImportFrom)]
    for n, node in enumerate(sorted(found, key=lambda node: (node.lineno, node.col_offset))):
        whole = isinstance(node, ast.Import)
        for alias in node.names:
            module = alias.name if whole else "." * node.level + (node.module or "")
            local = alias.asname or (alias.name.split(".")[0] if whole else alias.name)
            yield file, n, node.lineno, module, "*" if whole else alias.name, local, ast.get_source_segment(content, node)


def python_imports(files: DataFrame) -> DataFrame:
    """source, ord, line, module, imported, local, raw: a row for each name that a Python file's imports bind; a whole module is `*`."""
    return _each(files.where(F.col("path").rlike(r"\.pyi?$")), _python_imports, "source string, ord int, line int, module string, imported string, local string, raw string")


def select_symbols(symbols: DataFrame, calls: DataFrame, most: int = 200) -> DataFrame:
    """file, name, rank of the symbols (file, name, is_entry_point, is_exported) to show: entry points, then exported, then most called ones; calls: file, name."""
    counted = symbols.join(calls.groupBy("file", "name").agg(F.count(F.lit(1)).alias("incoming")), ["file", "name"], "left").na.fill(0, ["incoming"])
    order = [F.desc("is_entry_point"), F.desc("is_exported"), F.desc("incoming"), F.asc("file"), F.asc("name")]
    first = counted.orderBy(*order).limit(most)
    return first.select("file", "name", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def symbol_candidates(symbols: DataFrame, enriched: DataFrame) -> DataFrame:
    """Symbols (file, name, ...) whose file has no enrichment (file) yet."""
    return symbols.join(enriched.select("file").distinct(), "file", "left_anti")


def sort_enriched(symbols: DataFrame, top: int | None = None) -> DataFrame:
    """symbols by file, first line and name; the first `top` of them, or all."""
    ordered = symbols.orderBy("file", "line_start", "name")
    return ordered if top is None else ordered.limit(top)
