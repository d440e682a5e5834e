"""Imports, chunks, retrieval and text shaping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.columns import dirname, extension, fold_dots

# Import patterns by extension group; the module is the first group unless noted.
JS_IMPORTS = (
    r"import\s+\w+\s+from\s+['\"]([^'\"]+)['\"]",
    r"import\s+\{[^}]+\}\s+from\s+['\"]([^'\"]+)['\"]",
    r"import\s+\*\s+as\s+\w+\s+from\s+['\"]([^'\"]+)['\"]",
    r"import\s+['\"]([^'\"]+)['\"]",
    r"(?:const|let|var)\s+(?:\w+|\{[^}]+\})\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"export\s+\{[^}]*\}\s+from\s+['\"]([^'\"]+)['\"]",
    r"export\s+\*\s+from\s+['\"]([^'\"]+)['\"]",
)
# Our own patterns of imports and exports of types alone.
JS_TYPE_IMPORTS = (r"import\s+type\s+[\w${}*,\s]+?\s+from\s+['\"]([^'\"]+)['\"]", r"export\s+type\s+\{[^}]*\}\s+from\s+['\"]([^'\"]+)['\"]")
PYTHON_IMPORTS = (r"from\s+([\w.]+)\s+import\s+.+", r"(?m)^import\s+([\w.]+)")
GO_IMPORTS = (r"import\s+(?:[\w.]+\s+)?\"([^\"]+)\"",)
JAVA_IMPORTS = (r"import\s+(?:static\s+)?([a-zA-Z_][\w.]*(?:\.\*)?)\s*;",)
RUST_IMPORTS = (r"use\s+([\w:]+(?:::\{[^}]+\})?)\s*;", r"mod\s+(\w+)\s*;")
IMPORTS = {
    "javascript": (r"^\.(js|jsx|ts|tsx|mjs|cjs|vue|svelte)$", JS_IMPORTS),
    "python": (r"^\.py$", PYTHON_IMPORTS),
    "go": (r"^\.go$", GO_IMPORTS),
    "java": (r"^\.(java|kt|kts)$", JAVA_IMPORTS),
    "rust": (r"^\.rs$", RUST_IMPORTS),
}
# Endings tried for a specifier, in order.
JS_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte")


def imports_regex(files: DataFrame) -> DataFrame:
    """source, language, module, ord, type_only of the import statements in files (path, content)."""
    found = []
    all_of = lambda patterns: F.concat(*(F.regexp_extract_all("content", F.lit(p), 1) for p in patterns))
    for language, (endings, patterns) in IMPORTS.items():
        own = files.where(extension(F.col("path")).rlike(endings))
        every = all_of(patterns)
        n = F.size(every)
        if language == "javascript":
            every = F.concat(every, all_of(JS_TYPE_IMPORTS))
        found.append(own.select(F.col("path").alias("source"), F.lit(language).alias("language"), n.alias("n"), F.posexplode(every).alias("ord", "module")).withColumn("type_only", F.col("ord") >= F.col("n")).drop("n"))
    # a parenthesised Go list names several packages
    block = files.where(extension(F.col("path")) == ".go").select(
        F.col("path").alias("source"), F.lit("go").alias("language"), F.posexplode(F.regexp_extract_all(F.concat_ws("\n", F.regexp_extract_all("content", F.lit(r"(?s)import\s*\((.*?)\)"), 1)), F.lit(r"\"([^\"]+)\""), 1)).alias("ord", "module")
    )
    out = block.withColumn("type_only", F.lit(False))
    for part in found:
        out = out.unionByName(part)
    return out.where("module <> ''")


def _candidates(language: str) -> Column:
    """Ordered paths that a module may mean, from source and module; JavaScript's without their endings."""
    folder, module = dirname(F.col("source")), F.col("module")
    if language == "python":
        path = F.replace(module, F.lit("."), F.lit("/"))
        beside = fold_dots(F.concat_ws("/", folder, path))
        return F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")), F.concat(beside, F.lit(".py")), F.concat(beside, F.lit("/__init__.py")))
    bare = F.regexp_replace(module, r"^(@/|~/|#)", "")
    unscoped = F.regexp_replace(module, r"^@[^/]+/", "")
    relative = fold_dots(F.when(module.startswith("/"), module).otherwise(F.concat_ws("/", folder, module)))
    bases = (
        F.when(module.rlike(r"^[./]"), F.array(relative))
        .when(module.rlike(r"^(@/|~/|#)"), F.array(fold_dots(F.concat(F.lit("src/"), bare)), fold_dots(bare)))
        .when(module.rlike(r"^@[^/]+/"), F.array(*(fold_dots(F.concat(F.lit(r), unscoped)) for r in ("packages/", "src/", ""))))
        .otherwise(F.array().cast("array<string>"))
    )
    return bases


def _endings(language: str) -> tuple[str, ...]:
    """What is tried after each of _candidates(), in order."""
    return ("",) if language == "python" else ("", *JS_ENDINGS, *(f"/index{e}" for e in JS_ENDINGS))


def resolve_imports(imports: DataFrame, files: DataFrame, go_module: str | None = None) -> DataFrame:
    """source, target, module, external, ord, type_only: the first candidate path that exists; the package of those without one."""
    known = files.select(F.col("path").alias("target")).distinct()
    parts = []
    for language in ("javascript", "python"):
        own = imports.where(F.col("language") == language)
        # known paths are listed without the endings they have, not imports with all that they may have
        cuts = [F.when(F.col("target").endswith(e), F.struct(F.substring(F.col("target"), F.lit(1), F.length("target") - len(e)).alias("base"), F.lit(i).alias("e"))) for i, e in enumerate(_endings(language))]
        listed = known.select("target", F.inline(F.filter(F.array(*cuts), lambda c: c.isNotNull())))
        tried = own.select("source", "language", "module", "ord", F.posexplode(_candidates(language)).alias("k", "base")).join(listed, "base")
        parts.append(tried.groupBy("source", "language", "module", "ord").agg(F.min_by("target", F.struct("k", "e")).alias("target")))
    hit = parts[0].unionByName(parts[1])
    joined = imports.join(hit, ["source", "language", "module", "ord"], "left")
    package = F.when(F.col("module").startswith("@"), F.substring_index("module", "/", 2)).otherwise(F.substring_index("module", "/", 1))
    inside = F.col("module").startswith(go_module + "/") if go_module else F.lit(False)
    local = F.when((F.col("language") == "go") & inside, F.substr("module", F.lit(len(go_module or "") + 2)))
    first = F.substring_index("module", "/", 1)
    external = (
        F.when(F.col("target").isNotNull() | local.isNotNull(), None)
        .when((F.col("language") == "javascript") & ~F.col("module").startswith("."), package)
        .when((F.col("language") == "go") & ~first.contains("."), F.concat(F.lit("stdlib:"), F.col("module")))
        .when(F.col("language") == "go", F.concat(F.lit("external:"), F.col("module")))
    )
    return joined.select("source", F.coalesce("target", local).alias("target"), "module", external.alias("external"), "ord", "type_only")


def chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, chunk_id, content, symbol, line_start, line_end: one per symbol (file, name, line_start, line_end), else the whole file."""
    lines = F.split("content", "\n")
    joined = files.select("path", "content").join(symbols.select(F.col("file").alias("path"), F.col("name").alias("symbol"), "line_start", "line_end"), "path", "left")
    first = F.greatest(F.col("line_start"), F.lit(1))
    part = F.array_join(F.slice(lines, first, F.greatest(F.least(F.col("line_end"), F.size(lines)) - first + 1, F.lit(0))), "\n")
    whole = F.col("symbol").isNull()
    return joined.select(
        "path",
        F.when(whole, F.concat("path", F.lit("::__file__"))).otherwise(F.concat_ws("::", "path", "symbol", F.col("line_start").cast("string"))).alias("chunk_id"),
        F.when(whole, F.col("content")).otherwise(part).alias("content"),
        "symbol",
        F.when(whole, 1).otherwise(F.col("line_start")).alias("line_start"),
        F.when(whole, F.size(lines)).otherwise(F.col("line_end")).alias("line_end"),
    )


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Rows of new, and those of old whose key isn't in new; of rows that repeat a key in new, the last by the column order.

    Without an order the greatest row, by its columns, is taken. order isn't a column of the result.
    """
    last = _one_of(new, key, order, F.max)
    return last.unionByName(old.join(last.select(*key), key, "left_anti"))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Rows of old, and those of new whose key isn't in old; of rows that repeat a key, the first by the column order."""
    return old.unionByName(_one_of(new, key, order, F.min).join(old.select(*key), key, "left_anti"))


def _one_of(rows: DataFrame, key: list[str], order: str | None, pick: Callable[[Column], Column]) -> DataFrame:
    names = [c for c in rows.columns if c != order]
    rest = [c for c in names if c not in key]
    best = rows.groupBy(*key).agg(pick(F.struct(*([order] if order else []), *rest, F.lit(0).alias("_graphmill_none"))).alias("best"))
    return best.select(*(c if c in key else F.col(f"best.{c}") for c in names))


#: Terms are runs of letters and digits, lower-cased.
TERM = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def inverted_index(docs: DataFrame) -> DataFrame:
    """term, id, tf, length of docs (id, content).

    Texts are dealt by id, so their terms are counted where they are and stay dealt by id.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = docs.select("id", "content").repartition(parts, "id").select("id", terms(F.coalesce("content", F.lit(""))).alias("t"))
    return listed.select("id", F.size("t").cast("long").alias("length"), F.explode("t").alias("term")).groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """q, term, wanted: distinct terms of queries (q, content) and their number."""
    listed = queries.select("q", F.array_distinct(terms(F.coalesce("content", F.lit("")))).alias("t"))
    return listed.select("q", F.size("t").alias("wanted"), F.explode("t").alias("term"))


def search_text(index: DataFrame, queries: DataFrame) -> DataFrame:
    """q, id of documents that hold every term of a query. Queries are a parameter: their terms are broadcast."""
    hits = index.select("term", "id").join(F.broadcast(query_terms(queries)), "term")
    return hits.groupBy("q", "id", "wanted").agg(F.count(F.lit(1)).alias("n")).where("n = wanted").select("q", "id")


def bm25(index: DataFrame, queries: DataFrame, n_docs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """q, id, score, rounded to six decimals; n_docs: one row of n and avg_length.

    Queries are a parameter: their terms are broadcast, the index stays where it is.
    """
    asked = F.broadcast(query_terms(queries).select("q", "term"))
    df = index.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = index.join(F.broadcast(df.join(asked, "term")), "term").join(F.broadcast(n_docs))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return hits.groupBy("q", "id").agg(F.round(F.sum(one), 6).alias("score"))


def top_per_query(scored: DataFrame, top: int = 20) -> DataFrame:
    """q, id, score, rank (from 0) of the best rows of each query."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    # the plain number is compared, so that tasks pass on their own best rows only
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumn("rank", F.col("rank") - 1)


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """q, id, fused: reciprocal rank fusion of lists (q, list, rank from 0, id), rounded to nine decimals."""
    return lists.groupBy("q", "id").agg(F.round(F.sum(1.0 / (k + 1 + F.col("rank"))), 9).alias("fused"))


def resolve_suffix(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted (name) with path: the only known path (path) that ends with the name at a segment border; null for none or several.

    Every known path is listed by its suffixes, so this is an equi join.
    """
    parts = F.split("path", "/")
    suffixes = known.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("name"))
    single = suffixes.join(wanted.select("name").distinct(), "name").groupBy("name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path")).where("n = 1")
    return wanted.join(single.select("name", "path"), "name", "left")


def budget_pack(ranked: DataFrame, budget: int) -> DataFrame:
    """q, id, rank, used: the longest prefix of ranked (q, id, rank, size) within the budget."""
    used = F.sum("size").over(Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", used).where(F.col("used") <= budget).select("q", "id", "rank", "used")


def packed_chunks(ranked: DataFrame, budget: int) -> DataFrame:
    """q, context: headed chunks in order of rank until the next one would exceed the budget; queries whose first chunk does have none.

    ranked: q, rank, path, symbol, line_start, line_end, content. Headers and blank
    lines count too. A context is as long as the budget at most.
    """
    header = F.concat(F.lit("## "), F.col("path"), F.when(F.col("symbol").isNotNull(), F.concat(F.lit(" ("), F.col("symbol"), F.lit(")"))).otherwise(""), F.format_string(" [L%d-%d]\n", "line_start", "line_end"))
    blocks = ranked.select("q", "rank", F.concat(header, "content", F.lit("\n\n")).alias("block"))
    used = F.sum(F.char_length("block")).over(Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    fits = blocks.withColumn("used", used).where(F.col("used") <= budget)
    listed = fits.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "block"))).alias("blocks"))
    return listed.select("q", F.array_join(F.transform("blocks", lambda b: b["block"]), "").alias("context"))


def retrieve(found: DataFrame, near: DataFrame, chunks: DataFrame, budget: int, fallback: DataFrame | None = None) -> DataFrame:
    """q, context: the search's chunks, those also near the entry points first, packed into the budget.

    found: q, id, rank from 0 of a search; near: id, rank from 0 of a graph walk's
    files; both lists are fused. Of the fused order only what the search found has
    content. fallback: q, context for queries that get none.
    """
    asked = found.select("q").distinct()
    lists = found.select("q", F.lit(0).alias("list"), "rank", "id").unionByName(asked.join(near.select(F.lit(1).alias("list"), "rank", "id").join(found.select("q", "id").distinct(), "id"), "q").select("q", "list", "rank", "id"))
    order = Window.partitionBy("q").orderBy(F.desc("fused"), "id")
    ranked = rrf(lists).withColumn("rank", F.row_number().over(order)).join(chunks.withColumnRenamed("chunk_id", "id"), "id")
    out = packed_chunks(ranked, budget)
    return out if fallback is None else out.unionByName(fallback.join(out, "q", "left_anti").select("q", "context"))


# Shares and sizes of a prompt's file context.
FILE_SHARE, SECTION_SHARE, LEAST_FILE, MOST_FILES, LEAST_REMAINING = 0.6, 0.65, 500, 6, 1200


def context_pack(files: DataFrame, remaining: int) -> DataFrame:
    """rank, path, block of ranked files (path, content, rank from 1), each cut, while they fit into their share of the remaining characters."""
    if remaining <= LEAST_REMAINING:
        return files.select("rank", "path", F.col("content").alias("block")).limit(0)
    n = files.where(F.trim("content") != "").agg(F.least(F.count(F.lit(1)), F.lit(MOST_FILES)).alias("n"))
    each = F.greatest(F.lit(LEAST_FILE), F.floor(remaining * FILE_SHARE / F.col("n"))).cast("int")
    cut = files.where(F.trim("content") != "").join(F.broadcast(n)).withColumn("text", F.substr("content", F.lit(1), each))
    blocks = cut.select("rank", "path", F.concat(F.lit("### "), "path", F.lit("\n```\n"), "text", F.lit("\n```\n")).alias("block"))
    used = F.sum(F.char_length("block")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    # a block has a character at least: only so many of the first can fit
    first = blocks.orderBy("rank").limit(remaining)
    return first.withColumn("used", used).where(F.col("used") <= remaining * SECTION_SHARE).select("rank", "path", "block")


def compact_text(content: Column, most: int = 5000) -> Column:
    """Lines without trailing space, runs of blank lines as one, leading ones gone, cut at `most` characters."""
    trimmed = F.transform(F.split(content, "\n"), lambda line: F.regexp_replace(line, r"\s+$", ""))
    kept = F.filter(F.zip_with(trimmed, F.concat(F.array(F.lit("")), trimmed), lambda a, b: F.when(a.isNotNull() & ((a != "") | (b != "")), a)), lambda x: x.isNotNull())
    return F.substring(F.array_join(kept, "\n"), 1, most)


# What a declaration-like line looks like.
SKELETON = (
    r"^import ", r"^export import ", r"^export\s+\{", r"^module\.exports\s*=", r"^@", r"^(export\s+)?(async\s+)?function\s+", r"^(export\s+)?(abstract\s+)?class\s+",
    r"^(export\s+)?interface\s+", r"^(export\s+)?type\s+", r"^(export\s+)?enum\s+", r"^(export\s+)?const\s+[A-Za-z_$][\w$]*\s*=\s*(async\s*)?\([^)]*\)\s*=>",
    r"^(public|private|protected|static|async|get|set|\*)*\s*[A-Za-z_$][\w$]*\s*\([^)]*\)\s*\{?$", r"\b(app|router)\.(get|post|put|patch|delete|use)\(",
)


def skeletonize(content: Column, most_lines: int = 48, fallback: int = 600) -> Column:
    """Declaration-like lines without opening braces; the compacted text if there are none."""
    plain = F.transform(F.split(content, "\n"), lambda line: F.trim(F.regexp_replace(line, r"\s+", " ")))
    kept = F.filter(plain, lambda line: line.rlike("|".join(f"(?:{p})" for p in SKELETON)))
    bare = F.transform(F.slice(kept, 1, most_lines), lambda line: F.regexp_replace(line, r"\s*\{\s*$", ""))
    return F.when(F.size(kept) > 0, F.array_join(bare, "\n")).otherwise(compact_text(content, fallback))


def state_hash(edges: DataFrame, query: str, kind: str, provider: str = "", version: str = "") -> DataFrame:
    """hash: 16 hexadecimal digits of the question and the graph, of sorted edge hashes, so that rows stay small."""
    each = F.sha2(F.concat_ws("->", F.col("s").cast("string"), F.col("t").cast("string")), 256)
    # a commutative digest: sums of 64-bit parts need no global sort
    parts = [F.sum(F.conv(F.substring(each, i, 8), 16, 10).cast("long")).alias(f"p{i}") for i in (1, 9, 17, 25)]
    head = [F.lit(x) for x in (query, kind, provider, version)]
    summed = edges.select("s", "t").distinct().agg(F.count(F.lit(1)).alias("n"), *parts)
    tail = [F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("n", "p1", "p9", "p17", "p25")]
    return summed.select(F.left(F.sha2(F.concat_ws("|", *head, *tail), 256), F.lit(16)).alias("hash"))


def prisma_entities(files: DataFrame) -> DataFrame:
    """path, entity, field, type, is_relation, relation, is_primary, is_nullable of model blocks in *.prisma files."""
    blocks = files.where(F.col("path").endswith(".prisma")).select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)model\s+\w+\s+\{.*?\}"), 0)).alias("block"))
    name = F.regexp_extract("block", r"model\s+(\w+)", 1)
    body = F.regexp_extract("block", r"(?s)\{(.*)\}", 1)
    lines = blocks.select("path", name.alias("entity"), F.posexplode(F.transform(F.split(body, "\n"), lambda x: F.trim(x))).alias("ord", "line"))
    pattern = r"^(\w+)\s+(\w+)(\[\])?(\?)?(\s+@.+)?$"
    part = lambda k: F.regexp_extract("line", pattern, k)
    plain = part(2).isin("String", "Int", "Boolean", "DateTime", "Float", "Json", "Bytes", "Decimal")
    many = part(3) == "[]"
    return lines.where(~F.col("line").startswith("//") & F.col("line").rlike(pattern)).select(
        "path", "entity", "ord", part(1).alias("field"), F.concat(part(2), F.when(plain, part(3)).otherwise("")).alias("type"), (~plain).alias("is_relation"),
        F.when(~plain, F.when(many, "one-to-many").otherwise("many-to-one")).alias("relation"), (plain & F.col("line").contains("@id")).alias("is_primary"), (plain & (part(4) == "?")).alias("is_nullable"),
    )
