"""Sources and sinks: file trees, logs, diffs, JSON lines and tours."""

from __future__ import annotations

import os
import sqlite3
import subprocess
import uuid
from collections.abc import Mapping
from contextlib import closing
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, NumericType, StringType, StructField, StructType

from graphmill.functions.columns import basename, extension, slashes
from graphmill.operators import scan
from graphmill.operators.classify import chain

# What a scan passes over, and what it takes.
IGNORED = (
    "node_modules", ".git", ".next", "__pycache__", ".pytest_cache", "dist", "build", ".cache", "coverage", ".venv", "venv", "env", ".env", ".DS_Store", "package-lock.json",
    "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "go.sum",
)
CODE_EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".pyi", ".json", ".yaml", ".yml", ".toml", ".html", ".css", ".scss", ".less", ".rs", ".go", ".java", ".kt", ".swift",
    ".c", ".cpp", ".h", ".hpp", ".sh", ".bash", ".zsh", ".sql", ".graphql", ".gql", ".vue", ".svelte", ".prisma",
)
PRIORITY_FILES = ("package.json", "pyproject.toml", "Cargo.toml", "go.mod", "README.md", "Dockerfile")
PREFERRED_ROOTS = ("src", "webview/src", "shared", "app", "lib", "server", "client", "packages/*/src")
LOW_SIGNAL = ("docs", "example", "examples", "fixture", "fixtures", "test", "tests", "__tests__", "bench", "benchmark", "benchmarks", "_legacy")
EXCLUDED_SEGMENTS = ("test-repos",)
ROOT_MARKERS = ("package.json", "pyproject.toml", "Cargo.toml", "go.mod", ".git")
COUPLED_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".cs")
COUPLED_EXCLUDED = ("node_modules/", ".git/", "dist/", "__pycache__/")


def scan_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, content of all files below root, relative; content null for more than most readers want (see read_text)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(root)
    start = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/*", "/")
    path = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    relative = F.substr(path, F.char_length(start) + 2)
    hidden = F.exists(F.split(relative, "/"), lambda s: s.isin(*IGNORED) | s.rlike(r"\.min\.js$|\.map$|\.chunk\."))
    return found.where(~hidden).select(relative.alias("path"), F.col("content").alias("bytes"), "length")


def read_text(files: DataFrame, most_chars: int = 100_000) -> DataFrame:
    """path, content of files (path, bytes) that are text: not empty, not too long, no NUL among the first 1024 characters."""
    text = files.select("path", F.try_validate_utf8(F.col("bytes").cast("string")).alias("content"))
    return text.where((F.col("content") != "") & (F.char_length("content") <= most_chars) & (F.instr(F.substring("content", 1, 1024), "\0") == 0))


def read_preview(paths: DataFrame, manifests: DataFrame) -> DataFrame:
    """path, content: manifests' content, empty for all other paths."""
    return paths.select("path").join(manifests.select("path", "content"), "path", "left").na.fill("", ["content"])


def glob_matches(path: Column, glob: str) -> Column:
    """`*` stands for anything."""
    import re

    return path.rlike("^" + ".*".join(re.escape(p) for p in glob.split("*")) + "$")


def is_code_file(path: Column) -> Column:
    return basename(path).isin(*PRIORITY_FILES) | extension(path).isin(*CODE_EXTENSIONS)


def is_excluded(path: Column) -> Column:
    return F.arrays_overlap(F.split(slashes(path), "/"), F.array(*map(F.lit, EXCLUDED_SEGMENTS)))


def path_priority(path: Column, interactive: bool = True, roots: tuple[str, ...] = PREFERRED_ROOTS) -> Column:
    """Lower comes first: -100 for priority files, 10 a preferred root, else 100; 100 more per low-signal segment, a quarter of it outside interactive scans."""
    plain = slashes(path)
    parts = F.split(plain, "/")
    fits = [
        ((F.size(parts) >= 4) & (F.get(parts, F.lit(0)) == "packages") & (F.get(parts, F.lit(2)) == "src") if "*" in root else (plain == root) | plain.startswith(root + "/"), 10 * i)
        for i, root in enumerate(roots)
    ]
    penalty = 100 * F.size(F.filter(parts, lambda s: s.isin(*LOW_SIGNAL)))
    return F.when(plain.isin(*PRIORITY_FILES), -100).otherwise(chain(fits, 100) + (penalty if interactive else F.floor(penalty / 4))).cast("int")


def scan_candidates(paths: DataFrame, most: int = 500, interactive: bool = True) -> DataFrame:
    """path, priority of the files to analyse, best first; the limit is the scan's own parameter."""
    plain = paths.select("path").distinct().where(~is_excluded(F.col("path")) & is_code_file(F.col("path")))
    ranked = plain.withColumn("priority", path_priority(F.col("path"), interactive))
    return ranked.orderBy("priority", "path").limit(most)


def dedupe_paths(paths: DataFrame, order: str) -> DataFrame:
    """path and the column order of paths' rows: each path where it comes first; sorted by order it is the listing without repeats."""
    return paths.groupBy("path").agg(F.min(order).alias(order))


def project_root(paths: DataFrame) -> DataFrame:
    """root: the first folder of a marker file, shallow first; empty for the top."""
    marked = paths.where(basename(F.col("path")).isin(*ROOT_MARKERS)).where(F.size(F.split("path", "/")) <= 2)
    at = F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1)
    return marked.agg(F.coalesce(F.min_by(at, F.struct(F.size(F.split("path", "/")), "path")), F.lit("")).alias("root"))


def file_tree(paths: DataFrame) -> DataFrame:
    """node, parent, depth, is_leaf: all prefixes of the paths, each once."""
    parts = paths.select(F.split("path", "/").alias("p"))
    each = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    node, parent = F.array_join(F.slice("p", 1, F.col("depth")), "/"), F.array_join(F.slice("p", 1, F.col("depth") - 1), "/")
    return each.select(node.alias("node"), parent.alias("parent"), "depth", (F.col("depth") == F.size("p")).alias("is_leaf")).groupBy("node", "parent", "depth").agg(F.bool_and("is_leaf").alias("is_leaf"))


def key_files(files: DataFrame, most_chars: int = 5000) -> DataFrame:
    """path, content of readmes and manifests at the top, cut."""
    return files.where(F.col("path").rlike(r"^((?i:README\.md)|package\.json|pyproject\.toml|Cargo\.toml|go\.mod|docker-compose\.ya?ml|Dockerfile)$")).select("path", F.substring("content", 1, most_chars).alias("content"))


def is_coupled_source(path: Column) -> Column:
    excluded = F.lit(False)
    for part in COUPLED_EXCLUDED:
        excluded = excluded | path.contains(part)
    return ~excluded & extension(path).isin(*COUPLED_EXTENSIONS)


def commit_segment(lines: DataFrame) -> DataFrame:
    """log, cid, path of a names-only log (log, line_no, line).

    A line without `/` and `.` starts a commit, a blank line ends one. A log may be of any
    length: it is scanned in ranges of lines.
    """
    line = F.trim("line")
    blank, marker = line == "", ~line.contains("/") & ~line.contains(".")
    numbered = scan.running(lines, ["log"], ["line_no"], {"cid": (blank | marker).cast("int")}, {"opened": F.when(blank, False).when(marker, True)})
    return numbered.where(~blank & ~marker & F.coalesce("opened", F.lit(False))).select("log", "cid", line.alias("path"))


def parse_git_log(lines: DataFrame) -> DataFrame:
    return commit_segment(lines).where(is_coupled_source(F.col("path"))).distinct()


def parse_author_log(lines: DataFrame) -> DataFrame:
    """log, cid, email, author, ts, path of a log whose commits start with COMMIT|email|name|seconds, scanned in ranges of lines."""
    head = F.col("line").startswith("COMMIT|")
    numbered = scan.running(lines, ["log"], ["line_no"], {"cid": head.cast("int")}, {"h": F.when(head, F.col("line"))}).withColumn("h", F.split("h", r"\|"))
    return numbered.where(~head & (F.trim("line") != "") & F.col("h").isNotNull()).select(
        "log", "cid", F.get("h", F.lit(1)).alias("email"), F.get("h", F.lit(2)).alias("author"), F.timestamp_seconds(F.get("h", F.lit(3)).try_cast("long")).alias("ts"), F.trim("line").alias("path")
    )


def git_lines(spark: SparkSession, repository: str, *arguments: str) -> DataFrame:
    """log, line_no, line of a git command's output, run on the driver: one repository's log."""
    out = subprocess.run(["git", "-C", repository, *arguments], capture_output=True, text=True, check=True).stdout
    return spark.createDataFrame([(repository, i, line) for i, line in enumerate(out.split("\n"))], "log string, line_no long, line string")


def scan_git_log(spark: SparkSession, repository: str) -> DataFrame:
    """log, cid, path of a repository's commits: names-only log with the bare hash before each commit's files."""
    return parse_git_log(git_lines(spark, repository, "log", "--name-only", "--pretty=format:%H"))


def scan_git_diff(spark: SparkSession, repository: str, base: str = "HEAD") -> DataFrame:
    """log, line_no, line as lines of one diff (diff, line_no, line) without context against a revision."""
    return git_lines(spark, repository, "diff", "--unified=0", base).withColumnRenamed("log", "diff")


def diff_lines(spark: SparkSession, path: str) -> DataFrame:
    """diff, line_no, line of one diff file beside the driver."""
    with open(path, encoding="utf-8", errors="replace") as f:
        lines = [(path, i, line.rstrip("\n")) for i, line in enumerate(f)]
    return spark.createDataFrame(lines, "diff string, line_no long, line string")


def is_repository(path: str) -> bool:
    return subprocess.run(["git", "-C", path, "rev-parse", "HEAD"], capture_output=True).returncode == 0


def sister_repositories(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """name, path, kind of folders in a listing (folder, file): npm, go or python by their manifests."""
    kinds = F.when(F.col("file") == "package.json", 1).when(F.col("file") == "go.mod", 2).when(F.col("file").isin("pyproject.toml", "setup.py", "requirements.txt"), 3)
    best = listing.groupBy("folder").agg(F.min(kinds).alias("k")).where("k is not null")
    return best.select(basename(F.col("folder")).alias("name"), F.col("folder").alias("path"), F.element_at(F.array(F.lit("npm"), F.lit("go"), F.lit("python")), F.col("k")).alias("kind"))


def scan_tours(spark: SparkSession, path: str) -> DataFrame:
    """Tours as JSON documents, newest first; documents that don't parse are passed over."""
    return spark.read.schema("id string, query string, created_at string, steps array<struct<title:string,files:array<string>>>").option("mode", "DROPMALFORMED").option("multiLine", True).json(path).orderBy(F.desc("created_at"), "id")


def scan_sqlite(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table of an SQLite file beside the driver, with the columns of the schema by name; missing ones are null, a missing table is empty.

    One repository's store, read whole; larger stores come as Parquet.
    """
    wanted = StructType.fromDDL(schema)
    with closing(sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True)) as db:
        known = {r[1] for r in db.execute("SELECT * FROM pragma_table_info(?)", (table,))}
        if not known:
            return spark.createDataFrame([], wanted)
        quoted = lambda name: '"' + name.replace('"', '""') + '"'
        columns = ", ".join(quoted(f.name) if f.name in known else "NULL" for f in wanted.fields)
        return spark.createDataFrame(db.execute(f"SELECT {columns} FROM {quoted(table)}").fetchall(), wanted)


def sink_sqlite(tables: Mapping[str, DataFrame], path: str) -> None:
    """Tables as an SQLite file beside the driver, row by row as they come; the file appears whole.

    For bundles that one repository's tools read; columns that aren't numbers or
    texts become JSON. Large tables go to sink_cache instead.
    """
    fresh = f"{path}.{uuid.uuid4().hex[:8]}"
    try:
        with closing(sqlite3.connect(fresh)) as db, db:
            for name, df in tables.items():
                quoted = lambda n: '"' + n.replace('"', '""') + '"'
                plain = df.select(*(F.col(f.name) if isinstance(f.dataType, (NumericType, StringType, BooleanType)) else _as_text(f).alias(f.name) for f in df.schema.fields))
                db.execute(f"CREATE TABLE {quoted(name)} ({', '.join(map(quoted, df.columns))})")
                db.executemany(f"INSERT INTO {quoted(name)} VALUES ({', '.join('?' * len(df.columns))})", (tuple(r) for r in plain.toLocalIterator()))
        os.replace(fresh, path)
    finally:
        if os.path.exists(fresh):
            os.remove(fresh)


def _as_text(field: StructField) -> Column:
    nested = isinstance(field.dataType, (ArrayType, MapType, StructType))
    return F.to_json(field.name) if nested else F.col(field.name).cast("string")


def sink_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def sink_table(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def sink_cache(df: DataFrame, path: str, key: str) -> None:
    """A table version by state hash; the committer makes it appear whole."""
    df.write.mode("overwrite").parquet(f"{path}/key={key}")


def scan_cache(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The table of that key, or None."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/key={key}/_SUCCESS")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(f"{path}/key={key}")
