"""Guided tours: classification of questions, steps and their validation. steps: tour, ord, title, what, why, files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keywords of question types; the first type wins ties.
TOUR_KEYWORDS = {
    "overview": ("overview", "architecture", "structure", "how is this organized", "high level", "what does this do", "explain this project"),
    "data-flow": ("data flow", "request lifecycle", "how does data", "trace", "follow a request", "pipeline", "flow"),
    "onboarding": ("onboarding", "getting started", "new developer", "first day", "where to start", "how to contribute", "setup"),
    "dependency-audit": ("dependency", "circular", "health", "audit", "refactor", "tech debt", "code smell", "coupling"),
    "api-surface": ("api", "endpoints", "routes", "rest", "graphql", "external", "interface"),
}


# Words that make a question one about code.
CODE_TERMS = (
    "code", "codebase", "source", "file", "folder", "directory", "module", "package", "class", "function", "method", "variable", "component", "service", "controller", "model", "schema",
    "interface", "enum", "constant", "architecture", "structure", "pattern", "design", "layer", "middleware", "hook", "import", "export", "dependency", "inject", "provider", "factory",
    "singleton", "flow", "pipeline", "request", "response", "route", "endpoint", "handler", "lifecycle", "event", "callback", "promise", "async", "stream", "queue", "test", "build",
    "deploy", "config", "setup", "debug", "error", "exception", "logging", "auth", "database", "query", "migration", "api", "rest", "graphql", "websocket", "http", "server", "client",
    "overview", "onboarding", "audit", "refactor", "organize", "entry", "react", "vue", "angular", "express", "next", "node", "typescript", "javascript", "python", "django", "flask",
    "spring", "docker", "webpack", "vite", "esbuild",
)


def is_relevant(question: Column, words: tuple[str, ...] = CODE_TERMS) -> Column:
    """Whether one of the words stands in the question as a word: letters beyond ASCII end one, as in JavaScript and RE2, on every JVM."""
    return F.lower(question).rlike(r"(?<![0-9a-z_])(" + "|".join(words) + r")(?![0-9a-z_])")


def classify_query(question: Column, short: int = 10) -> Column:
    """The type with most keywords in the question; custom for none, overview for a question shorter than `short` characters without any."""
    text = F.lower(question)
    hits = {kind: sum((text.contains(w).cast("int") for w in words), F.lit(0)) for kind, words in TOUR_KEYWORDS.items()}
    most = F.greatest(*hits.values())
    out = F.when(F.char_length(text) < short, "overview").otherwise("custom")
    for kind, n in reversed(hits.items()):
        out = F.when((most > 0) & (n == most), kind).otherwise(out)
    return out


def step_reorder(steps: DataFrame, key: str = "tour", ord: str = "ord") -> DataFrame:
    """steps with `step`: 1, 2, ... within a tour."""
    return steps.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy(ord)))


def dedupe_steps(steps: DataFrame, overlap: float = 0.8) -> DataFrame:
    """steps without repetitions: each step takes up the later ones of its tour that share more than the overlap of files, and the longest explanation met so far stands for them.

    What is compared with later steps is the one that stands. A tour's steps are
    one group: an answer's length bounds it.
    """
    def kept(tour: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, len(what or ""), frozenset(files if files is not None else ())) for k, what, files in zip(tour.index, tour["what"], tour["files"], strict=True)]
        rows = [r for _, r in sorted(zip(tour["ord"], rows, strict=True), key=lambda x: x[0])]
        stay = []
        while rows:
            lead, others = rows[0], []
            for step in rows[1:]:
                union = lead[2] | step[2]
                if not union or len(lead[2] & step[2]) <= overlap * len(union):
                    others.append(step)
                elif step[1] > lead[1]:
                    lead = step
            stay.append(lead[0])
            rows = others
        return tour.loc[stay]

    return steps.groupBy("tour").applyInPandas(kept, steps.schema)


def validate_tours(steps: DataFrame, known: DataFrame | None = None, least: int = 3, most: int = 8, least_what: int = 30, least_why: int = 15, most_tokens: int = 6000) -> DataFrame:
    """tour, errors, warnings, tokens, valid; known (file): the files that steps may name."""
    files = steps.select("tour", "ord", F.explode("files").alias("file")).distinct()
    unknown = files.join(known.select("file"), "file", "left_anti").groupBy("tour").agg(F.count(F.lit(1)).alias("unknown")) if known is not None else files.select("tour").distinct().withColumn("unknown", F.lit(0))
    size = F.char_length(F.to_json(F.struct("title", "what", "why", "files")))
    sums = steps.groupBy("tour").agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.char_length("what") < least_what).alias("short_what"),
        F.count_if(F.char_length("why") < least_why).alias("short_why"),
        F.count_if(F.size("files") == 0).alias("bare"),
        F.ceil(F.sum(size) / 4).cast("long").alias("tokens"),
    )
    rules = [
        (F.col("steps") < least, "too few steps"), (F.col("steps") > most, "too many steps"), (F.col("short_what") > 0, "explanation too short"),
        (F.col("short_why") > 0, "reason too short"), (F.col("tokens") > most_tokens, "too many tokens"), (F.coalesce("unknown", F.lit(0)) > 0, "unknown files"),
    ]
    some = lambda pairs: F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in pairs)), lambda x: x.isNotNull())
    return sums.join(unknown, "tour", "left").select("tour", some(rules).alias("errors"), some([(F.col("bare") > 0, "steps without files")]).alias("warnings"), "tokens").withColumn("valid", F.size("errors") == 0)


def fallback_tour(entries: DataFrame, hot: DataFrame, most_entries: int = 5, least: int = 3) -> DataFrame:
    """step, file, title: up to five entry points (file, rank), filled up with hot files (file, rank) to three."""
    first = entries.orderBy("rank", "file").limit(most_entries).withColumn("kind", F.lit(0))
    more = hot.join(entries.select("file"), "file", "left_anti").orderBy("rank", "file").limit(least).withColumn("kind", F.lit(1))
    every = first.select("file", "rank", "kind").unionByName(more.select("file", "rank", "kind"))
    w = Window.orderBy("kind", "rank", "file")
    n = F.count_if(F.col("kind") == 0).over(Window.partitionBy(F.lit(1)))
    placed = every.withColumn("step", F.row_number().over(w)).withColumn("n", n).where((F.col("kind") == 0) | (F.col("step") <= F.greatest(F.lit(least), F.col("n"))))
    return placed.select("step", "file", F.format_string("Step %d: %s", "step", "file").alias("title"))


def evict(tours: DataFrame, newest: int = 20) -> DataFrame:
    """The newest tours (id, created_at)."""
    return tours.orderBy(F.desc("created_at"), "id").limit(newest)
