"""A persisted inverted index: impact-ordered blocks of postings, updated by what changed.

A store (see sources.versions) holds four tables in parts. documents: each id's last
generation, content digest and length; postings: blocks of a term's postings, those with
the greatest impact first, with the largest tf and the smallest length of each block;
forward: the terms of each document; frequencies: changes of a term's number of
documents. An update writes parts for the documents that changed and their terms, nothing
else is read or rewritten; a posting of an earlier generation of its document doesn't
count. A search reads the heads of its terms' blocks, finds a score that so many
documents reach at least, and opens only blocks that can still hold one that reaches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.lineage import cut
from graphmill.operators.text import query_terms, terms, top_per_query
from graphmill.sources import versions

#: Postings of a block, and parts of a store's tables before they are made one.
BLOCK, MOST_PARTS = 1024, 8
#: Postings of a term that a task orders at once.
SHARE = 1 << 17
#: Scores are compared after six decimals.
LEAST = 1e-5


def _counted(text: Column) -> Column:
    """The terms of a text, each once with its tf: array<struct<term, tf>>, counted within the row."""
    ends = lambda t: F.array_compact(F.transform(t, lambda x, i: F.when((i == 0) | (F.get(t, i - 1) != x), i)))
    runs = lambda t, at: F.transform(at, lambda h, k: F.struct(F.get(t, h).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(t)) - h).cast("long").alias("tf")))
    # an array of one binds what is used several times
    bound = F.transform(F.array(F.array_sort(terms(text))), lambda t: F.get(F.transform(F.array(ends(t)), lambda at: runs(t, at)), F.lit(0)))
    return F.get(bound, F.lit(0))


def _blocks(postings: DataFrame, size: int = BLOCK, gen: int | None = None, most: int | None = None, share: int | None = None) -> DataFrame:
    """term, block, n, most_tf, least_length, listed of postings (term, id, tf, length, and gen where it isn't the same for all).

    Postings are shuffled once, by term. Of a term with more than `share` postings each is in
    one of so many shares, by its id's hash, and a share is ordered and cut into blocks by
    itself: block k of share i of m is the term's block k * m + i. most: documents,
    where that is known.
    """
    share = share or SHARE
    if most is None or most > share:
        many = postings.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share)
        many = F.broadcast(many.select("term", F.ceil(F.col("_n") / share).cast("long").alias("_shares")))  # of `share` postings one at most is of such a term
        dealt = postings.join(many, "term", "left").withColumn("_shares", F.coalesce("_shares", F.lit(1).cast("long")))
    else:
        dealt = postings.withColumn("_shares", F.lit(1).cast("long"))
    dealt = dealt.withColumn("_share", F.pmod(F.xxhash64("id"), F.col("_shares")))
    # numbers side by side are half as long in a shuffle as structs; lists of one aggregate are in the same order
    weight = F.shiftleft("tf", 32).bitwiseOR(F.col("length")).alias("w")  # both are lengths of arrays or less
    lists = ["w", "id", *(["gen"] if gen is None else [])]
    whole = dealt.select("*", weight).groupBy("term", "_share", "_shares").agg(*(F.collect_list(c).alias(c) for c in lists))
    tf, length = (lambda z: F.shiftright(z["w"], 32)), (lambda z: z["w"].bitwiseAND(F.lit((1 << 32) - 1)))
    one = lambda z: F.struct((-tf(z)).alias("less"), length(z).alias("length"), z["id"].alias("id"), (z["gen"] if gen is None else F.lit(gen)).alias("gen"))
    by_impact = F.array_sort(F.transform(F.arrays_zip(*lists), one))
    cuts = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size)), lambda k: F.struct(k.alias("k"), F.slice(x, (k * size + 1).cast("int"), F.lit(size)).alias("some")))
    blocks = whole.select("term", "_share", "_shares", F.inline(F.get(F.transform(F.array(by_impact), cuts), F.lit(0))))
    return blocks.select(
        "term", (F.col("k") * F.col("_shares") + F.col("_share")).alias("block"), F.size("some").cast("long").alias("n"), (-F.col("some")[0]["less"]).alias("most_tf"),
        F.array_min(F.transform("some", lambda x: x["length"])).alias("least_length"),
        F.transform("some", lambda x: F.struct(x["id"].alias("id"), x["gen"].alias("gen"), (-x["less"]).alias("tf"), x["length"].alias("length"))).alias("listed"),
    )


def _live(version: versions.Version, spark: SparkSession) -> DataFrame:
    """id, gen, hash, length of the documents that the store has."""
    last = version.read(spark, "documents").groupBy("id").agg(F.max_by(F.struct("gen", "hash", "length", "there"), "gen").alias("d"))
    return last.where("d.there").select("id", "d.gen", "d.hash", "d.length")


def update(docs: DataFrame, root: str, removed: DataFrame | None = None, size: int = BLOCK, most_parts: int = MOST_PARTS) -> int:
    """Documents (id, content) into the store, and ids (id) out of it; how many documents were indexed.

    What the store has with the same content is left alone. Of rows that repeat an id the
    greatest content counts; null ids are passed over, a null content has no terms.
    """
    spark = docs.sparkSession
    while True:
        old = versions.current(spark, root)
        gen = (old.stamp["gen"] if old else 0) + 1
        given = docs.where("id is not null").select("id", F.coalesce("content", F.lit("")).alias("content"))
        ids = given.agg(F.count("id").alias("n"), F.count_distinct("id").alias("d")).first()
        if ids["n"] > ids["d"]:  # else texts need not meet
            given = given.groupBy("id").agg(F.max("content").alias("content"))
        changed = given.withColumn("hash", F.sha2("content", 256))
        known = cut(_live(old, spark), "index-known") if old else None
        if known is not None:
            # the ids that stay are known before texts are dealt: where they are few, texts stay where they are
            same = changed.select("id", "hash").join(known.select("id", "hash"), ["id", "hash"]).select("id")
            changed = changed.join(cut(same, "index-same"), "id", "left_anti")
        # texts are read once and not kept: all parts come from their counted terms
        counted = changed.select("id", "hash", _counted(F.col("content")).alias("t"))
        length = F.aggregate("t", F.lit(0).cast("long"), lambda n, x: n + x["tf"]).alias("length")
        forward = versions.write(counted.select("id", F.lit(gen).alias("gen"), "hash", length, F.col("t.term").alias("terms"), F.col("t.tf").alias("tfs")), root, "forward")
        listed = spark.read.parquet(forward)
        indexed = listed.count()
        gone = listed.select("id") if removed is None else listed.select("id").unionByName(removed.select("id").where("id is not null")).distinct()
        dropped = None if known is None else cut(known.join(gone, "id", "left_semi").select("id", "gen"), "index-dropped")
        if old is not None and indexed == 0 and dropped.isEmpty():
            return 0
        rows = listed.select("id", "length", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))
        out = listed.select("id", "gen", "hash", "length", F.lit(True).alias("there"))
        # the lengths of its blocks say how many documents hold a term
        written = versions.write(_blocks(rows, size, gen, indexed), root, "postings")
        changes = spark.read.parquet(written).select("term", F.col("n").alias("change"))
        if dropped is not None:
            before = old.read(spark, "forward").join(dropped, ["id", "gen"], "left_semi").select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("change"))
            changes = changes.unionByName(before)
            away = dropped.join(listed.select("id"), "id", "left_anti").select("id", F.lit(gen).alias("gen"), F.lit(None).cast("string").alias("hash"), F.lit(0).cast("long").alias("length"), F.lit(False).alias("there"))
            out = out.unionByName(away)
        parts = {
            "documents": out,
            "frequencies": changes.groupBy("term").agg(F.sum("change").alias("change")),
        }
        new = {"forward": forward, "postings": written} | {name: versions.write(df, root, name) for name, df in parts.items()}
        paths = {name: [*(old.tables[name] if old else []), path] for name, path in new.items()}
        if versions.point(spark, root, {"gen": gen}, paths, after=old.number if old else 0) is not None:
            break
    if len(paths["documents"]) > most_parts:
        compact(spark, root, size)
    return indexed


def compact(spark: SparkSession, root: str, size: int = BLOCK) -> None:
    """Each table as one part without what no longer counts; the index says the same as before."""
    while True:
        old = versions.current(spark, root)
        live = cut(_live(old, spark), "index-live")
        ids = live.select("id", "gen")
        listed = old.read(spark, "postings").select("term", F.inline("listed"))
        parts = {
            "documents": live.select("id", "gen", "hash", "length", F.lit(True).alias("there")),
            "postings": _blocks(listed.join(ids, ["id", "gen"], "left_semi").select("term", "id", "length", "tf", "gen"), size),
            "forward": old.read(spark, "forward").join(ids, ["id", "gen"], "left_semi").select("id", "gen", "terms"),
            "frequencies": old.read(spark, "frequencies").groupBy("term").agg(F.sum("change").alias("change")).where("change > 0"),
        }
        if versions.point(spark, root, old.stamp, {name: [versions.write(df, root, name)] for name, df in parts.items()}, after=old.number) is not None:
            return


def _impact(tf: Column, length: Column, k1: float, b: float) -> Column:
    return F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("avg_length")))


def _part() -> Column:
    """The file of a block, by its hash."""
    return F.xxhash64(F.input_file_name())


def opened_blocks(version: versions.Version, queries: DataFrame, top: int, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(all, opened): q, term, block, idf, avg_length of the blocks of the queries' terms, and of those that a best row can lie in.

    A block's bound is the impact of its largest tf at its smallest length. A first sum over
    each term's first block gives scores that documents have at least, the top-th of which
    is a threshold; a block is passed over if its bound and the best ones of the query's
    other terms stay below it. So queries of one term or of terms alike open few blocks; a
    weak term's blocks stay open beside a strong one, as its rows may hold that too.
    """
    spark = queries.sparkSession
    live = _live(version, spark)
    whole = F.broadcast(live.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length")))
    asked = query_terms(queries).select("q", "term")
    df = version.read(spark, "frequencies").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("change").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").join(whole).withColumn("idf", idf).select("q", "term", "idf", "avg_length")
    heads = version.read(spark, "postings").select("term", "block", "n", "most_tf", "least_length").withColumn("part", _part())
    bound = _impact(F.col("most_tf"), F.col("least_length"), k1, b)
    every = cut(weighed.join(heads, "term").select("q", "term", "part", "block", "n", "idf", "avg_length", bound.alias("bound")), "index-heads")
    best = every.groupBy("q", "term").agg(F.max("bound").alias("best"))
    sums = best.groupBy("q").agg(F.sum("best").alias("all"))
    first = every.where("block = 0")
    best_rows = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    reached = scores(version, first, k1, b).withColumn("k", F.row_number().over(best_rows)).where(F.col("k") == top)
    threshold = reached.select("q", F.col("score").alias("least"))
    kept = every.join(best, ["q", "term"]).join(sums, "q").join(threshold, "q", "left").where(F.col("least").isNull() | (F.col("bound") + F.col("all") - F.col("best") >= F.col("least") - LEAST))
    return every, kept.select(*every.columns)


def scores(version: versions.Version, blocks: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """q, id, score by the postings of some blocks that still count.

    A block that one query opens is read for all queries of its term: a document's score may
    get nearer to its whole, never beyond. Postings of these blocks are dealt by id once, not
    once a query, and scored where they are; blocks and queries' terms are broadcast.
    """
    spark = blocks.sparkSession
    own = version.read(spark, "postings").select("term", "block", "listed").withColumn("part", _part())
    some = own.join(F.broadcast(blocks.select("term", "part", "block").distinct()), ["term", "part", "block"], "left_semi").select("term", F.inline("listed"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    live = _live(version, spark).select("id", F.col("gen").alias("_gen"))
    counted = some.repartition(parts, "id").join(live, "id").where("gen = _gen")
    asked = F.broadcast(blocks.select("q", "term", "idf", "avg_length").distinct())
    return counted.join(asked, "term").groupBy("q", "id").agg(F.round(F.sum(_impact(F.col("tf"), F.col("length"), k1, b)), 6).alias("score"))


def search(spark: SparkSession, root: str, queries: DataFrame, top: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """q, id, score, rank (from 0) of the best rows of each query (q, content), as scoring all documents gives them."""
    version = versions.current(spark, root)
    if version is None:
        raise ValueError(f"no index at {root}")
    return top_per_query(scores(version, opened_blocks(version, queries, top, k1, b)[1], k1, b), top)
