"""The persisted index says what scoring all documents says, reads less, and is updated by what changed."""

import random

import pytest
from pyspark.sql import functions as F

from graphmill.operators import postings, text
from graphmill.sources import versions
from tests.conftest import rows


def library(rng, ids):
    words = [f"w{i}" for i in range(80)]
    return {i: " ".join(rng.choices(words, [1 / (k + 1) for k in range(80)], k=rng.randint(3, 120))) + (" rare" * rng.randint(1, 4) if rng.random() < 0.05 else "") for i in ids}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 7) for i, t in docs.items()], "id long, content string, tf int")


def plain(spark, docs, queries, top):
    own = frame(spark, docs)
    sizes = own.select(F.size(text.terms(F.coalesce("content", F.lit("")))).alias("length")).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))
    return text.top_per_query(text.bm25(text.inverted_index(own.select("id", "content")), queries, sizes), top)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "w3 w40 rare"), (2, "w1"), (3, "nothing here"), (4, "w70 w71 w72 w0 w2"), (5, None)], "q int, content string")


def test_best_rows_equal_those_of_all_documents_after_updates(spark, queries, tmp_path):
    rng, root = random.Random(5), f"file://{tmp_path}/index"
    docs = library(rng, range(400)) | {500: None, 501: ""}
    assert postings.update(frame(spark, docs), root, size=16) == 402
    assert rows(postings.search(spark, root, queries, 5)) == rows(plain(spark, docs, queries, 5))
    assert postings.update(frame(spark, docs), root, size=16) == 0 and versions.current(spark, root).number == 1
    for step in range(4):
        new = library(rng, rng.sample(range(450), 6))
        removed = rng.sample(sorted(set(docs) - set(new)), 3)
        same = {i: docs[i] for i in list(docs)[:20] if i not in new and i not in removed}
        before = versions.current(spark, root)
        assert postings.update(frame(spark, new | same), root, spark.createDataFrame([(i,) for i in [*removed, 99_999]], "id long"), size=16, most_parts=3) == len(new)
        after = versions.current(spark, root)
        if step < 2:  # only parts of the changed documents' terms are new
            assert after.tables["postings"][:-1] == before.tables["postings"]
            touched = {r.term for r in spark.read.parquet(after.tables["postings"][-1]).collect()}
            assert touched == {w for t in new.values() for w in t.split()}
        docs = {i: t for i, t in (docs | new).items() if i not in removed}
        assert rows(postings.search(spark, root, queries, 5)) == rows(plain(spark, docs, queries, 5))
    assert len(versions.current(spark, root).tables["postings"]) <= 3


def test_blocks_that_hold_no_best_row_stay_closed(spark, queries, tmp_path):
    root = f"file://{tmp_path}/index"
    docs = library(random.Random(6), range(3000))
    postings.update(frame(spark, docs), root, size=32)
    single = queries.where("q in (1, 2)")
    every, opened = postings.opened_blocks(versions.current(spark, root), single, 10)
    count = lambda df: {r.q: r["count"] for r in df.groupBy("q").count().collect()}
    total, read = count(every), count(opened)
    assert 0 < read[1] <= total[1] and 0 < read[2] < 0.3 * total[2]
    assert rows(postings.search(spark, root, single, 10)) == rows(plain(spark, docs, single, 10))


def test_postings_cross_one_shuffle_and_a_hot_term_is_shared_out(spark, queries, tmp_path, monkeypatch):
    docs = library(random.Random(7), range(300))
    index = text.inverted_index(frame(spark, docs).select("id", "content")).withColumn("gen", F.lit(1))
    given = spark.createDataFrame(index.collect(), index.schema)
    plan = postings._blocks(given, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(term") <= 2 and "rangepartitioning" not in plan and "Window" not in plan  # how often terms come, and postings
    monkeypatch.setattr(postings, "SHARE", 32)
    root = f"file://{tmp_path}/shared"
    postings.update(frame(spark, {i: docs[i] for i in list(docs)[::2]}), root, size=16)
    postings.update(frame(spark, docs), root, size=16)
    kept = versions.current(spark, root).read(spark, "postings")
    assert kept.agg(F.max("n")).first()[0] <= 16 and kept.groupBy("term", F.input_file_name(), "block").count().where("count > 1").isEmpty()
    assert rows(postings.search(spark, root, queries, 5)) == rows(plain(spark, docs, queries, 5))
    postings.compact(spark, root, 16)
    assert rows(postings.search(spark, root, queries, 5)) == rows(plain(spark, docs, queries, 5))


def test_odd_rows_and_no_index(spark, queries, tmp_path):
    root = f"file://{tmp_path}/none"
    with pytest.raises(ValueError):
        postings.search(spark, root, queries)
    odd = spark.createDataFrame([(None, "w1"), (1, "a b"), (1, "w1 w1"), (2, None)], "id long, content string")
    assert postings.update(odd, root) == 2
    assert [(r.q, r.id) for r in postings.search(spark, root, queries).collect()] == [(2, 1)]
    assert postings.update(odd.limit(0), root) == 0
