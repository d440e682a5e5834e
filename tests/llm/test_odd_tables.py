"""Very long texts, repeated rows, clashing names and empty tables."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphmill.llm import bpe, chat, decontaminate, minhash, queries, quality, suffix, toxicity, urls
from tests.llm.test_text_operators import covered

ITEM = " ".join(f"item{i}" for i in range(20))


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(4)
    body = [f"w{rng.randrange(5000)}" for _ in range(400_000)]
    middle = [*body[:200_000], ITEM, *body[200_000:]]
    # the second is the first with a hundredth of its words changed
    near = [w if i % 100 != 7 else "other" for i, w in enumerate(middle)]
    docs = [(1, " ".join(middle)), (2, " ".join(near)), (3, "x" * 3_000_000), (4, "short text of some words")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(2)


def test_very_long_texts(spark, long_docs):
    linked = {r.doc_id: r.component_id for r in minhash.near_duplicates(long_docs).collect()}
    assert linked == {1: 1, 2: 1, 3: 3, 4: 4}
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contained(long_docs, items).collect()} == {1, 2}
    model = toxicity.Model(["moron"], [], {("moron", 0): 0.999}, {"moron": (500.0, 0.0)}, 0.02)
    told = long_docs.withColumn("text", F.when(F.col("doc_id") == 1, F.concat("text", F.lit(" moron you moron what a moron"))).otherwise(F.col("text")))
    scored = {r.doc_id: r.s for r in told.select("doc_id", toxicity.score_column(told, model, F.col("text")).alias("s")).collect()}
    assert scored[1] > 0.5 and scored[2] == scored[3] == scored[4] == 0
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(long_docs, labels).count() == 4


def test_urls_of_odd_pages(spark):
    schema = "page_id long, url string, host string, rule string"
    assert urls.judge(spark.createDataFrame([], schema), (), spark.createDataFrame([], "url string, label int")).count() == 0
    deep = "http://a.org/" + "/".join(["x"] * 300) + "/1"
    pages = spark.createDataFrame([(1, None, "h", "r"), (1, None, "h", "r"), (None, "nothing", "h", "r"), (2, deep, "h", "r"), (3, "http://A.org/" + "y" * 100_000, "h", "r")], schema)
    out = urls.judge(pages, queries.URL_RULES, spark.createDataFrame([], "url string, label int"))
    got = sorted((r.page_id or 0, r.host, len(r.path), r.verdict) for r in out.collect())
    assert got == [(0, "", 0, "allow"), (1, "", 0, "allow"), (1, "", 0, "allow"), (2, "a.org", 602, "allow"), (3, "a.org", 100_001, "allow")]


def test_chat_of_odd_turns(spark):
    turns = [(1, 0, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, None, None, "z"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.examples(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))).collect()}
    assert got == {1: (4, 2), 2: (2, 8)}


def test_benchmark_rows_that_repeat(spark):
    docs = spark.createDataFrame([(1, "a b " + ITEM + " c", "x")] * 2 + [(None, ITEM, "x"), (2, None, "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM)] * 2 + [(8, None), (9, "")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontaminate.contained(docs, items).collect()) == [(0, 7)] * 2 + [(1, 7)] * 4
    assert [r.doc_id for r in decontaminate.without_contaminated(docs, items).collect()] == [2]


def tables(folder, docs, labels, items):
    integer, string = pa.int64(), pa.string()
    clash = ("doc_id", "text", "lang", "source", "n_chars", "score", "ids", "component_id", "spans")
    rows = [(d, t, "en", "s", len(t or ""), "a", "b", "c", "d") for d, t in docs]
    put = lambda name, columns, kinds, rows: pq.write_table(pa.table({c: pa.array([r[k] for r in rows], kinds[k]) for k, c in enumerate(columns)}), f"{folder}/{name}.parquet")
    put("documents", clash, (integer, string, string, string, integer, string, string, string, string), rows)
    put("labels", ("doc_id", "quality", "toxic"), (integer, pa.int32(), pa.int32()), labels)
    put("benchmark", ("item_id", "text"), (integer, string), items)


def test_pipeline_without_documents(spark, tmp_path):
    tables(tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_repeated_ids_and_clashing_names(spark, tmp_path):
    texts = [f"document {i} says " + " ".join(f"v{i}x{k}" for k in range(12)) for i in range(6)]
    docs = [*enumerate(texts), (0, texts[0]), (1, "another text under the first id of one"), (None, texts[5]), (9, None), (9, None), (10, ITEM)]
    tables(tmp_path, docs, [(1, 1, None)], [(1, ITEM)])
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    # rows of an id that stays are one; a null id and texts without words stay
    assert sorted(x for x in got if x is not None) == [0, 1, 2, 3, 4, 5, 9, 9] and 10 not in got


def test_round_trip_of_a_long_word(spark):
    out = bpe.round_trip(spark.createDataFrame([(1, "ab" * 100_000)], "doc_id long, text string"), queries.vocabulary_path()).first()
    assert out.n_tokens > 0


def test_suffix_counts_repeats_inside_long_texts(spark):
    rng = random.Random(2)
    part = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    docs = [(1, part + "".join(rng.choice("ijklm") for _ in range(200_000)) + part), (2, part[:500])]
    gone = covered(docs)
    assert {r.doc_id: r.n_removed for r in suffix.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {d: int(gone[d].sum()) for d, _ in docs}
