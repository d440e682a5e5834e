"""The pipeline on a small corpus, against its stages done by brute force."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from graphmill.llm import queries, toxicity
from tests.llm.test_text_operators import covered, near, shingles


def corpus(rng):
    words = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    items = [(i, " ".join(words(30))) for i in range(5)]
    shared = " ".join(words(60))
    docs, labels = [], []
    for i in range(160):
        body = words(rng.randint(20, 120))
        toxic = int(i % 4 == 0)
        if toxic:
            for t in ("scumbag", "lowlife", "halfwit"):
                body.insert(rng.randrange(len(body)), t)
        if i % 7 == 0:
            body += shared.split()
        if i % 11 == 0:
            body += items[i % 5][1].split()
        docs.append((i, " ".join(body)))
        labels.append((i, 1, toxic))
    docs += [(200 + k, docs[4 * k + 1][1] + " extra") for k in range(20)] + [(300, None), (301, "")]
    return docs, labels, items


def write(folder, name, columns, rows, kinds):
    pq.write_table(pa.table({c: pa.array([r[k] for r in rows], kinds[k]) for k, c in enumerate(columns)}), f"{folder}/{name}.parquet")


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels, items = corpus(random.Random(12))
    integer, string = pa.int64(), pa.string()
    write(tmp_path, "documents", ("doc_id", "text", "lang", "source", "n_chars"), [(d, t, "en", "s", len(t or "")) for d, t in docs], (integer, string, string, string, integer))
    write(tmp_path, "labels", ("doc_id", "quality", "toxic"), labels, (integer, pa.int32(), pa.int32()))
    write(tmp_path, "benchmark", ("item_id", "text"), items, (integer, string))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    judged = {r.doc_id: r.predicted for r in toxicity.judge(frame, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert all(judged[i] == t for i, _, t in labels)
    left = [(d, t) for d, t in docs if not judged[d]]
    classes = near([(d, t or "") for d, t in left])
    left = [(d, t) for d, t in left if classes[d][1] == d]
    gone = covered(left)
    cut = []
    for d, t in left:
        kept, at = [], 0
        for c in t or "":
            n = len(c.encode())
            if not gone[d][at : at + n].all():
                kept.append(c)
            at += n
        if kept or not t:
            cut.append((d, "".join(kept) if t is not None else None))
    sets = [shingles(t) for _, t in items]
    clean = [(d, t) for d, t in cut if not any(100 * len(shingles(t) & s) >= 75 * len(s) for s in sets)]
    library = Tokenizer.from_file(queries.vocabulary_path())
    assert {r.doc_id: list(r.ids) for r in got} == {d: library.encode(t or "", add_special_tokens=False).ids for d, t in clean}
    assert 0 < len(clean) < len(cut) < len(docs)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs, labels, items = corpus(random.Random(1))
    integer, string = pa.int64(), pa.string()
    write(tmp_path, "labels", ("doc_id", "quality", "toxic"), labels, (integer, pa.int32(), pa.int32()))
    write(tmp_path, "benchmark", ("item_id", "text"), items, (integer, string))
    frame = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs[:30]], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (frame, frame.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == frame.columns
            out.count()
