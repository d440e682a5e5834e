"""Queries over whole tables, against plain Python on small ones."""

import math
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphmill.plans.registry import QUERIES


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("library"), random.Random(6)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, rng.choice(("en", "de", "fr")), " ".join(rng.choice(words) for _ in range(rng.randint(5, 80)))) for i in range(150)]
    # all of an item's words are in a document that isn't English, all but the last in an English one
    asked = [[f"q{k}x{i}" for i in range(12)] for k in range(4)]
    docs += [(200 + k, "de", " ".join(q + ["w1"])) for k, q in enumerate(asked)] + [(300 + k, "en", " ".join(q[:11])) for k, q in enumerate(asked)]
    docs += [(400, "en", None), (401, None, "q0x0 w2")]
    items = [(k, " ".join(q)) for k, q in enumerate(asked)] + [(10 + k, " ".join(rng.choice(words) for _ in range(14))) for k in range(3)]
    pq.write_table(pa.table({"doc_id": [d[0] for d in docs], "lang": [d[1] for d in docs], "text": [d[2] for d in docs]}), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": [q for q, _ in items], "text": [t for _, t in items]}), folder / "benchmark.parquet")
    return str(folder), {i: re.findall(r"\w+", (t or "").lower()) for i, _, t in docs}, {q: set(t.split()) for q, t in items}, {i: len(t or "") for i, _, t in docs}


def best_rows(docs, items):
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in w for w in docs.values()) for q in items.values() for t in q}
    out = {}
    for q, asked in items.items():
        score = {}
        for i, w in docs.items():
            for t in asked & set(w):
                score[i] = score.get(i, 0.0) + math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))
        out[q] = sorted(((round(s, 6), i) for i, s in score.items()), key=lambda x: (-x[0], x[1]))[:20]
    return out


def test_search_takes_all_documents_and_terms(spark, library):
    folder, docs, items, sizes = library
    found = {(r.q, r.id) for r in QUERIES["search_text"](spark, folder).collect()}
    assert found == {(q, i) for q, asked in items.items() for i, w in docs.items() if asked <= set(w)}
    assert {(k, 200 + k) for k in range(4)} <= found
    best = best_rows(docs, items)
    got = {(r.q, r.rank): (r.score, r.id) for r in QUERIES["bm25"](spark, folder).collect()}
    assert {k: i for k, (_, i) in got.items()} == {(q, k): i for q, b in best.items() for k, (_, i) in enumerate(b)}
    assert all(abs(s - best[q][k][0]) < 2e-6 for (q, k), (s, _) in got.items())
    fused = {}
    for q, b in best.items():
        by_id = sorted(i for _, i in b)
        fused |= {(q, i): round(1 / (61 + k) + 1 / (61 + by_id.index(i)), 9) for k, (_, i) in enumerate(b)}
    got = {(r.q, r.id): r.fused for r in QUERIES["rrf"](spark, folder).collect()}
    assert got.keys() == fused.keys() and all(abs(got[k] - fused[k]) < 2e-9 for k in got)
    packed = {(r.q, r.id): (r["rank"], r.used) for r in QUERIES["budget_pack"](spark, folder).collect()}
    for q in items:
        used = 0
        for k, i in enumerate(sorted((i for p, i in fused if p == q), key=lambda i: (-fused[q, i], i)), 1):
            used += sizes[i]
            assert packed.get((q, i)) == ((k, used) if used <= 24_000 else None)


def test_every_file_name_is_resolved(spark, tmp_path):
    kinds = ["ECONOMY X", "STANDARD X", "PROMO X"]
    parts = [(i, f"red {i % 3}", kinds[i % 3], i) for i in range(1, 40)] + [(5, "red 2", "STANDARD X", 5)]
    pq.write_table(pa.table({c: [p[k] for p in parts] for k, c in enumerate(("p_partkey", "p_name", "p_type", "p_size"))}), tmp_path / "part.parquet")
    folder = {"ECONOMY X": "src/services/", "STANDARD X": "src/misc/", "PROMO X": "tests/"}
    paths = {folder[kind] + f"{name.replace(' ', '_')}_{key}.ts" for key, name, kind, _ in parts}
    expected = {}
    for base in {p.rsplit("/", 1)[1] for p in paths}:
        for name in (base, "misc/" + base):
            ends = [p for p in paths if p == name or p.endswith("/" + name)]
            expected[name] = ends[0] if len(ends) == 1 else None
    assert expected["red_2_5.ts"] is None and expected["misc/red_2_5.ts"] and expected["red_1_1.ts"]
    got = QUERIES["join_suffix_unique"](spark, str(tmp_path)).collect()
    assert {r.name: r.path for r in got} == expected and len(got) == len(expected)


def test_linear_queries_take_edges_of_all_quantities(spark, tmp_path):
    rng = random.Random(13)
    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    pq.write_table(pa.table({"p_partkey": list(range(60)), "p_name": ["a b"] * 60, "p_type": [f"{kinds[i % 6]} X" for i in range(60)], "p_size": [1] * 60}), tmp_path / "part.parquet")
    lines = [(o, n, rng.randrange(50), rng.randint(1, 50), rng.choice("RNA")) for o in range(60) for n in range(1, 4)]
    names = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    pq.write_table(pa.table({c: [x[k] for x in lines] for k, c in enumerate(names)}), tmp_path / "lineitem.parquet")
    part = {(o, n): p for o, n, p, _, _ in lines}
    edges = {(p, part[o, n + 1]) for o, n, p, _, flag in lines if flag == "R" and (o, n + 1) in part and p != part[o, n + 1]}
    fan = {i: (sum(t == i for _, t in edges), sum(s == i for s, _ in edges)) for i in range(60)}
    got = {name: QUERIES[name](spark, str(tmp_path)).collect() for name in ("fan_counts", "instability", "orphans", "layer_violations")}
    assert {r.node: (r.fan_in, r.fan_out) for r in got["fan_counts"]} == fan
    assert {r.node: r.instability for r in got["instability"]} == {i: b / (a + b) if a + b else None for i, (a, b) in fan.items()}
    assert {r.node for r in got["orphans"]} == {i for i, f in fan.items() if f == (0, 0)}
    layer = dict(enumerate((3, 4, 1, -2, 0, -1)))
    wrong = {(s, t) for s, t in edges for a, b in [(layer[s % 6], layer[t % 6])] if a not in (-1, 0) and b not in (-1, 0) and (b < a or (b - a >= 2 and a != -2))}
    assert {(r.s, r.t) for r in got["layer_violations"]} == wrong


def test_chunks_hold_whole_texts(spark, tmp_path):
    texts = {1: "one line", 2: "\n".join(f"line {i}" for i in range(9)), 3: "", 4: None}
    pq.write_table(pa.table({"doc_id": list(texts), "text": list(texts.values())}), tmp_path / "documents.parquet")
    got = {r.doc_id: (r.chunk_id, r.content) for r in QUERIES["chunk_files"](spark, str(tmp_path)).collect()}
    assert got == {i: (f"{i}::__file__", t) for i, t in texts.items() if t is not None}


def test_files_are_classified_by_all_tasks(spark):
    from graphmill.plans import registry

    assert registry.classified(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_selected_files_are_classified_once(spark, monkeypatch):
    from graphmill.plans import registry
    from graphmill.plans import relations as rel

    sf, seen = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0)

    def kind(node):
        seen.add(1)
        return "route" if node % 3 == 0 else "model"

    monkeypatch.setattr(registry, "classified", lambda spark, d: rel.files(spark, d).withColumn("category", F.udf(kind)("node")))
    assert registry.selected(spark, sf).count() == 200
    assert seen.value == rel.files(spark, sf).count()
