"""Clustering, mixing and spelling variants against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import clustering, mixing, spelling
from tests.conftest import rows

# ---- clustering


def plain_clusters(vectors, clusters, rounds):
    """Python's integers throughout; a row for each usable vector."""
    kept = [(i, [math.floor(Fraction(float(x)) * 256) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in order[:clusters]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for round_ in range(rounds + 1):
        best = [min((distance(q, c), k) for k, c in enumerate(centroids)) for _, q in kept]
        if round_ == rounds:
            break
        for k in range(len(centroids)):
            own = [q for (_, q), (_, c) in zip(kept, best, strict=True) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    most = (1 << 63) - 1
    sums = {}
    for d, k in best:
        sums[k] = sums.get(k, 0) + d
    digest = lambda k: hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()
    return sorted(((i, k, min(d, most), min(sums[k], most), min(sum(sums.values()), most), digest(k)) for (i, _), (d, k) in zip(kept, best, strict=True)), key=repr)


def vectors_of(spark, data):
    return spark.createDataFrame([(i, v, "clash") for i, v in data], "vec_id long, embedding array<double>, cluster string")


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_clusters_equal_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 64))
    data = [(i, [float(x) for x in (middles[i % 6] + rng.normal(size=64) * 0.3) * scale]) for i in range(150)]
    data += [(200 + i, data[3][1]) for i in range(20)] + [(3, data[3][1]), (3, data[4][1]), (900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [math.nan] + [1.0] * 63), (904, [math.inf] + [1.0] * 63), (905, [0.0] * 64), (906, [-0.0] * 64)]
    got = clustering.cluster(vectors_of(spark, data).repartition(5), 7, 3)
    assert rows(got) == plain_clusters(data, 7, 3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_huge_components_are_exact_and_held_where_no_long_holds_them(spark):
    data = [(i, [float((-1) ** i * 2.0 ** (10 * i))] * 64) for i in range(5)] + [(9, [1e300] * 64), (10, [-1e300] * 64), (11, [3.0] * 64)]
    held = [(i, [max(-(2.0**54), min(2.0**54, x)) for x in v]) for i, v in data]
    assert rows(clustering.cluster(vectors_of(spark, data), 3, 2)) == plain_clusters(held, 3, 2)


def test_few_vectors_null_ids_and_none(spark):
    assert clustering.cluster(vectors_of(spark, [])).isEmpty()
    got = rows(clustering.cluster(vectors_of(spark, [(None, [1.0] * 64), (1, [2.0] * 64)])))
    assert [(r[0], r[1], r[2]) for r in got] == [(1, 0, 0), (None, 1, 0)]
    single = spark.createDataFrame([(1, [0.5] * 64, 3)], "vec_id int, embedding array<float>, inertia int")
    assert rows(clustering.cluster(single))[0][:5] == (1, 0, 0, 0, 0)


def test_bounds_are_below_distances_and_prune():
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 64)) * 300
    q = np.floor(centers[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 64)) * 40).astype(np.int64)
    centroids = np.floor(centers).astype(np.int64)
    low, margin = clustering.bounds(clustering.compress(q), clustering.compress(centroids))
    true = ((q[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    assert (low - margin <= true).all()
    nearest, distance, computed = clustering.assign(q, clustering.compress(q), centroids)
    assert (nearest == true.argmin(axis=1)).all() and distance == true.min(axis=1).tolist()
    assert computed < 0.2 * true.size


# ---- mixing


def test_targets_are_dealt_again_until_none_is_above():
    assert mixing.targets([10, 10, 10], [3, 1, 2]) == [20, Fraction(25, 3), Fraction(50, 3)]
    assert mixing.targets([100, 1, 1], [3, 1, 2]) == [149, 2, 2]
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [1, 1]) == [0, Fraction(15, 2)]
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 7, 100, 10**6]) for _ in range(rng.randint(1, 9))]
        got = mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))])
        assert sum(got) == Fraction(3, 2) * sum(sizes) and all(g <= 2 * s for g, s in zip(got, sizes, strict=True))


def flow_cost(taken, capacities):
    return sum(c * (t // c) * (t // c - 1) // 2 + (t % c) * (t // c) if c else 0 for t, c in ((taken[p], capacities[p]) for p in capacities))


def test_flow_is_largest_and_cheapest():
    """All ways to take whole words of small patterns, by Hall's condition on sets of sources."""
    rng = random.Random(8)
    for _ in range(60):
        sources = "abc"[: rng.randint(1, 3)]
        patterns = rng.sample([p for n in range(1, len(sources) + 1) for p in itertools.combinations(sources, n)], rng.randint(1, min(4, 2 ** len(sources) - 1)))
        capacities = {p: rng.randint(0, 3) for p in patterns}
        quotas = {s: rng.randint(0, 5) for s in sources}

        def fits(taken):
            groups = [set(g) for n in range(1, len(sources) + 1) for g in itertools.combinations(sources, n)]
            return all(sum(t for p, t in taken.items() if set(p) <= g) <= sum(quotas[s] for s in g) for g in groups)

        options = [dict(zip(patterns, t, strict=True)) for t in itertools.product(*(range(2 * capacities[p] + 1) for p in patterns))]
        good = [t for t in options if fits(t)]
        most = max(sum(t.values()) for t in good)
        least = min(flow_cost(t, capacities) for t in good if sum(t.values()) == most)
        got = mixing.route(capacities, quotas)
        assert fits(got) and sum(got.values()) == most and flow_cost(got, capacities) == least


def texts_of_sizes(rng, n):
    return [(i, " ".join("w" for _ in range(max(1, int(rng.lognormvariate(4, 1.2))))), rng.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(n)]


def test_mixed_sources_near_their_targets(spark):
    docs = texts_of_sizes(random.Random(4), 3000) + [(5000, None, "a"), (5001, " \n", "b"), (5002, "x y z\x0bw", "zz"), (None, "one two", "a"), (7, "again the id seven", "b"), (7, "again the id seven", "b")]
    frame = spark.createDataFrame([(*d, 1.5) for d in docs], "doc_id long, text string, source string, taken double")
    got = mixing.mix_by_source(frame.repartition(7))
    out = got.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size, r.source) for r in out if r.doc_id is not None) == sorted((i, size(t), s) for i, t, s in docs if i is not None) if all(s for _, _, s in docs) else len(out) == len(docs)
    names = sorted({s for _, _, s in docs if s is not None}) + [None]
    sizes = {s: sum(size(t) for _, t, x in docs if x == s) for s in names}
    aims = dict(zip(names, mixing.targets(list(sizes.values()), [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    for s in names:
        own = [r for r in out if r.source == s]
        assert {(r.source_size, r.target) for r in own} == {(sizes[s], float(aims[s]))}
        assert abs(sum(r.taken for r in own) - aims[s]) <= max(4, 0.005 * float(aims[s]))
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)
    assert rows(mixing.mix_by_source(frame.repartition(3))) == rows(got)


def test_overlapping_sources_share_documents(spark):
    docs = [(i, 10, ["a"]) for i in range(100)] + [(100 + i, 10, ["a", "b"]) for i in range(100)] + [(200 + i, 10, ["b", "b"]) for i in range(10)] + [(300, 10, None), (301, 10, []), (302, None, ["a"]), (303, 10, ["none"])]
    frame = spark.createDataFrame(docs, "doc_id long, size long, sources array<string>")
    got = {r.doc_id: r for r in mixing.mix(frame, {"a": 1000, "b": 1100}).collect()}
    part = lambda lo, hi: sum(r.taken for i, r in got.items() if lo <= i < hi)
    # once each first: b takes what both share, a its own, nothing is read twice
    assert part(0, 100) == 1000 and part(100, 200) == 1000 and part(200, 210) == 100 and all(r.repeats <= 1 for r in got.values())
    assert all(got[i].taken == 0 for i in (300, 301, 302, 303))
    more = mixing.mix(frame, {"a": 2000, "b": 1150}).agg(F.sum("taken").alias("t"), F.max("repeats").alias("r")).first()
    assert (more["t"], more["r"]) == (3150, 2)


def test_cuts_go_deeper_where_ranges_are_full(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 3)
    monkeypatch.setattr(mixing, "BITS", 2)
    frame = spark.createDataFrame([(i, 1 + i % 5, ["s"]) for i in range(2000)], "doc_id long, size long, sources array<string>")
    assert mixing.mix(frame, {"s": 1234}).agg(F.sum("taken")).first()[0] == 1234


def test_mixing_of_empty_tables_and_too_many_sources(spark, monkeypatch):
    assert mixing.mix_by_source(spark.createDataFrame([], "doc_id long, text string, source string")).isEmpty()
    assert rows(mixing.mix_by_source(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string"))) == [(1, 0, 0, 0.0, 0, 0, None)]
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    with pytest.raises(ValueError):
        mixing.mix_by_source(spark.createDataFrame([(i, "x", str(i)) for i in range(3)], "doc_id long, text string, source string"))


# ---- spelling


def plain_variants(docs):
    """Words by the contract; near words by all single edits with the letters that occur."""
    counts = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] = counts.get(w, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    letters = {c for w in words for c in w}
    near = {}
    for w in words:
        some = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near[w] = [v for v in some if v != w and v in words]
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()), key=repr)


def misspelt(rng, n, letters):
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(12)]
    docs = []
    for i in range(n):
        text = []
        for _ in range(60):
            w = rng.choice(stems[: 1 + int(rng.expovariate(0.4)) % 12])
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            text.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", ", ", "-1-"]).join(text)))
    return docs


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz", "aÀÿéß×"])
def test_variants_equal_brute_force(spark, letters):
    docs = misspelt(random.Random(len(letters)), 150, letters)
    docs += [(None, "Straßen straßen STRAßEN"), (None, None), (1, ""), (1, docs[1][1]), (2, "x" * 5000 + " " + "x" * 5000), (3, "x" * 5000 + "y " + "x" * 5000 + "y"), (4, "ЖЖЖЖЖЖЖЖ ЖЖЖЖЖЖЖЖ")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int")
    expected = plain_variants(docs)
    assert rows(spelling.variants(frame.repartition(6))) == expected
    assert any(r[1] for r in expected) and any(r[2] != (r[1] or r[0]) for r in expected) or letters != "ab"


def test_hot_keys_are_split_and_nothing_is_lost(spark, monkeypatch):
    """Words of one family under few keys: postings are split before and after the shuffle."""
    rng = random.Random(3)
    words = sorted({"abc" + "".join(rng.choice("de") for _ in range(7)) + "fgh"[: rng.randint(1, 3)] for _ in range(400)})
    frame = spark.createDataFrame([(w, 2 + i) for i, w in enumerate(words)], "word string, n long")
    plain = set()
    known = set(words)
    for w in words:
        for i in range(len(w) + 1):
            plain |= {(w, v) for c in "abcdefgh" for v in (w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]) if v != w and v in known} | {(w, v) for v in [w[:i] + w[i + 1 :]] if v != w and v in known}
    plain |= {(b, a) for a, b in plain}
    for few, most in ((24, 20_000), (3, 20_000), (3, 40), (24, 10)):
        monkeypatch.setattr(spelling, "FEW", few)
        ranks = spelling.gram_ranks(frame)
        assert ranks.shape == (65536,)
        got = [(r.word, r.near) for r in spelling.near_words(frame, most).collect()]
        assert len(got) == len(set(got)) and set(got) == plain, (few, most)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    assert rows(spelling.variants(spark.createDataFrame([(5, "singular elephant elephant short short")], "doc_id long, text string"))) == plain_variants([(5, "singular elephant elephant short short")])


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w20")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(chain).collect()} == {**{f"w{i}": "w37" for i in range(37)}, "x": "w37"}
