"""Quality classifier against a plain version; held-out recall of toxicity; scores of very long texts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import quality, toxicity

WORDS = ["alpha", "Beta", "GAMMA", "delta", "x1", "42", "don't", "été", "...", "e-mail", "FooBar", "a"]


def texts_of(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 9))) for _ in range(n)]


def shape_of(word):
    """Kinds of bytes, runs as one: upper case, lower case and what isn't ASCII, digits, each other byte for itself."""
    kinds = ["A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 or b >= 128 else "0" if 48 <= b <= 57 else b for b in word.encode()]
    return tuple(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])


def plain_indicators(text):
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in text.split()]
    shapes = ["again" if i and words[i - 1] == words[i] else shape_of(w) for i, w in enumerate(text.split())]
    found = {("word", w) for w in words} | {("shape", s) for s in shapes}
    found |= {("words", *pair) for pair in zip(words, words[1:], strict=False)}
    found |= {("shapes", *pair) for pair in zip(shapes, shapes[1:], strict=False)}
    return found | {("three", *three) for three in zip(shapes, shapes[1:], shapes[2:], strict=False)}


def buckets_of(texts):
    data = [t.encode() for t in texts]
    ends = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    row, bucket = quality.indicators(np.frombuffer(b"".join(data), np.uint8), ends)
    return [bucket[row == i] for i in range(len(texts))]


def test_indicators_equal_plain_ones():
    texts = [*texts_of(1, 12), "", "Same same SAME", "alpha"]
    plain, got = [plain_indicators(t) for t in texts], [set(b.tolist()) for b in buckets_of(texts)]
    for i, a in enumerate(plain):
        for j, b in enumerate(plain):
            assert len(a & b) == len(got[i] & got[j]), (texts[i], texts[j])


def plain_margins(rows, labels, cost, smoothing, buckets, rounds):
    """Log-count ratios, unit rows and dual coordinate descent in plain Python; both classes weigh the same in all."""
    counts = {side: {} for side in (0, 1)}
    for grams, y in zip(rows, labels, strict=True):
        for g in grams:
            counts[y][g] = counts[y].get(g, 0) + 1
    whole = {side: sum(counts[side].values()) + smoothing * buckets for side in (0, 1)}
    ratio = {g: math.log((counts[1].get(g, 0) + smoothing) / whole[1]) - math.log((counts[0].get(g, 0) + smoothing) / whole[0]) for g in counts[0] | counts[1]}
    unit = []
    for grams in rows:
        norm = math.sqrt(sum(ratio[g] ** 2 for g in grams))
        unit.append({g: ratio[g] / norm for g in grams} if norm else {})
    upper = [cost * len(labels) / (2 * labels.count(y)) for y in labels]
    sign, alpha, weight, bias = [1 if y else -1 for y in labels], [0.0] * len(labels), {}, 0.0
    margin = lambda x: sum(weight.get(g, 0.0) * v for g, v in x.items()) + bias
    for _ in range(rounds):
        for i, x in enumerate(unit):
            new = min(max(alpha[i] - (sign[i] * margin(x) - 1) / (sum(v * v for v in x.values()) + 1), 0.0), upper[i])
            step, alpha[i] = (new - alpha[i]) * sign[i], new
            bias += step
            for g, v in x.items():
                weight[g] = weight.get(g, 0.0) + step * v
    return [margin(x) for x in unit], sum(w * w for w in weight.values()) + bias * bias - 2 * sum(alpha)


def test_margins_equal_a_plain_fit():
    texts = [t for t in texts_of(2, 40) if t]
    labels = [int("alpha" in t) if i % 7 else i % 2 for i, t in enumerate(texts)]
    rows = buckets_of(texts)
    model = quality.fit(rows, np.array(labels), rounds=3000)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    got = model.margins(row, np.concatenate(rows), len(rows))
    expected, _ = plain_margins([r.tolist() for r in rows], labels, 4.0, 1.0, quality.BUCKETS, 3000)
    assert np.abs(got - np.array(expected)).max() < 1e-2
    scores = model.scores(got)
    assert list(np.argsort(scores)) == list(np.argsort(got)) and 0 <= scores.min() and scores.max() <= 1


def test_quality_of_very_long_texts(spark):
    rng = random.Random(3)
    good, bad = ["clear", "prose", "written", "with", "care"], ["BUY!!!", "$$$", "click", "4free", "NOW"]
    short = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(40)), i % 2) for i in range(60)]
    long_ones = [(100, " ".join(rng.choice(good) for _ in range(500_000))), (101, " ".join(rng.choice(bad) for _ in range(500_000))), (102, "x" * 3_000_000), (103, None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in short] + long_ones, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in short], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert got[100].predicted == 1 and got[101].predicted == 0 and got[101].score < 0.3
    assert all(0 <= got[i].score <= 1 for i in (102, 103))


# found and held-out toxic texts when this was written: 4 of 6 and 91 of 97; the others hold no term of the lexicon
@pytest.mark.parametrize("folder, least", [("sf0.01", 0.6), ("sf0.1", 0.93)])
def test_toxic_texts_are_found(spark, folder, least):
    read = lambda name: spark.read.parquet(f"/root/testdata/{folder}/{name}.parquet")
    labels = read("labels").select("doc_id", "toxic")
    held = toxicity.judge(read("documents"), labels).where("held_out").join(labels, "doc_id")
    r = held.where("toxic = 1").agg(F.avg("predicted").alias("recall"), F.count("*").alias("n")).first()
    assert r.n >= 6 and r.recall >= least
