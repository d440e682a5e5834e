"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Words and word bigrams, and the shapes of words in runs of one to three, are
hashed to buckets; a document has each bucket or not. Each indicator is scaled by
the log ratio of its class counts, rows are brought to length 1, and a linear
hinge-loss model is fitted by dual coordinate descent. A logistic curve over its
margins gives the score.

The fit takes at most `most_rows` labelled documents of each class, those with
the smallest hash of their id: a bound that doesn't grow with the data. Scoring
takes all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import lean, mix, release, running_hash, small_batches, span_hash, utf8_parts, word_spans

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Rows of each class that the fit may take.
MOST_ROWS = 3000

_RNG = np.random.Generator(np.random.PCG64(2))
_CLASS = np.arange(256)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 2
_CLASS[48:58] = 3
_CLASS_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_WORD_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_WORD_VALUE[65:91] = _WORD_VALUE[97:123]
_KIND = _RNG.integers(1, 2**63, 8, dtype=np.uint64)
_ODD = _RNG.integers(1, 2**62, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every indicator of the rows' texts, each once, in order of rows."""
    starts, ends = word_spans(data, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    word = mix(span_hash(running_hash(data, _WORD_VALUE), starts, ends))
    kind = _CLASS[data]
    run = np.ones(len(data), bool)
    run[1:] = kind[1:] != kind[:-1]
    run[starts] = True
    place = np.concatenate(([0], np.cumsum(run)))
    shape = mix(span_hash(running_hash(kind[run], _CLASS_VALUE), place[starts], place[ends]))
    with_last = row[1:] == row[:-1]
    again = np.zeros(len(word), bool)
    again[1:] = with_last & (word[1:] == word[:-1])
    shape[again] = _KIND[7]
    grams = [(row, word + _KIND[0]), (row, shape + _KIND[1])]
    if len(word) > 1:
        grams.append((row[1:][with_last], (word[:-1] * _ODD[0] + word[1:] + _KIND[2])[with_last]))
        grams.append((row[1:][with_last], (shape[:-1] * _ODD[0] + shape[1:] + _KIND[3])[with_last]))
    if len(word) > 2:
        two = row[2:] == row[:-2]
        grams.append((row[2:][two], (shape[:-2] * _ODD[1] + shape[1:-1] * _ODD[0] + shape[2:] + _KIND[4])[two]))
    keys = np.concatenate([r << BUCKET_BITS | (mix(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) for r, h in grams])
    keys = np.unique(keys)
    return keys >> BUCKET_BITS, keys & (BUCKETS - 1)


class Model:
    """weights: of each bucket, scaled by its log ratio; squares: of the log ratios; bias; curve: slope and shift of the score."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray, bias: float, curve: tuple[float, float]) -> None:
        self.weights, self.squares, self.bias, self.curve = weights, squares, bias, curve

    def margins(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        norm = np.sqrt(np.bincount(row, self.squares[bucket], n))
        return np.bincount(row, self.weights[bucket], n) / np.where(norm > 0, norm, 1) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        slope, shift = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * margins + shift, -500, 500)))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 4.0, smoothing: float = 1.0, rounds: int = 30, seed: int = 5) -> Model:
    """rows: the buckets of each document; labels: 0 or 1. With one class only, or no rows, every score is that class (1 without rows)."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, (0.0, 20.0 if len(labels) == 0 or labels[0] == 1 else -20.0))
    good, bad = (np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == side] or [np.zeros(0, np.int64)]), minlength=BUCKETS) for side in (1, 0))
    ratio = np.log((good + smoothing) / (good + smoothing).sum()) - np.log((bad + smoothing) / (bad + smoothing).sum())
    ratio[(good + bad) == 0] = 0
    values = []
    for r in rows:
        x = ratio[r]
        norm = np.sqrt((x * x).sum())
        values.append(x / norm if norm > 0 else x)
    y = np.where(labels == 1, 1.0, -1.0)
    # both classes weigh the same in all
    upper = np.where(labels == 1, cost * len(labels) / (2 * labels.sum()), cost * len(labels) / (2 * (1 - labels).sum()))
    weight, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(labels))
    size = np.array([(x * x).sum() + 1 for x in values])
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(labels)):
            gradient = y[i] * (weight[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / size[i], 0.0), upper[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                weight[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    margins = np.array([weight[r] @ x + bias for r, x in zip(rows, values, strict=True)])
    return Model(weight * ratio, ratio * ratio, bias, _curve(margins, labels))


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton's method, towards targets a little inside 0 and 1."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(labels == 1, 0.5 / n1, 0.5 / n0) * len(labels)
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    beta = np.array([1.0, 0.0])
    loss = lambda b: float((weight * (np.logaddexp(0, x @ b) - target * (x @ b))).sum() + 1e-3 * b @ b)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (weight * (p - target)) + 2e-3 * beta
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2)
        step = np.linalg.solve(curvature, slope)
        scale = 1.0
        while scale > 1e-6 and loss(beta - scale * step) > loss(beta):
            scale /= 2
        beta = beta - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def labelled_sample(labels: DataFrame, label: str, folds: int, held_out: int, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, label of at most most_rows documents of each class outside the held-out fold of crc32(doc_id), smallest hash first.

    Null labels and ids don't count, nor ids with rows of both classes; a repeated id counts once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    learn = known.where(F.crc32(F.col("doc_id").cast("string")) % folds != held_out).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    side = lambda v: learn.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    return side(0).unionByName(side(1))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


@lean
def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in utf8_parts(batch.column(2)):
            n = len(offsets) - 1
            row, bucket = indicators(data, offsets)
            ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            buckets = pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), buckets], names=["doc_id", "label", "buckets"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, fold: int = 2, most_rows: int = MOST_ROWS, **options: float) -> Model:
    """Fit on the labelled documents outside the held-out fold.

    Of each class most_rows documents reach the driver at most, each once (of texts
    that repeat a doc_id the smallest), as their distinct buckets.
    """
    small_batches(docs.sparkSession)
    sample = F.broadcast(labelled_sample(labels, label, folds, fold, most_rows))  # at most 2 * most_rows rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    got = rows.select("doc_id", "label", "text").mapInArrow(_sampled, "doc_id long, label int, buckets array<int>").toArrow().sort_by("doc_id")
    buckets = got.column("buckets").combine_chunks()
    if isinstance(buckets, pa.ChunkedArray):
        buckets = pa.concat_arrays(buckets.chunks)
    flat, ends = buckets.flatten().to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(buckets.value_lengths().to_numpy()))) if len(buckets) else np.zeros(1, np.int64)
    return fit([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], got.column("label").to_numpy().astype(np.int64), **options)


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the column `to`, 0 to 1; a null or empty text gets the score of a row without indicators."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(column: pa.Array) -> pa.Array:
        release()
        m, out = shared.value, []
        for _, data, offsets in utf8_parts(column):
            out.append(m.margins(*indicators(data, offsets), len(offsets) - 1))
        return pa.array(m.scores(np.concatenate(out)) if out else [], pa.float64())

    return docs.withColumn(to, scores(F.col(text).cast("string")))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, fold: int = 2, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs (doc_id, text), repeated rows too.

    Only labels outside the held-out fold are learnt. A null doc_id is never
    held out; null labels don't count; other columns are ignored.
    """
    model = train(docs, labels, folds=folds, fold=fold, most_rows=most_rows)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
