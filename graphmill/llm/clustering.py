"""Centroid clustering of integer vectors, with block norms to screen the centroids.

A vector's components are quantised to integers and its 64 places cut into eight
segments. Of each segment two numbers are computed once and kept beside the vector:
its sum over the square root of its length, and the norm of what remains when the
mean is taken off. Of these compressed vectors the Cauchy-Schwarz inequality, segment
by segment, gives a lower bound of the squared distance from a centroid:

    |x - c|^2  >=  sum over segments of (sum_x - sum_c)^2 / 8 + (rest_x - rest_c)^2

The centroid with the least bound is measured exactly, in integers; a centroid whose
bound, less a margin for rounding, is above that distance is pruned, and only the
others get exact distances. A round is one pass over the vectors: a task sums its own
clusters, and what meets is a row for each cluster, place and task. The driver holds
the centroids, clusters times 64 numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import lean, small_batches, table

DIM, SEGMENT, SCALE = 64, 8, 256
#: Components are held to this; its square times 64 and twice that fits in no long.
LARGEST = 1 << 62
#: Below this, squared distances are exact in 64 bits.
NARROW = 1 << 27
MOST_LONG = (1 << 63) - 1
#: Part of the squared norms that a bound may be wrong by.
MARGIN = 1e-9
#: Exact distances that a worker computes at once.
BLOCK = 1 << 15

QUANTISED = "vec_id long, q array<long>, compressed array<double>"


def compress(q: np.ndarray) -> np.ndarray:
    """Per segment its scaled sum and the norm of its rest: two numbers for eight."""
    parts = q.astype(np.float64).reshape(len(q), -1, SEGMENT)
    mean = parts.mean(axis=2, keepdims=True)
    rest = np.sqrt(((parts - mean) ** 2).sum(axis=2))
    return np.concatenate([mean[:, :, 0] * SEGMENT**0.5, rest], axis=1)


def bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the squared distances between compressed rows, and what rounding may add to them."""
    norms = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :]
    return norms - 2 * (x @ c.T), MARGIN * norms


def assign(q: np.ndarray, compressed: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, list[int], int]:
    """Each row's nearest centroid (ties: the smaller number), its squared distance, and how many distances were computed."""
    n, k = len(q), len(centroids)
    if n == 0:
        return np.zeros(0, np.int32), [], 0
    if max(np.abs(centroids).max(), np.abs(q).max()) >= NARROW:  # rare: Python's integers for all
        wide = [[sum((int(a) - int(b)) ** 2 for a, b in zip(row, c, strict=True)) for c in centroids] for row in q]
        best = [min(range(k), key=lambda j, d=d: (d[j], j)) for d in wide]
        return np.array(best, np.int32), [d[j] for d, j in zip(wide, best, strict=True)], n * k
    low, margin = bounds(compressed, compress(centroids))
    rows, first = np.arange(n), low.argmin(axis=1)
    distance = np.full((n, k), MOST_LONG, np.int64)
    distance[rows, first] = ((q - centroids[first]) ** 2).sum(axis=1)
    open_ = low - margin <= distance[rows, first][:, None]
    open_[rows, first] = False
    i, j = np.nonzero(open_)
    for at in range(0, len(i), BLOCK):
        a, b = i[at : at + BLOCK], j[at : at + BLOCK]
        distance[a, b] = ((q[a] - centroids[b]) ** 2).sum(axis=1)
    nearest = distance.argmin(axis=1)
    return nearest.astype(np.int32), distance[rows, nearest].tolist(), n + len(i)


@lean
def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        x = np.floor(batch.column(1).flatten().cast(pa.float64()).to_numpy().reshape(n, DIM) * SCALE)
        q = np.where(np.abs(x) < LARGEST, x, 0).astype(np.int64) + (np.abs(x) >= LARGEST) * np.sign(x).astype(np.int64) * LARGEST
        short = compress(q)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * DIM), pa.array(q.ravel())),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * short.shape[1]), pa.array(short.ravel())),
            ],
            names=["vec_id", "q", "compressed"],
        )


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    return batch.column("q").flatten().to_numpy().reshape(n, DIM), batch.column("compressed").flatten().to_numpy().reshape(n, 2 * DIM // SEGMENT)


def _sums(centroids: list[list[int]]):
    """Per cluster and place the sums of a task's vectors, in two halves of 31 bits and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        count = np.zeros(len(c), np.int64)
        high, low = np.zeros_like(c), np.zeros_like(c)
        for batch in batches:
            if batch.num_rows:
                q, compressed = _rows(batch)
                nearest = assign(q, compressed, c)[0]
                count += np.bincount(nearest, minlength=len(c))
                np.add.at(high, nearest, q >> 31)
                np.add.at(low, nearest, q & ((1 << 31) - 1))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(some, DIM).astype(np.int32)),
                pa.array(np.tile(np.arange(DIM, dtype=np.int32), len(some))),
                pa.array(np.repeat(count[some], DIM)),
                pa.array(high[some].ravel()),
                pa.array(low[some].ravel()),
            ],
            names=["cluster", "place", "n", "high", "low"],
        )

    return lean(run)


def _assigned(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        for batch in batches:
            if batch.num_rows:
                nearest, distance, _ = assign(*_rows(batch), c)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(nearest), pa.array([min(d, MOST_LONG) for d in distance], pa.int64())], names=["vec_id", "cluster", "distance"]
                )

    return lean(run)


def usable(vectors: DataFrame) -> DataFrame:
    """The vectors with exactly 64 components, none null or non-finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    wanted = F.when(F.size("embedding") == DIM, ~F.exists("embedding", odd)).otherwise(False)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(wanted)


def fit(quantised: DataFrame, clusters: int, rounds: int, salt: str) -> list[list[int]]:
    """The centroids after so many rounds: at most `clusters` rows of 64 integers.

    They start as the vectors with the smallest sha256 of salt and id, in that order; a
    null id comes last, rows that repeat an id come by their components. Fewer vectors
    give fewer centroids.
    """
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    centroids = [list(r["q"]) for r in quantised.select("q", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "q").limit(clusters).collect()]
    for _ in range(rounds if centroids else 0):
        exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
        parts = quantised.mapInArrow(_sums(centroids), "cluster int, place int, n long, high long, low long")
        for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), exact("high"), exact("low")).collect():
            centroids[r["cluster"]][r["place"]] = ((int(r["high"]) << 31) + int(r["low"])) // r["n"]
    return centroids


def cluster(vectors: DataFrame, clusters: int = 40, rounds: int = 5, salt: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each usable row of vectors (vec_id, embedding).

    Vectors that are null, have not 64 components or hold null or non-finite ones give
    no row; repeated rows are vectors of their own; no usable vector gives no row.
    Other columns are ignored. Components become floor(256 x), held to 2**62 at either
    side; distances and their sums that no long can hold are given as the largest long,
    but vectors are dealt and centroids computed by their true values.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    quantised = table(usable(vectors).mapInArrow(_quantise, QUANTISED), "clustering-quantised")
    centroids = fit(quantised, clusters, rounds, salt)
    assigned = table(quantised.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "clustering-assigned")
    # at most `clusters` rows
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    whole = min(sum(inertia.values()), MOST_LONG)
    facts = [(c, min(t, MOST_LONG), whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, t in sorted(inertia.items())]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
