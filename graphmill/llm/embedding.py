"""Near-duplicate embeddings by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions and the projections are
quantised; six of them make a key, twenty-four keys make the tables. Vectors that
share a key and a label are compared exactly, by cosine in double precision.

At a cosine of 0.98 two unit vectors lie 0.2 apart and share a quantised
projection of width 0.8 with probability 0.80, a key with 0.26, some key with
0.9993. Equal vectors are one representative with a count. A bucket is cut into
blocks, and each pair of blocks is a task's share, so no group is held whole; a
pair of vectors counts in the first table that holds both, and of the links only
counts and a spanning star leave the worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import components, lean, mix, small_batches, table

TABLES, PROJECTIONS, WIDTH = 24, 6, 0.8
#: Representatives in a block of a bucket.
BLOCK = 512


def projections(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([11, dim]))
    return rng.standard_normal((dim, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS), rng.integers(1, 2**62, PROJECTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _rows(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) of the usable rows, by dimension."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        vectors = values[starts[rows][:, None] + np.arange(dim)[None, :]]
        good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
        if good.any():
            yield rows[good], vectors[good]


CODED = "vec_id long, label long, embedding array<{}>, digest binary, codes array<long>"


@lean
def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels = batch.column(0), batch.column(1)
        # single precision is kept where the vectors come so; all arithmetic is double
        kind = pa.float32() if batch.column(2).type.value_type == pa.float32() else pa.float64()
        for rows, vectors in _rows(batch.column(2)):
            vectors = vectors + 0.0  # no negative zeros
            directions, shifts, odd = projections(vectors.shape[1])
            cells = np.floor((unit(vectors) @ directions + shifts) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(rows), TABLES, PROJECTIONS)
            codes = mix((cells * odd).sum(axis=2, dtype=np.uint64)).view(np.int64)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(at),
                    labels.take(at),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.ravel()).cast(kind)),
                    pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in vectors], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * TABLES), pa.array(codes.ravel())),
                ],
                names=["vec_id", "label", "embedding", "digest", "codes"],
            )


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row each row is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    schema = pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def cell(block: pa.Table) -> pa.RecordBatch | None:
        """Rows of one pair of blocks; own: 0 or 1, the block; equal blocks come once, as 0."""
        ids, weight, number = (block.column(k).to_numpy() for k in ("doc", "copies", "nr"))
        side = block.column("side").to_numpy()
        dim = len(block.column("embedding")[0])
        vectors = unit(block.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim))
        codes = block.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, TABLES)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = np.nonzero(vectors[left] @ (vectors[right] if len(right) else vectors[left]).T >= threshold)
        if len(right):
            i, j = left[i], right[j]
        else:
            i, j = left[i][i < j], left[j][i < j]
        first = np.ones(len(i), bool)
        for t in range(int(number[0])):
            first &= codes[i, t] != codes[j, t]
        i, j = i[first], j[first]
        if len(i) == 0:
            return None
        counts = np.zeros(len(ids), np.int64)
        np.add.at(counts, i, weight[j])
        np.add.at(counts, j, weight[i])
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(ids))
        roots = ids[order][_stars(len(ids), place[i], place[j])][place]
        some = counts > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(counts[some]), pa.array(roots[some])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("key", "p", "q")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                own = tuple(keys[a])
                if own != key and held:
                    if sum(map(len, held)) > 1 and (out := cell(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                key = own
                held.append(batch.slice(a, b - a))
        if sum(map(len, held)) > 1 and (out := cell(pa.Table.from_batches(held))) is not None:
            yield out

    return lean(run)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors (vec_id, embedding, label).

    Only vectors with equal labels are compared. A vector that is null, empty or
    zero, or holds null or non-finite components, or whose label or id is null,
    links with nothing: n_links 0, its own component, kept. Vectors of different
    dimensions never link. Repeated rows are vectors of their own and count as
    each other's links; other columns are ignored.
    """
    small_batches(vectors.sparkSession)
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding"))
    usable = plain.where("vec_id is not null and label is not null and embedding is not null")
    kind = "float" if dict(usable.dtypes)["embedding"] == "array<float>" else "double"
    coded = table(usable.mapInArrow(_code, CODED.format(kind)), "embedding-coded")
    classes = coded.groupBy("label", "digest").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    members = table(coded.select("vec_id", "label", "digest").join(classes, ["label", "digest"]).select("vec_id", "class_id", "label", "digest", "copies"), "embedding-members")
    # a repeated id may be smallest in more than one class: label and digest tell its vectors apart
    heads = members.where("vec_id = class_id").select("vec_id", "label", "digest", "copies").distinct()
    unique = coded.dropDuplicates(["vec_id", "label", "digest"])
    representatives = table(unique.join(heads, ["vec_id", "label", "digest"]), "embedding-representatives")
    keys = representatives.select("vec_id", "label", F.size("embedding").alias("dim"), F.posexplode("codes").alias("nr", "code")).select(
        "vec_id", "nr", F.xxhash64("label", "dim", "nr", "code").alias("key")
    )
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = keys.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("vec_id", "key"), F.col("blocks")).cast("int"))
    spread = placed.select("key", "nr", "vec_id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = spread.select(
        "key", "nr", "vec_id", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).cast("int").alias("side")
    )
    full = cells.join(representatives.select("vec_id", "copies", "embedding", "codes"), "vec_id").select("key", "p", "q", "nr", "side", F.col("vec_id").alias("doc"), "copies", "embedding", "codes")
    together = full.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    found = table(together.mapInArrow(_compare(threshold), "vec_id long, links long, root long"), "embedding-found")
    linked = components(found.where("vec_id <> root").select(F.col("vec_id").alias("src"), F.col("root").alias("dst")).distinct(), "embedding")
    counted = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    per_class = (
        members.join(counted.withColumnRenamed("vec_id", "class_id"), "class_id", "left")
        .join(linked.withColumnRenamed("id", "class_id"), "class_id", "left")
        .groupBy("vec_id")
        .agg(F.max(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.min(F.coalesce("component", "class_id")).alias("component_id"))
    )
    out = plain.select("vec_id").join(per_class, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
