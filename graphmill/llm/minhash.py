"""Near-duplicate documents by b-bit MinHash.

Full minima of 128 permutations give 32 band keys of four rows; of each minimum
only four bits of its mixed value are kept, packed into eight longs. Documents that
share a band key are candidates; bit counts of the packed signatures, corrected for
the chance of agreeing by accident (1 / 16), estimate their similarity, and what may
reach the threshold is confirmed on the full shingle sets.

Documents with equal shingle sets form a class; one representative stands for it,
so copies are never expanded into pairs. In a bucket every representative is
compared with the smallest one first; afterwards only representatives that are
still in different components are compared, and of these only those that the
triangle inequality leaves open: Jaccard distance is a metric, so two whose
distances from the smallest one differ by more than the threshold's distance
can't be linked. Those few documents get a finer signature, 1024 permutations of
two bits. A link between different texts is thus confirmed, ruled out or
needless for the components.

At a similarity of 0.75 a pair shares no band with probability
(1 - 0.75 ** 4) ** 32 = 5e-6; the estimate rejects a true link with a
probability below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import components, lean, mix, shingles_of, small_batches, table, utf8_parts, words_of

PERMUTATIONS, BANDS, ROWS, BITS = 128, 32, 4, 4
FINE_PERMUTATIONS, FINE_BITS = 1024, 2
WORDS = PERMUTATIONS * BITS // 64
#: Classes of copies that may be broadcast.
MOST_HOT = 1000
_RNG = np.random.Generator(np.random.PCG64(7))
_A = (_RNG.integers(0, 2**31, FINE_PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.integers(0, 2**32, FINE_PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]
_BAND = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64)

FEATURES = "doc_id long, n_shingles long, set_hash binary, bands array<long>, " + ", ".join(f"s{i} long" for i in range(WORDS))
FINE = "doc_id long, " + ", ".join(f"f{i} long" for i in range(FINE_PERMUTATIONS * FINE_BITS // 64))


def minima(shingles: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """The smallest value of each permutation over a non-empty set of 64-bit hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(permutations, 0xFFFFFFFF, np.uint32)
    step = (1 << 18) // permutations
    for i in range(0, len(x), step):
        np.minimum(least, (x[None, i : i + step] * _A[:permutations] + _B[:permutations]).min(axis=1), out=least)
    return least


def pack(least: np.ndarray, bits: int) -> np.ndarray:
    """Some bits of each mixed minimum in 64-bit words.

    A multiplier is odd, so a minimum's own low bits depend on its shingle's only: two
    shingles would agree in all permutations or in none.
    """
    shift = np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits)
    some = mix(least.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return (some.reshape(-1, 64 // bits) << shift).sum(axis=1, dtype=np.uint64)


@lean
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, data, offsets in utf8_parts(batch.column(1)):
            words, at = words_of(data, offsets)
            n = len(offsets) - 1
            sizes, digests = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
            bands, packed = np.zeros((n, BANDS), np.uint64), np.zeros((n, WORDS), np.uint64)
            for i in range(n):
                own = np.unique(shingles_of(words[at[i] : at[i + 1]]))
                if len(own) == 0:
                    continue
                sizes[i] = len(own)
                spread = mix(own + np.uint64(0x9E3779B97F4A7C15))
                digests[i] = own.sum(dtype=np.uint64), spread.sum(dtype=np.uint64)
                least = minima(own)
                bands[i] = mix((least.astype(np.uint64).reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + _SEED)
                packed[i] = pack(least, BITS)
            some = np.flatnonzero(sizes > 0)
            list_ends = np.zeros(n + 1, np.int32)
            list_ends[1:] = np.cumsum(np.where(sizes > 0, BANDS, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, n),
                    pa.array(sizes),
                    pa.array([d.tobytes() for d in digests], pa.binary(), mask=sizes == 0),
                    pa.ListArray.from_arrays(pa.array(list_ends), pa.array(bands[some].view(np.int64).ravel())),
                    *(pa.array(packed[:, i].copy().view(np.int64)) for i in range(WORDS)),
                ],
                names=["doc_id", "n_shingles", "set_hash", "bands", *(f"s{i}" for i in range(WORDS))],
            )


def features(docs: DataFrame) -> DataFrame:
    """doc_id, set size, digest of the set (null: no words), band keys and packed low bits."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_features, FEATURES)


@lean
def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FINE.split(", ")]
    for batch in batches:
        for first, data, offsets in utf8_parts(batch.column(1)):
            words, at = words_of(data, offsets)
            n = len(offsets) - 1
            packed = np.zeros((n, len(names) - 1), np.uint64)
            for i in range(n):
                own = np.unique(shingles_of(words[at[i] : at[i + 1]]))
                if len(own):
                    packed[i] = pack(minima(own, FINE_PERMUTATIONS), FINE_BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *(pa.array(packed[:, k].copy().view(np.int64)) for k in range(packed.shape[1]))], names=names)


def disagreements(left: str, right: str, name: str = "s", permutations: int = PERMUTATIONS, bits: int = BITS) -> F.Column:
    """In how many of the low-bit groups two packed signatures differ."""
    ones = sum(1 << i for i in range(0, 64, bits))
    total = F.lit(0)
    for i in range(permutations * bits // 64):
        x = F.col(f"{left}.{name}{i}").bitwiseXOR(F.col(f"{right}.{name}{i}"))
        for step in range(bits.bit_length() - 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1 << step))
        total = total + F.bit_count(x.bitwiseAND(F.lit(ones)))
    return total


def most_disagreements(similarity: float, permutations: int = PERMUTATIONS, bits: int = BITS, deviations: float = 5.0) -> int:
    """What a pair at the threshold exceeds with the chance of so many standard deviations."""
    agree = similarity + (1 - similarity) / 2**bits
    return int(permutations * (1 - agree) + deviations * (permutations * agree * (1 - agree)) ** 0.5 + 1)


def distance_at_least(disagree: F.Column, deviations: float = 5.0) -> F.Column:
    """A Jaccard distance that a pair with so many disagreements hardly falls below."""
    agree = 1 - disagree / PERMUTATIONS
    most = agree + deviations * F.sqrt(agree * (1 - agree) / PERMUTATIONS)
    return F.greatest(F.lit(0.0), 1 - (most - 2.0**-BITS) / (1 - 2.0**-BITS))


def _confirm(similarity: float):
    percent = round(100 * similarity)

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for _, data, offsets in utf8_parts(column):
            words, at = words_of(data, offsets)
            for i in range(len(offsets) - 1):
                yield np.unique(shingles_of(words[at[i] : at[i + 1]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance, linked = [], []
            for x, y in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - common
                distance.append(1 - common / union if union else 1.0)
                linked.append(common > 0 and 100 * common >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())], names=["src", "dst", "distance", "linked"])

    return lean(run)


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) with the distance of their full shingle sets, and whether they reach the similarity."""
    with_text = (
        pairs.join(texts.select(F.col("doc_id").alias("src"), F.col("text").alias("src_text")), "src")
        .join(texts.select(F.col("doc_id").alias("dst"), F.col("text").alias("dst_text")), "dst")
        .select("src", "dst", "src_text", "dst_text")
    )
    return with_text.mapInArrow(_confirm(similarity), "src long, dst long, distance double, linked boolean")


def near_duplicates(docs: DataFrame, similarity: float = 0.75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs (doc_id, text, ...).

    Words: lower-cased A-Z, split at ASCII white space; a set holds the distinct
    five-word shingles, or the whole sequence if it is shorter. A null or empty
    text has an empty set, is linked with nothing and is kept. A null doc_id is
    never linked: component_id null, kept. Rows that repeat a doc_id are one
    document if their texts agree; otherwise each text links for itself and the
    id is reached by either. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = table(features(docs), "minhash-features")
    sets = every.where("set_hash is not null and doc_id is not null")
    classes = table(sets.groupBy("set_hash").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "minhash-classes", narrow=True)
    total = classes.agg(F.sum("copies").alias("n")).first()["n"] or 0
    # classes of more than a MOST_HOT-th of all rows: MOST_HOT at most, so their members need no shuffle
    hot = F.broadcast(classes.where(F.col("copies") > total / MOST_HOT).select("set_hash", F.col("class_id").alias("hot_id")))
    split = sets.select("doc_id", "set_hash").join(hot, "set_hash", "left")
    rest = split.where("hot_id is null").join(classes.select("set_hash", "class_id"), "set_hash")
    members = table(split.where("hot_id is not null").select("doc_id", F.col("hot_id").alias("class_id")).unionByName(rest.select("doc_id", "class_id")), "minhash-members", narrow=True)
    # a repeated doc_id of one class is one representative
    heads = classes.select(F.col("class_id").alias("doc_id"), "set_hash")
    representatives = table(sets.drop("n_shingles").join(heads, ["doc_id", "set_hash"], "left_semi").dropDuplicates(["doc_id", "set_hash"]).drop("set_hash"), "minhash-representatives")
    signatures = representatives.drop("bands")
    buckets = representatives.select(F.posexplode("bands").alias("band", "key"), "doc_id").select(F.xxhash64("band", "key").alias("key"), "band", "doc_id")
    leaders = buckets.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last").drop("last")
    shared = table(buckets.join(leaders, "key"), "minhash-buckets")
    most = most_disagreements(similarity)

    wanted = shared.select("doc_id").distinct()
    texts = table(docs.join(wanted, "doc_id"), "minhash-texts")
    x, y = signatures.alias("x"), signatures.alias("y")
    star = shared.where("doc_id <> leader").select(F.col("leader").alias("src"), F.col("doc_id").alias("dst")).distinct()
    estimated = (
        star.join(x, F.col("src") == F.col("x.doc_id")).join(y, F.col("dst") == F.col("y.doc_id")).select("src", "dst", disagreements("x", "y").alias("disagree"))
    )
    estimated = table(estimated.distinct(), "minhash-estimated")
    exact = table(confirmed(estimated.where(F.col("disagree") <= most).select("src", "dst"), texts, similarity), "minhash-exact")
    links = exact.where("linked").select("src", "dst")
    found = components(links, "minhash-first")
    known = estimated.join(exact, ["src", "dst"], "left").select(
        F.col("src").alias("leader"),
        F.col("dst").alias("doc_id"),
        F.coalesce("distance", distance_at_least(F.col("disagree"))).alias("low"),
        F.coalesce("distance", F.lit(1.0)).alias("high"),
    )
    labelled = (
        shared.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .join(known, ["leader", "doc_id"], "left")
        .select("key", "band", "doc_id", F.coalesce("component", "doc_id").alias("component"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"))
    )
    labelled = table(labelled.distinct(), "minhash-labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    rest = table(labelled.join(mixed, "key").join(representatives, "doc_id"), "minhash-rest")
    ambiguous = texts.join(rest.select("doc_id").distinct(), "doc_id").select("doc_id", "text")
    rest = table(rest.join(ambiguous.mapInArrow(_fine, FINE), "doc_id"), "minhash-fine")
    most_fine = most_disagreements(similarity, FINE_PERMUTATIONS, FINE_BITS)
    x, y = rest.alias("x"), rest.alias("y")
    first_shared = F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True) == F.col("x.band") + 1
    apart = F.greatest(F.col("x.low") - F.col("y.high"), F.col("y.low") - F.col("x.high"))
    later = (
        x.join(
            y,
            (F.col("x.key") == F.col("y.key"))
            & (F.col("x.doc_id") < F.col("y.doc_id"))
            & (F.col("x.component") != F.col("y.component"))
            & (apart <= 1 - similarity + 1e-9)
            & (disagreements("x", "y") <= most)
            & (disagreements("x", "y", "f", FINE_PERMUTATIONS, FINE_BITS) <= most_fine)
            & first_shared,
        )
        .select(F.col("x.doc_id").alias("src"), F.col("y.doc_id").alias("dst"))
        .distinct()
    )
    more = table(confirmed(later, texts, similarity).where("linked").select("src", "dst"), "minhash-more")
    # a doc_id whose rows hold several texts belongs to several classes
    several = members.groupBy("doc_id").agg(F.min("class_id").alias("src"), F.max("class_id").alias("last")).where("src < last").drop("last")
    bridges = members.join(several, "doc_id").where("src < class_id").select("src", F.col("class_id").alias("dst")).distinct()
    final = components(links.unionByName(more).unionByName(bridges), "minhash-final")
    by_class = members.select("doc_id", "class_id").join(final.withColumnRenamed("id", "class_id"), "class_id", "left")
    by_doc = by_class.groupBy("doc_id").agg(F.min(F.coalesce("component", "class_id")).alias("component_id"))
    out = every.select("doc_id", "n_shingles").join(by_doc, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, similarity: float = 0.75) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest doc_id, all columns kept.

    Rows without words, or with a null doc_id, all stay. Of rows that repeat a kept
    doc_id with words, one stays.
    """
    judged = near_duplicates(docs, similarity).where("doc_id is not null")
    own, shingles, kept = "_graphmill_id", "_graphmill_shingles", "_graphmill_kept"
    single = judged.groupBy(F.col("doc_id").alias(own)).agg(F.max("n_shingles").alias(shingles), F.max("kept").alias(kept))
    joined = docs.join(single, F.col("doc_id").cast("long") == F.col(own), "left")
    stays = joined.where(F.coalesce(kept, F.lit(True)))
    empty = F.col(own).isNull() | (F.col(shingles) == 0)
    others = stays.where(~empty).dropDuplicates([own])
    return stays.where(empty).unionByName(others).select(*docs.columns)
