"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set, in powers of two. For each
partition a document is cut into blocks of twice the partition's smallest size,
and two neighbouring blocks make a window, so a passage as long as an item lies
whole in a window of at most eight times its size: short items are found inside
long documents at a Jaccard similarity that does not depend on the document's
length. Block minima of the next partition are minima of pairs of blocks.

A window and an item are candidates if any of 64 minima is equal. At a containment
of 0.75 their similarity is 0.17 at least, so a passage is missed with a
probability of 0.83 ** 64 = 7e-6. Candidates are verified by exact shingle
containment in the whole document.

Items are the query set and go to the tasks in blocks of bounded size; documents
are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import lean, release, shingles_of, small_batches, utf8_parts, words_of

PERMUTATIONS = 64
#: Items in a block that is sent to the tasks, and characters of their texts together.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 32 << 20
_RNG = np.random.Generator(np.random.PCG64(77))
_A = (_RNG.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def hashed(shingles: np.ndarray) -> np.ndarray:
    """permutations x shingles."""
    return (shingles >> np.uint64(32)).astype(np.uint32)[None, :] * _A + _B


class Index:
    """The items' minima by partition, for look-up of window minima."""

    def __init__(self, items: list[tuple[int | None, str]], containment: float) -> None:
        self.containment = containment
        self.ids, self.sets = [], []
        for key, text in items:
            for _, data, offsets in utf8_parts(pa.array([text], pa.string()), 1 << 40):
                shingles = np.unique(shingles_of(words_of(data, offsets)[0]))
                if len(shingles):
                    self.ids.append(key)
                    self.sets.append(shingles)
        self.partitions: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        levels: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            levels.setdefault(len(s).bit_length() - 1, []).append(i)
        rank = np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(32)
        for level, members in levels.items():
            keys = np.concatenate([rank | hashed(self.sets[i]).min(axis=1) for i in members])
            owner = np.repeat(np.array(members), PERMUTATIONS)
            order = np.argsort(keys, kind="stable")
            bits = max(16, len(keys).bit_length() + 5)
            seen = np.zeros(1 << bits, bool)
            seen[(keys * _SPREAD) >> np.uint64(64 - bits)] = True
            self.partitions[level] = keys[order], owner[order], seen

    def candidates(self, shingles: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) of the rows whose shingles are shingles[at[r]:at[r + 1]]."""
        out: set[tuple[int, int]] = set()
        if not self.partitions or len(shingles) == 0:
            return out
        lengths = np.diff(at)
        lowest = min(self.partitions)
        block = 2 << lowest
        counts = -(-lengths // block)
        rows = np.repeat(np.arange(len(lengths)), counts)
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = at[rows] + inner * block
        least = np.empty((PERMUTATIONS, len(rows)), np.uint32)
        step = max(1, (1 << 15) // block)
        for i in range(0, len(rows), step):
            a = starts[i]
            b = starts[i + step] if i + step < len(rows) else len(shingles)
            least[:, i : i + step] = np.minimum.reduceat(hashed(shingles[a:b]), starts[i : i + step] - a, axis=1)
        for level in range(lowest, max(self.partitions) + 1):
            if level > lowest:
                # blocks of the next size: the even ones with their right neighbour
                even = np.flatnonzero(inner % 2 == 0)
                pair = np.minimum(even + 1, len(rows) - 1)
                other = np.where(rows[pair] == rows[even], pair, even)
                least, rows, inner = np.minimum(least[:, even], least[:, other]), rows[even], inner[even] // 2
            if level in self.partitions:
                windows = least.copy()
                if len(rows) > 1:
                    same = rows[1:] == rows[:-1]
                    windows[:, :-1] = np.where(same, np.minimum(least[:, :-1], least[:, 1:]), least[:, :-1])
                out |= self._look_up(level, windows, rows)
        return out

    def _look_up(self, level: int, windows: np.ndarray, rows: np.ndarray) -> set[tuple[int, int]]:
        keys, owner, seen = self.partitions[level]
        bits = len(seen).bit_length() - 1
        wanted = windows.astype(np.uint64) | (np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(32))[:, None]
        p, w = np.nonzero(seen[(wanted * _SPREAD) >> np.uint64(64 - bits)])
        hit = wanted[p, w]
        a, b = np.searchsorted(keys, hit, "left"), np.searchsorted(keys, hit, "right")
        out = set()
        for i in np.flatnonzero(b > a):
            out.update((int(rows[w[i]]), int(x)) for x in owner[a[i] : b[i]])
        return out

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, common shingles) with the containment reached, in order."""
        words, places = words_of(data, offsets)
        parts = [shingles_of(words[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]
        at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        found, percent = [], round(100 * self.containment)
        for row, item in sorted(self.candidates(np.concatenate(parts), at)):
            common = int(np.isin(self.sets[item], parts[row]).sum())
            if 100 * common >= percent * len(self.sets[item]):
                found.append((row, item, common))
        return found


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items (item_id, text) in lists of bounded size."""
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = plain.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["chars"] or 0) // BLOCK_CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield [(r["item_id"], r["text"]) for r in plain.where(part == b).orderBy("item_id", "text").collect()]


def contained(docs: DataFrame, items: DataFrame, containment: float = 0.75) -> DataFrame:
    """doc_id, item_id, n_common, n_item, containment: one row per document and item it holds.

    Words and shingles as in near_duplicates(); an item of fewer than five words is
    its whole sequence. Null and empty texts, of either side, match nothing;
    repeated rows give repeated results; null ids stay null; other columns are
    ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(Index(block, containment))

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for first, data, offsets in utf8_parts(batch.column(1)):
                    found = index.matches(data, offsets)
                    n = [len(index.sets[i]) for _, i, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first).take(pa.array([r for r, _, _ in found], pa.int64())),
                            pa.array([index.ids[i] for _, i, _ in found], pa.int64()),
                            pa.array([c for _, _, c in found], pa.int64()),
                            pa.array(n, pa.int64()),
                            pa.array([c / k for (_, _, c), k in zip(found, n, strict=True)], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "n_common", "n_item", "containment"],
                    )

        one = plain.mapInArrow(lean(run), "doc_id long, item_id long, n_common long, n_item long, containment double")
        out = one if out is None else out.unionByName(one)
    return out


def _holds(shared: Broadcast) -> Callable[[pa.Array], pa.Array]:
    def holds(column: pa.Array) -> pa.Array:
        release()
        out = np.zeros(len(column), bool)
        for first, data, offsets in utf8_parts(column):
            for row, _, _ in shared.value.matches(data, offsets):
                out[first + row] = True
        return pa.array(out)

    return holds


def without_contaminated(docs: DataFrame, items: DataFrame, containment: float = 0.75) -> DataFrame:
    """The rows of docs that hold no item, all columns kept.

    Null and empty texts hold none and stay; rows that repeat are judged alike; no
    items, or no rows, take nothing away.
    """
    spark = docs.sparkSession
    small_batches(spark)
    for block in item_blocks(items):
        holds = F.arrow_udf(_holds(spark.sparkContext.broadcast(Index(block, containment))), "boolean")
        docs = docs.where(~holds(F.col("text").cast("string")))
    return docs
