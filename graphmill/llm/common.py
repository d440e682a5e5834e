"""What several corpus operators share: scratch tables, word shingles, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a few numbers in a file of a table.
NARROW_ROWS = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir, which all executors share; it goes when the application ends.

    Where that is unset, a single machine gets a temporary folder, a cluster an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or spark.conf.get("graphmill.scratch", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="graphmill-")
        spark.conf.set("graphmill.scratch", root)
    folder = f"{root.rstrip('/')}/graphmill-{spark.sparkContext.applicationId}"
    if spark.conf.get("graphmill.scratch.gone", "") != folder:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
        spark.conf.set("graphmill.scratch.gone", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def table(df: DataFrame, name: str, narrow: bool = False, most_rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors.

    narrow: rows of a few numbers, for which partitions sized for texts would make
    small files; an eighth as many, and where most_rows bounds them, one for each
    NARROW_ROWS of that at most.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if narrow:
        files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
        df = df.coalesce(files if most_rows is None else min(files, -(-max(1, most_rows) // NARROW_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what a Python worker holds at once; a single very long row still comes whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def utf8_parts(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) for runs of rows of about `most` bytes; a null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if len(column) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


#: What a Python worker holds from task to task: tables of one operator at a time.
_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, build: Callable[[], Any]) -> Any:
    """What build() gives, kept in this process until another operator needs the room."""
    if key not in _HELD:
        release()
        _HELD[key] = build()
    return _HELD[key]


def release() -> None:
    """Workers outlive their tasks: let go of another operator's tables."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that begins and ends without held memory."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        release()
        yield from f(batches)
        trim()

    return run


_RNG = np.random.Generator(np.random.PCG64(20240229))
_ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_ODD[0])
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_WORD_BYTE = _BYTE[_LOWER]
_WORD_BYTE[_SPACE] = 0
#: Words of so many bytes are hashed with a key for each place, longer ones by a digest.
_LONG = 64
_PLACE = _RNG.integers(1, 2**63, _LONG + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base to the powers 0, 1, ..., n - 1, and the same of its inverse modulo 2**64."""
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, np.uint64(base), np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums s (one longer than data) for span_hash()."""
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:-1], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end]; equal bytes give equal hashes wherever they stand.

    It is a polynomial modulo 2**64: good for short grams, where a collision is
    harmless; long strings can collide by their structure.
    """
    _, down = _powers(len(sums))
    return (sums[end] - sums[start]) * down[start]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`; none crosses an offset."""
    inner = ~_SPACE[data]
    starts = inner.copy()
    starts[1:] &= ~inner[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    starts[cuts] = inner[cuts]
    ends = inner.copy()
    ends[:-1] &= ~inner[1:]
    before = cuts[cuts > 0] - 1
    ends[before] = inner[before]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of lower-cased words: a random multiple of each byte by its place, or a BLAKE2b digest of a long word."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    step = np.zeros(len(data), np.int64)
    step[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(data)) - np.cumsum(step)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_WORD_BYTE[data] * _PLACE[np.clip(place, 0, _LONG - 1)], out=sums[1:])
    hashes = mix(sums[ends] - sums[starts] + lengths.astype(np.uint64) * _PLACE[_LONG])
    for i in np.flatnonzero(lengths > _LONG):
        word = _LOWER[data[starts[i] : ends[i]]].astype(np.uint8).tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return hashes


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of all rows, and where each row's begin (one more at the end)."""
    starts, ends = word_spans(data, offsets)
    return word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingles_of(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the shingles of `size` words in order; the whole sequence as one if it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    total = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        total += words[i : n - k + 1 + i] * _ODD[1 + i]
    return mix(total)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable, for every id in edges (src, dst).

    Repeated contraction: every node points to its smallest neighbour, edges move
    to where their ends point, and loops vanish. A hub costs one partial
    aggregate, not a task; each round is a written table.
    Empty edges give an empty table; loops give their own id.
    """
    # a node for each end at most, and edges only get fewer
    n = 2 * edges.count()
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    labels = None
    current = both
    while True:
        best = current.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("id")).alias("to"))
        best = table(best, f"{name}-best", True, n)
        # one jump: a chain a -> b -> c becomes a -> c
        jump = table(
            best.alias("a").join(best.select(F.col("id").alias("to"), F.col("to").alias("to2")), "to", "left").select("id", F.coalesce("to2", "to").alias("to")),
            f"{name}-jump",
            True,
            n,
        )
        if labels is None:
            labels = jump.select("id", F.col("to").alias("component"))
        else:
            labels = table(
                labels.join(jump.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")),
                f"{name}-labels",
                True,
                n,
            )
        moved = (
            current.where("src < dst")
            .join(jump.select(F.col("id").alias("src"), F.col("to").alias("s")), "src")
            .join(jump.select(F.col("id").alias("dst"), F.col("to").alias("d")), "dst")
            .where("s <> d")
            .select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst"))
            .distinct()
        )
        moved = table(moved, f"{name}-edges", True, n)
        if moved.isEmpty():
            return labels
        current = moved.unionByName(moved.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
