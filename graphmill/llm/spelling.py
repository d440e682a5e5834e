"""Spelling variants: words one edit apart, found by a positional q-gram index with a count filter.

A word of m code points has m - 1 bigrams, each with its position. One edit leaves most
of them: two words of one length share all but two at equal positions; of words whose
lengths differ by one, the shorter keeps all but one, before the edit at the same
position and after it one further. Words are therefore indexed by length and by
positional bigrams, rarest first: of the bigrams that a near pair shares, the two first
in that order lie among the first four of each word (three of the shorter), so they make
the index's keys, and a near pair meets under exactly one of them.

Postings are merged by key, by the shuffle's sorted merge. Within a key, postings longer
than a few words are split by the next shared bigram, again and again; for what remains
the overlap of two words is counted, those under the bound for one edit go, and the rest
is verified. A key with more postings than a task should hold is split by the next shared
bigram before the shuffle. With all bigrams shared that one edit leaves, a key's words
differ in two bigrams: at most 90 * 90 of them, whatever the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import lean, mix, small_batches, table

#: Fixed values of the contract: what a word is made of, how short it may be, how much more frequent its form is.
RUN = "[A-Za-zÀ-ÿ]+"
SHORTEST, RATIO, DROPPED = 7, 10, 31
#: Shared bigrams in a key of the index; postings of a key in one task; postings compared pair by pair.
DEPTH, MOST, FEW = 2, 20_000, 24
#: Roles of a posting: words of one length, the shorter and the longer of a pair; bigrams that an edit takes from each.
SAME, SHORT, LONG = 0, 1, 2
_LOST = np.array([2, 1, 2])
_FAR = np.iinfo(np.int32).max
_ODD = np.uint64(0x9E3779B97F4A7C15)

POSTING = "key long, role int, at int, low int, high int, word string, n long"


def counted(docs: DataFrame) -> DataFrame:
    """word, n: the runs of all texts (doc_id, text), lower-cased A-Z, one code point less where the hash of id and run says so.

    A null text has none; a null id counts as an empty string in the hash.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(RUN), F.lit(0))).alias("run"),
    ).withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % DROPPED == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _matrices(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, code points as rows) of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, np.frombuffer("".join(words[i] for i in rows).encode("latin-1"), np.uint8).reshape(len(rows), length)


@lean
def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for _, letters in _matrices(batch.column(0).to_pylist()):
            total += np.bincount((letters[:, :-1].astype(np.int64) * 256 + letters[:, 1:]).ravel(), minlength=1 << 16)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])


def gram_ranks(words: DataFrame) -> np.ndarray:
    """Rank of each bigram, the rarest first, by two code points of a byte each: 65,536 numbers whatever the words."""
    found = words.select("word").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    ranks = np.zeros(1 << 16, np.int64)
    for k, r in enumerate(sorted(found, key=lambda r: (r["n"], r["gram"]))):
        ranks[r["gram"]] = k
    return ranks


def positional(letters: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The bigrams of words of one length by position, as rank and position in one number."""
    return (ranks[letters[:, :-1].astype(np.int64) * 256 + letters[:, 1:]] << 32) + np.arange(letters.shape[1] - 1)


def band_key(length: int, role: int) -> np.uint64:
    """Where a key's chain of bigrams begins: words of one length, or those of a length and one more."""
    return mix(np.array([2 * (length - (role == LONG)) + (role != SAME) + 1], np.uint64) * _ODD)[0]


def chained(keys: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The keys with a further shared bigram."""
    return mix(keys * _ODD + grams.astype(np.uint64) + np.uint64(1))


Postings = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def extend(grams: np.ndarray, postings: Postings, depth: int) -> Postings:
    """Postings of one length with one more shared bigram than depth; grams: rows of sorted positional bigrams.

    A posting is a row of grams, key, role, the place of its last bigram in the row, the
    largest position that stayed and the smallest that moved. Of a longer word each bigram
    may stand where the shorter one has it or one further, all after some place.
    """
    row, key, role, at, low, high = postings
    out = []
    width = grams.shape[1]
    for step in range(1, int(_LOST.max()) + 2):
        # the last of depth + 1 shared bigrams has at most the lost ones before it
        ok = np.flatnonzero((at + step < width) & (at + step <= _LOST[role] + depth))
        gram = grams[row[ok], at[ok] + step]
        place = gram & 0xFFFFFFFF
        for moved in (0, 1):
            fits = (place > low[ok]) & (place > 0) & (role[ok] == LONG) if moved else place < high[ok]
            some, g, p = ok[fits], gram[fits], place[fits]
            new_low = low[some] if moved else np.maximum(low[some], p)
            new_high = np.minimum(high[some], p) if moved else high[some]
            out.append((row[some], chained(key[some], g - moved), role[some], at[some] + step, new_low, new_high))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def first_postings(grams: np.ndarray, length: int) -> Postings:
    """Postings of all rows under keys of DEPTH bigrams."""
    n = len(grams)
    role = np.repeat(np.arange(3), n)
    key = np.repeat(np.array([band_key(length, r) for r in range(3)], np.uint64), n)
    state = (np.tile(np.arange(n), 3), key, role, np.full(3 * n, -1), np.full(3 * n, -_FAR), np.full(3 * n, _FAR))
    for depth in range(DEPTH):
        state = extend(grams, state, depth)
    return state


def _emit(words: list[str], counts: np.ndarray, rows: np.ndarray, state: Postings, most: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    source, key, role, at, low, high = state
    for a in range(0, len(source), most):
        b = slice(a, a + most)
        which = rows[source[b]]
        numbers = [pa.array(x[b].astype(np.int32)) for x in (role, at, low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(key[b].view(np.int64)), *numbers, pa.array([words[i] for i in which], pa.string()), pa.array(counts[which])], names=["key", "role", "at", "low", "high", "word", "n"])


def _post(ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for rows, letters in _matrices(words):
                grams = np.sort(positional(letters, ranks), axis=1)
                yield from _emit(words, counts, rows, first_postings(grams, letters.shape[1]))

    return lean(run)


def _state(batch: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    key = batch.column("key").to_numpy().view(np.uint64)
    return [key, *(batch.column(c).to_numpy().astype(np.int64) for c in ("role", "at", "low", "high"))]


def _split(ranks: np.ndarray, depth: int):
    """Postings under a further shared bigram; those that share all that an edit leaves stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts, state = batch.column("word").to_pylist(), batch.column("n").to_numpy(), _state(batch)
            for rows, letters in _matrices(words):
                own = (np.arange(len(rows)), *(x[rows] for x in state))
                done = depth >= letters.shape[1] - 1 - _LOST[own[2]]
                yield from _emit(words, counts, rows, tuple(x[done] for x in own))
                grams = np.sort(positional(letters, ranks), axis=1)
                yield from _emit(words, counts, rows, extend(grams, tuple(x[~done] for x in own), depth))

    return lean(run)


def _group_sizes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of sorted keys how many of its key follow, and the size of its key."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    return np.repeat(starts + sizes, sizes) - np.arange(len(key)) - 1, np.repeat(sizes, sizes)


def _pairs(key: np.ndarray, role: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the postings with equal keys (sorted) that may be near: both of one length, or a shorter and a longer."""
    left, _ = _group_sizes(key)
    held, n, k = [], 0, 0
    live = np.flatnonzero(left > 0)
    while len(live):
        k += 1
        live = live[left[live] >= k]
        ok = live[(role[live] == SAME) | (role[live] != role[live + k])]
        for a in range(0, len(ok), most):
            held.append((ok[a : a + most], ok[a : a + most] + k))
            n += len(held[-1][0])
            if n >= most:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _chain(first: np.uint64, shared: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the first bigrams, depth of them, of rows of sorted ones."""
    key = np.full(len(shared), first, np.uint64)
    for d in range(depth):
        key = chained(key, shared[:, d])
    return key


_NONE = np.iinfo(np.int64).max


def near_in_band(letters: np.ndarray, grams: np.ndarray, state: Postings, depth: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of near words, of postings sorted by key; letters and grams of shorter words end in a column that doesn't count.

    A pair counts under one key only, that of the first bigrams it shares, and for the
    posting of its longer word that moves them as the pair's edit does.
    """
    row, key, role, _, low, high = state
    for i, j in _pairs(key, role):
        if role[i[0]] == SAME:
            equal = letters[row[i]] == letters[row[j]]
            common = equal[:, :-1] & equal[:, 1:]
            enough = common.sum(axis=1) >= length - 3  # the count filter
            i, j, equal, common = i[enough], j[enough], equal[enough], common[enough]
            near = (~equal).sum(axis=1) == 1
            i, j, common = i[near], j[near], common[near]
            shared = np.where(common, grams[row[i]], _NONE)
        else:
            i, j = np.where(role[i] == SHORT, i, j), np.where(role[i] == SHORT, j, i)
            stay, move = letters[row[i], :length] == letters[row[j], :length], letters[row[i], :length] == letters[row[j], 1:]
            kept = (stay[:, :-1] & stay[:, 1:]) | (move[:, :-1] & move[:, 1:])
            enough = kept.sum(axis=1) >= length - 2
            i, j, stay, move = i[enough], j[enough], stay[enough], move[enough]
            before = np.where(stay.all(axis=1), length, (~stay).argmax(axis=1))
            after = np.where(move.all(axis=1), length, (~move[:, ::-1]).argmax(axis=1))
            near = (before + after >= length) & (low[j] < before - 1) & (high[j] > before)
            i, j, before = i[near], j[near], before[near]
            shared = np.where(np.arange(length - 1) == before[:, None] - 1, _NONE, grams[row[i], : length - 1])
        if len(i):
            shared.sort(axis=1)
            first = _chain(band_key(length, role[i[0]]), shared, depth) == key[i]
            yield row[i[first]], row[j[first]]


def _near(ranks: np.ndarray, start: int):
    """Links of the postings of a partition, sorted by key; a key's postings are held together."""
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def links(held: pa.Table) -> Iterator[pa.RecordBatch]:
        words, counts = held.column("word").to_pylist(), held.column("n").to_numpy()
        key, role, at, low, high = _state(held)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        _, sizes = _group_sizes(key)
        bands = np.where(sizes > 1, 2 * (lengths - (role == LONG)) + (role != SAME), -1)
        for band in np.unique(bands[bands >= 0]):
            rows = np.flatnonzero(bands == band)
            length = int(band) // 2
            width = length + int(band) % 2
            letters, sorted_grams = np.zeros((len(rows), width), np.uint8), np.full((len(rows), width - 1), _NONE)
            plain = sorted_grams.copy()
            for some, matrix in _matrices([words[i] for i in rows]):
                letters[some, : matrix.shape[1]] = matrix
                plain[some, : matrix.shape[1] - 1] = positional(matrix, ranks)
            sorted_grams = np.sort(plain, axis=1)
            state = (np.arange(len(rows)), *(x[rows] for x in (key, role, at, low, high)))
            depth = start
            while len(state[0]):
                order = np.argsort(state[1], kind="stable")
                state = tuple(x[order] for x in state)
                _, own = _group_sizes(state[1])
                small = (own <= FEW) | (depth >= length - 3)
                now = tuple(x[small & (own > 1)] for x in state)
                for i, j in near_in_band(letters, plain, now, depth, length):
                    x, y = np.concatenate([rows[i], rows[j]]), np.concatenate([rows[j], rows[i]])
                    yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in x], pa.string()), pa.array([words[k] for k in y], pa.string()), pa.array(counts[y])], schema=schema)
                state = extend(sorted_grams, tuple(x[~small] for x in state), depth)
                depth += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column("key").to_numpy()
            if held and held[-1].column("key")[-1].as_py() != keys[0] and sum(map(len, held)) >= 20_000:
                yield from links(pa.Table.from_batches(held))
                held = []
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if cut and sum(map(len, held)) + cut >= 20_000:
                yield from links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from links(pa.Table.from_batches(held))

    return lean(run)


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, near, near_n: every ordered pair of words (word, n) that differ by one inserted, deleted or replaced code point.

    Words are distinct, of at least SHORTEST code points, all below U+0100.
    """
    spark = words.sparkSession
    small_batches(spark, 10_000)
    ranks = gram_ranks(words)
    posted = words.select("word", "n").mapInArrow(_post(ranks), POSTING)
    found, depth = [], DEPTH
    while True:
        posted = table(posted, "spelling-postings")
        hot = table(posted.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most).select("key"), "spelling-hot", True)
        some = not hot.isEmpty()
        cold = posted.join(hot, "key", "left_anti") if some else posted
        found.append(cold.repartition("key").sortWithinPartitions("key").mapInArrow(_near(ranks, depth), "word string, near string, near_n long"))
        if not some:
            break
        posted = posted.join(hot, "key", "left_semi").mapInArrow(_split(ranks, depth), POSTING)
        depth += 1
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last form that the words of forms (word, form) lead to; every round doubles the steps."""
    known = table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = known.join(known.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        new = table(ahead.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        known = new.select("word", "root")
        if new.where("moved").isEmpty():
            return known


def variants(docs: DataFrame, ratio: int = RATIO, least: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each distinct word of docs (doc_id, text) that occurs often enough.

    A word's form is its near word of largest n (ties: the smallest by code point) if that n
    is at least ratio times its own, else null; root follows forms to the last. Null and
    empty texts have no words, an empty table gives no row; rows that repeat count each;
    other columns are ignored. A text or word of any length is taken whole.
    """
    small_batches(docs.sparkSession)
    words = table(counted(docs).where(F.col("n") >= least), "spelling-words")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best"))
    joined = words.join(near, "word", "left")
    enough = -F.col("best.n") >= ratio * F.col("n")
    judged = table(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")),
        "spelling-judged",
    )
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
