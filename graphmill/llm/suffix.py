"""Exact removal of repeated byte strings by run-length compressed BWTs.

A byte goes if a string of 100 bytes that covers it also starts earlier in the
corpus. One Burrows-Wheeler transform of the whole corpus can't be built without
one machine that holds it, so the corpus is first dealt into buckets that no match
crosses: every 100-byte string is assigned to its anchor, the 24-byte gram with the
smallest hash (the last of equals). Equal strings have equal anchors at equal
places, so all copies of a string meet in their anchor's bucket. Consecutive
strings of one anchor form a segment, 147 bytes on average.

1. Equal segments of an anchor (by a BLAKE2b digest of their bytes) are one run:
   its sample is its earliest segment, all others are repeated throughout. Tasks do this before the shuffle, so a hot
   segment crosses it once a task.
2. Anchors that still have different segments get an index: segments are sorted by
   their bytes from the anchor on, and the transform is extended to the left
   column by column. A column is stored as runs of equal preceding bytes; LF moves
   whole runs, LCP values change only at run boundaries. Along the way matching
   statistics are streamed: where neighbours in suffix order share 100 bytes or
   more, all but the earliest are marked.
3. Where an anchor has very many different segments, each is split in two before
   that: its strings that reach 38 bytes to the left of the anchor go by these
   bytes, the others by the 38 to the right. Equal strings still meet. What is still
   too many is split on where it is indexed, down to single strings, so a task holds a
   bounded number of suffixes at once.

The texts themselves are only joined with what concerns them, by doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import _BYTE, lean, mix, release, running_hash, small_batches, span_hash, table, utf8_parts

LENGTH, GRAM = 100, 24
WINDOW = LENGTH - GRAM + 1
#: Bytes hashed at once; longer texts are hashed in overlapping pieces.
PIECE = 1 << 20
_PLACES = np.uint64(PIECE - 1)
#: Segments a task holds before it passes them on.
HELD = 1 << 16
#: Rows in a batch: those between the stages are large.
BATCH_ROWS = 64
#: Bytes of text a partition, where the session's shuffle partitions would get more.
PARTITION_BYTES = 32 << 20
#: An anchor with more different segments is split by the bytes beside it.
MOST_OF_ANCHOR = 1 << 14
#: A string reaches so far beyond its anchor on one side at least.
BESIDE = (LENGTH - GRAM + 1) // 2

SPLIT = 1 << 10

SEGMENT = np.dtype([("f", "<u8"), ("seg", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("size", "u1"), ("off", "u1")])
MARK = np.dtype([("f", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("size", "<i4"), ("off", "<i2")])
BLOBS = "p int, blob binary"
MARKS = "doc_id long, spans array<struct<start:long,size:int>>, wanted array<struct<start:long,size:int,off:int,f:long>>"


def _bucket(f: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each anchor hash; it is the smallest of many, so its own leading bits are mostly 0."""
    return (mix(f) >> np.uint64(64 - bits)).astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start in the row, number of strings, place of the anchor, anchor hash, segment digest)."""
    found = []
    for base in range(0, max(1, len(data) - LENGTH + 1), PIECE - LENGTH):
        part = data[base : base + PIECE]
        if len(part) < LENGTH:
            break
        sums = running_hash(part, _BYTE)
        at = np.arange(len(part) - GRAM + 1)
        grams = mix(span_hash(sums, at, at + GRAM))
        least = (grams & ~_PLACES) | (_PLACES - at.astype(np.uint64))
        width = 1
        while width < WINDOW:
            step = min(width, WINDOW - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        anchor = (_PLACES - (least & _PLACES)).astype(np.int64)
        # the next piece takes over where this one lacks bytes
        i = np.arange(min(len(anchor), PIECE - LENGTH) if base + PIECE < len(data) else len(anchor))
        row = np.searchsorted(offsets, i + base, "right") - 1 if len(offsets) < 64 else np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[base : base + len(i)]
        inside = i + base + LENGTH <= offsets[row + 1]
        i, row, anchor = i[inside], row[inside], anchor[: len(inside)][inside]
        if len(i) == 0:
            continue
        first = np.ones(len(i), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (i[1:] != i[:-1] + 1) | (row[1:] != row[:-1])
        heads = np.flatnonzero(first)
        size = np.diff(np.append(heads, len(i)))
        start, place = i[heads], anchor[heads]
        end = start + size + (LENGTH - 1)
        raw = part.tobytes()
        digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        whole = mix(np.frombuffer(digests, "<u8") + (place - start).astype(np.uint64))
        found.append((row[heads], start + base - offsets[row[heads]], size, place - start, grams[place], whole))
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(4)), *(np.zeros(0, np.uint64) for _ in range(2)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _repeats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments sorted by anchor, bytes and place; which of them have an earlier equal."""
    x = x[np.lexsort((x["start"], x["doc"], x["seg"], x["f"]))]
    later = np.zeros(len(x), bool)
    later[1:] = (x["f"][1:] == x["f"][:-1]) & (x["seg"][1:] == x["seg"][:-1])
    # a row that comes twice is no repetition of itself
    same = np.zeros(len(x), bool)
    same[1:] = later[1:] & (x["doc"][1:] == x["doc"][:-1]) & (x["start"][1:] == x["start"][:-1])
    return x[~same], later[~same]


def _packed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (p, blob), or (p, kind, blob)."""
    for i in range(0, len(rows), BATCH_ROWS):
        part = rows[i : i + BATCH_ROWS]
        columns = [pa.array([r[0] for r in part], pa.int32()), *([pa.array([r[1] for r in part], pa.int32())] if len(part[0]) == 3 else []), pa.array([r[-1] for r in part], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["p", "kind", "blob"] if len(columns) == 3 else ["p", "blob"])


class Outbox:
    """Spans (off -1) and wanted segments on their way to their documents, by buckets of doc_id.

    A task passes on what it gathered in a few large rows, not a row a mark.
    """

    def __init__(self, bits: int) -> None:
        self.bits, self.held, self.n = bits, [], 0

    def spans(self, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        x = np.zeros(len(doc), MARK)
        x["doc"], x["start"], x["size"], x["off"] = doc, start, end - start, -1
        self._add(x)

    def wanted(self, segments: np.ndarray, many: np.ndarray) -> None:
        """many: which of them belong to an anchor that is to be split; their off is raised by SPLIT."""
        x = np.zeros(len(segments), MARK)
        for name in MARK.names:
            x[name] = segments[name]
        x["off"] += many * np.int16(SPLIT)
        self._add(x)

    def _add(self, x: np.ndarray) -> None:
        if len(x):
            self.held.append(x)
            self.n += len(x)

    def passed_on(self, least: int) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, blob) of all that is held, if it is at least so much."""
        if not self.n or self.n < least:
            return
        x = np.concatenate(self.held)
        self.held, self.n = [], 0
        q = (mix(x["doc"].astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.lexsort((x["start"], x["doc"], q))
        x, q = x[order], q[order]
        cuts = np.searchsorted(q, np.arange((1 << self.bits) + 1))
        yield from _packed([(int(k), x[cuts[k] : cuts[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(cuts))])


@lean
def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of MARKS, one for each document of a bucket: its merged spans and its wanted segments."""
    for _, rows in _grouped(batches):
        x = np.concatenate([np.frombuffer(blob, MARK) for (blob,) in rows])
        x = x[np.lexsort((x["start"], x["doc"]))]
        docs = np.unique(x["doc"])
        w = x[x["off"] >= 0]
        y = x[x["off"] < 0]
        d, a, b = merged(y["doc"], y["start"], y["start"] + y["size"])
        listed = lambda doc, columns: pa.ListArray.from_arrays(
            pa.array(np.append(np.searchsorted(doc, docs), len(doc)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v)) for v in columns.values()], names=list(columns))
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(docs),
                listed(d, {"start": a, "size": (b - a).astype(np.int32)}),
                listed(w["doc"], {"start": w["start"], "size": w["size"], "off": w["off"].astype(np.int32), "f": w["f"].astype(np.uint64).view(np.int64)}),
            ],
            names=["doc_id", "spans", "wanted"],
        )


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching and overlapping spans of a document as one."""
    if len(doc) == 0:
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new_doc = np.ones(len(doc), bool)
    new_doc[1:] = doc[1:] != doc[:-1]
    # the furthest end so far, by document
    lift = np.cumsum(new_doc).astype(np.int64) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    head = new_doc.copy()
    head[1:] |= start[1:] > reach[:-1]
    heads = np.flatnonzero(head)
    return doc[heads], start[heads], np.maximum.reduceat(reach, heads)


def _anchor(bits: int) -> Callable:
    """Rows (p, kind, blob): segments by bucket (0), and spans that the task itself found repeated (1)."""
    def passed_on(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x, later = _repeats(np.concatenate(held))
        y = x[later]
        d, a, b = merged(y["doc"], y["start"], y["start"] + y["size"] + (LENGTH - 1))
        rows = []
        for i in range(0, len(d), 1 << 16):
            spans = np.stack([d[i : i + (1 << 16)], a[i : i + (1 << 16)], b[i : i + (1 << 16)]])
            rows.append((int(mix(spans[0, :1].astype(np.uint64))[0] >> np.uint64(64 - bits)), 1, spans.tobytes()))
        x = x[~later]
        p = _bucket(x["f"], bits)
        order = np.lexsort((x["start"], x["doc"], p))
        x, p = x[order], p[order]
        cuts = np.searchsorted(p, np.arange((1 << bits) + 1))
        for k in range(1 << bits):
            if cuts[k + 1] > cuts[k]:
                y = x[cuts[k] : cuts[k + 1]]
                # columns, ids as differences: the shuffle's codec finds the zeros
                doc = np.diff(y["doc"], prepend=0)
                rows.append((k, 0, b"".join((y["f"].astype("<u8").tobytes(), y["seg"].tobytes(), doc.tobytes(), y["start"].tobytes(), y["size"].tobytes(), y["off"].tobytes()))))
        yield from _packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, data, offsets in utf8_parts(batch.column(1)):
                row, start, size, off, f, seg = segments(data, offsets)
                x = np.empty(len(row), SEGMENT)
                x["doc"], x["start"], x["size"], x["off"], x["f"], x["seg"] = ids[first + row], start, size, off, f, seg
                held.append(x)
                n += len(x)
            if n >= HELD:
                yield from passed_on(held)
                held, n = [], 0
        if n:
            yield from passed_on(held)

    return lean(run)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(p, its rows) from batches sorted by p; the rows' other columns as tuples."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key:
                if held:
                    yield key, held
                key, held = row[0], []
            held.append(row[1:])
    if held:
        yield key, held


def _settle(bits: int, most_of_anchor: int) -> Callable:
    """Of each bucket: spans of segments with an earlier equal, and the samples of anchors with different segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(bits)
        for _, rows in _grouped(batches):
            parts = []
            for kind, blob in rows:
                if kind == 1:
                    out.spans(*np.frombuffer(blob, np.int64).reshape(3, -1))
                    continue
                n = len(blob) // SEGMENT.itemsize
                x, at = np.empty(n, SEGMENT), 0
                for name, kind_of in (("f", "<u8"), ("seg", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("size", "u1"), ("off", "u1")):
                    column = np.frombuffer(blob, kind_of, n, at)
                    x[name] = np.cumsum(column) if name == "doc" else column
                    at += column.nbytes
                parts.append(x)
            if parts:
                x, later = _repeats(np.concatenate(parts))
                y = x[later]
                out.spans(*merged(y["doc"], y["start"], y["start"] + y["size"] + (LENGTH - 1)))
                x = x[~later]
                other = np.zeros(len(x) + 1, bool)
                other[1:-1] = x["f"][1:] == x["f"][:-1]
                x = x[other[1:] | other[:-1]]
                _, group, counts = np.unique(x["f"], return_inverse=True, return_counts=True)
                out.wanted(x, counts[group] > most_of_anchor)
            yield from out.passed_on(HELD)
        yield from out.passed_on(1)

    return lean(run)


def split(x: np.ndarray, data: np.ndarray, begin: np.ndarray, beside: int = BESIDE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Segments x, which begin at data[begin], in two parts: their strings that reach `beside` bytes or more to the left of the anchor, and the others.

    Anchors are renamed by the bytes that all strings of a part share beside them.
    """
    off, size = x["off"].astype(np.int64), x["size"].astype(np.int64)
    left = np.clip(off - beside + 1, 0, size)  # string i has its anchor at off - i
    parts = []
    for first, n, shift, width in ((np.zeros(len(x), np.int64), left, -beside, beside), (left, size - left, GRAM, WINDOW - beside)):
        some = np.flatnonzero(n > 0)
        y = x[some].copy()
        y["start"], y["size"], y["off"] = y["start"] + first[some], n[some], off[some] - first[some]
        at = begin[some] + off[some] + shift
        digests = b"".join([hashlib.blake2b(data[a : a + width].tobytes(), digest_size=8, key=bytes([shift & 0xFF])).digest() for a in at.tolist()])
        y["f"] = mix(y["f"] ^ np.frombuffer(digests, "<u8"))
        parts.append((y, begin[some] + first[some]))
    return parts


def _cut_out(bits: int) -> Callable:
    """Rows (p, blob) of the wanted segments' bytes from rows (doc_id, text, wanted)."""
    def passed_on(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([h[0] for h in held])
        text = np.concatenate([h[1] for h in held])
        length = x["size"].astype(np.int64) + (LENGTH - 1)
        begin = np.cumsum(length) - length
        p = _bucket(x["f"], bits)
        order = np.argsort(p, kind="stable")
        cuts = np.searchsorted(p[order], np.arange((1 << bits) + 1))
        rows = []
        for k in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[k] : cuts[k + 1]]
            at = np.repeat(begin[own] - (np.cumsum(length[own]) - length[own]), length[own]) + np.arange(int(length[own].sum()))
            rows.append((int(k), len(own).to_bytes(8, "little") + x[own].tobytes() + text[at].tobytes()))
        yield from _packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            wanted = batch.column(2)
            counts = wanted.value_lengths().to_numpy()
            flat = wanted.flatten()
            start, size, off, f = (flat.field(k).to_numpy() for k in range(4))
            row = np.repeat(np.arange(len(ids)), counts)
            for first, data, offsets in utf8_parts(batch.column(1)):
                own = np.flatnonzero((row >= first) & (row < first + len(offsets) - 1))
                x = np.zeros(len(own), SEGMENT)
                x["doc"], x["start"], x["size"], x["off"], x["f"] = ids[row[own]], start[own], size[own], off[own] % SPLIT, f[own].view(np.uint64)
                begin = offsets[row[own] - first] + start[own]
                many = off[own] >= SPLIT
                if many.any():
                    parts = [(x[~many], begin[~many]), *split(x[many], data, begin[many])]
                    x, begin = (np.concatenate(c) for c in zip(*parts, strict=True))
                length = x["size"].astype(np.int64) + (LENGTH - 1)
                at = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                held.append((x, data[at]))
                n += len(at)
            if n >= 4 << 20:
                yield from passed_on(held)
                held, n = [], 0
        if held:
            yield from passed_on(held)

    return lean(run)


def _equals(x: np.ndarray, text: np.ndarray, begin: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, start, end) of segments x of one string each, nearly all equal, that an equal one precedes."""
    order = np.lexsort((x["start"], x["doc"]))
    x, begin = x[order], begin[order]
    while len(x) > 1:
        first = text[begin[0] : begin[0] + LENGTH]
        equal = np.concatenate([(text[begin[i : i + most, None] + np.arange(LENGTH)] == first).all(axis=1) for i in range(0, len(x), most)])
        equal[0] = False
        yield x["doc"][equal], x["start"][equal], x["start"][equal] + LENGTH
        x, begin = x[1:][~equal[1:]], begin[1:][~equal[1:]]


def bounded_matches(x: np.ndarray, text: np.ndarray, begin: np.ndarray, most: int, low: int = 0, high: int = WINDOW - 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """long_matches() of segments x, which begin at text[begin], about `most` of them at once.

    An anchor of more is split by the bytes beside it, again and again: its strings reach
    from low to high bytes to its left, and where both are equal they are whole strings.
    """
    order = np.argsort(x["f"], kind="stable")
    heads = np.flatnonzero(np.diff(x["f"][order], prepend=x["f"][order[:1]] ^ np.uint64(1)) != 0)
    tails = np.append(heads[1:], len(x))
    at = 0
    while at < len(heads):
        # anchors one after the other as long as they are few enough together
        last = max(at + 1, int(np.searchsorted(tails, heads[at] + most, "right")))
        own = order[heads[at] : tails[last - 1]]
        at = last
        if len(own) <= most:
            yield long_matches(x[own], text, begin[own])
        elif low == high:
            yield from _equals(x[own], text, begin[own], most)
        else:
            beside = (low + high + 1) // 2
            for (y, places), ends in zip(split(x[own], text, begin[own], beside), ((beside, high), (low, beside - 1)), strict=True):
                if len(y):
                    yield from bounded_matches(y, text, places, most, *ends)


def long_matches(x: np.ndarray, text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of all 100-byte strings of segments x, which begin at text[begin], that an equal one precedes."""
    length = x["size"].astype(np.int64) + (LENGTH - 1)
    off = x["off"].astype(np.int64)
    right_length = length - off
    columns = np.arange(LENGTH)
    at = (begin + off)[:, None] + columns
    right = np.where(columns < right_length[:, None], text[np.minimum(at, len(text) - 1)], 0).astype(np.uint8)
    columns = np.arange(WINDOW - 1)
    at = (begin + off - 1)[:, None] - columns
    left = np.where(columns < off[:, None], text[np.maximum(at, 0)], 0).astype(np.uint8)
    # suffix order at the anchor; a suffix that ends comes before one that goes on
    padded = np.zeros((len(x), 104), np.uint8)
    padded[:, :LENGTH] = right
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((right_length, *(words[:, k] for k in range(12, -1, -1)), x["f"]))
    bucket = np.zeros(len(x), np.int64)
    bucket[order[1:]] = np.cumsum(x["f"][order[1:]] != x["f"][order[:-1]])
    equal = right[order[1:]] == right[order[:-1]]
    shared = np.where(equal.all(axis=1), LENGTH, equal.argmin(axis=1))
    shared = np.minimum(shared, np.minimum(right_length[order[1:]], right_length[order[:-1]]))
    lcp = np.concatenate(([-1], np.where(bucket[order[1:]] == bucket[order[:-1]], shared, -1)))
    place = x["start"] + off
    by_place = np.lexsort((place, x["doc"]))
    rank = np.empty(len(x), np.int64)
    step = np.zeros(len(x), np.int64)
    step[1:] = (x["doc"][by_place[1:]] != x["doc"][by_place[:-1]]) | (place[by_place[1:]] != place[by_place[:-1]])
    rank[by_place] = np.cumsum(step)
    marked = np.zeros((len(x), WINDOW), bool)
    for o in range(WINDOW):
        # matching statistics of this column
        heads = np.flatnonzero(lcp < LENGTH)
        if len(heads) < len(order):
            first = np.minimum.reduceat(rank[order], heads)
            marked[order, o] = rank[order] > np.repeat(first, np.diff(np.append(heads, len(order))))
        if o == WINDOW - 1:
            break
        # the preceding bytes in runs; LF moves each run as a whole
        kept = np.flatnonzero(off[order] > o)
        if len(kept) == 0:
            break
        key = bucket[order[kept]] << 8 | left[order[kept], o]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        lengths = np.diff(np.append(starts, len(kept)))
        runs = np.argsort(key[starts], kind="stable")
        moved = np.repeat(starts[runs] - (np.cumsum(lengths[runs]) - lengths[runs]), lengths[runs]) + np.arange(len(kept))
        old, key = kept[moved], key[moved]
        # between neighbours the least LCP of all that stood between them
        new = np.full(len(old), -1, np.int64)
        if len(old) > 1:
            together = np.flatnonzero(key[1:] == key[:-1]) + 1
            if len(together):
                edges = np.stack([old[together - 1] + 1, old[together] + 1], axis=1).ravel()
                new[together] = np.minimum.reduceat(np.append(lcp, LENGTH), edges)[::2] + 1
        order, lcp = order[old], new
    item, o = np.nonzero(marked)
    start = place[item] - o
    return merged(x["doc"][item], start, start + LENGTH)


def _index(bits: int, most_of_anchor: int) -> Callable:
    """Of each bucket of segments with their bytes: the spans of long matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(bits)
        for _, rows in _grouped(batches):
            parts, texts = [], []
            for (blob,) in rows:
                n = int.from_bytes(blob[:8], "little")
                parts.append(np.frombuffer(blob, SEGMENT, n, 8))
                texts.append(np.frombuffer(blob, np.uint8, -1, 8 + n * SEGMENT.itemsize))
            x = np.concatenate(parts)
            length = x["size"].astype(np.int64) + (LENGTH - 1)
            for spans in bounded_matches(x, np.concatenate(texts), np.cumsum(length) - length, most_of_anchor):
                out.spans(*spans)
                yield from out.passed_on(HELD)
        yield from out.passed_on(1)

    return lean(run)


def repeated_spans(docs: DataFrame, most_of_anchor: int = MOST_OF_ANCHOR) -> DataFrame:
    """doc_id, spans (array<struct<start, size>>, overlapping) of repeated bytes, for docs (doc_id: unique and not null, text)."""
    spark = docs.sparkSession
    small_batches(spark, BATCH_ROWS)
    whole = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole // PARTITION_BYTES))
    bits = min(24, max(6, (4 * partitions - 1).bit_length()))
    dealt = lambda df: df.repartition(partitions, "p").sortWithinPartitions("p")
    anchors = docs.select("doc_id", "text").mapInArrow(_anchor(bits), "p int, kind int, blob binary")
    marks = table(dealt(dealt(anchors).mapInArrow(_settle(bits, most_of_anchor), BLOBS)).mapInArrow(_gather, MARKS), "suffix-marks")
    wanted = marks.where(F.size("wanted") > 0).select("doc_id", "wanted")
    pieces = docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_cut_out(bits), BLOBS)
    found = table(dealt(dealt(pieces).mapInArrow(_index(bits, most_of_anchor), BLOBS)).mapInArrow(_gather, MARKS), "suffix-found")
    some = marks.select("doc_id", "spans").unionByName(found.select("doc_id", "spans")).where(F.size("spans") > 0)
    return some.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


#: Names of columns of ours beside the caller's.
ROW, SAME, SPANS = "_graphmill_row", "_graphmill_same", "_graphmill_spans"


def _numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with unique ids ROW in the order of doc_id (null first), then text; whether they had to be made."""
    n = docs.select(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if n["n"] == n["d"]:
        return docs.withColumn(ROW, F.col("doc_id")), False
    keyed = docs.withColumn(SAME, F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = table(keyed.select("doc_id", SAME).distinct().orderBy(F.col("doc_id").asc_nulls_first(), SAME).withColumn(ROW, F.monotonically_increasing_id()), "suffix-rows")
    rows = rows.select(F.col("doc_id").alias("_graphmill_id"), F.col(SAME).alias("_graphmill_its"), ROW)
    return keyed.join(rows, F.col("doc_id").eqNullSafe(F.col("_graphmill_id")) & (F.col(SAME) == F.col("_graphmill_its"))).drop(SAME, "_graphmill_id", "_graphmill_its"), True


def with_spans(docs: DataFrame, most_of_anchor: int = MOST_OF_ANCHOR) -> DataFrame:
    """docs (doc_id long, text string, ...) with SPANS, array<struct<start, size>> of repeated bytes, unordered, null for none.

    Rows that repeat a doc_id with other texts are documents of their own, equal rows are one.
    """
    numbered, made = _numbered(docs)
    unique = numbered.select(F.col(ROW).alias("doc_id"), "text")
    if made:
        numbered = table(numbered, "suffix-numbered")
        unique = numbered.select(F.col(ROW).alias("doc_id"), "text").dropDuplicates(["doc_id"])
    spans = repeated_spans(unique, most_of_anchor).select(F.col("doc_id").alias(ROW), F.col("spans").alias(SPANS))
    return numbered.join(spans, ROW, "left").drop(ROW)


def _removed(spans: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of each row's maximal removed runs."""
    counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = spans.flatten()
    start, size = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    at = 0
    for n in counts:
        a = start[at : at + n]
        _, a, b = merged(np.zeros(n, np.int64), a, a + size[at : at + n])
        yield a, b
        at += n


@lean
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for value, (a, b) in zip(batch.column(1), _removed(batch.column(2)), strict=True):
            text = (value.as_py() or "").encode()
            kept, last = hashlib.sha256(), 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                kept.update(text[last:x])
                last = y
            kept.update(text[last:])
            out.append((len(text), int((b - a).sum()), len(a), kept.hexdigest()))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _plain(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))


def digests(docs: DataFrame, most_of_anchor: int = MOST_OF_ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs (doc_id, text).

    A null text is empty. Rows that repeat a doc_id are documents of their own, in
    the order of their texts' hashes; equal rows are one document and get equal
    results. A null doc_id comes before all others. Texts under 100 bytes lose
    nothing. Other columns are ignored.
    """
    spanned = with_spans(_plain(docs.select("doc_id", "text")), most_of_anchor)
    return spanned.select("doc_id", "text", SPANS).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes cut out of their texts, all columns kept; rows left with nothing go.

    A character goes only if all its bytes are repeated, so texts stay valid. A
    column n_chars is brought up to date. Null and empty texts stay as they are.
    A null doc_id comes before all others; equal rows, by id and text, are one
    document and are cut alike, rows that repeat an id with other texts are documents
    of their own. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    spanned = with_spans(_plain(docs))

    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        release()
        out = []
        for value, (a, b) in zip(text, _removed(spans), strict=True):
            if len(a) == 0:
                out.append(value.as_py())
                continue
            raw = np.frombuffer(value.as_py().encode(), np.uint8)
            edges = np.zeros(len(raw) + 1, np.int8)
            edges[a] = 1
            edges[b] = -1
            gone = np.cumsum(edges[:-1], dtype=np.int8) > 0
            heads = np.flatnonzero((raw & 0xC0) != 0x80)
            whole = np.logical_and.reduceat(gone, heads)
            keep = np.repeat(~whole, np.diff(np.append(heads, len(raw))))
            out.append(raw[keep].tobytes().decode())
        return pa.array(out, pa.string())

    # as if not deterministic: the filter below would otherwise run it a second time, in workers of its own
    cut_udf = F.arrow_udf(cut, "string").asNondeterministic()
    done = spanned.withColumn("text", cut_udf("text", SPANS)).where(F.col(SPANS).isNull() | (F.col("text") != ""))
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.when(F.col(SPANS).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(dict(docs.dtypes)["n_chars"])))
    return done.select(*names)
