"""Byte-level BPE by a tokenisation automaton.

The automaton reads tokens. It starts with one state and one arc for each byte;
each merge (u, v) in order of rank is one gadget: the state p that u leads to no
longer reads v (split off from the other tokens that shared p), and every state
that read u now reads uv as well, into the state behind v. What is left is
deterministic, and the only path whose arc labels spell a word is its BPE
tokenisation.

A state is split from another, so states form a tree. The gadget of (u, v) takes the
arc v, and with it all arcs that begin with v and are made later, from a whole
subtree of it: an interval of its preorder. The transition table is compiled from
these intervals: for each label the sorted, disjoint intervals of the states that
don't read it. Encoding is one pass over a word, along a byte trie of the labels and
by look-ups in that table. Merges must be such as training gives them: each pair is
how its own label is encoded by the merges before it. Words come from the byte-level
pre-tokenisation pattern; decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.common import held, small_batches, trim

#: Fixed value: the pre-tokenisation of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over ASCII texts, for the faster of two libraries.
ASCII_PATTERN = r" ?[A-Za-z]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Words whose path is kept in each Python worker: so many new ones, and those that were new before them.
KEPT_WORDS = 150_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in plain):
        signs[chr(256 + i)] = b
    return signs


class Automaton:
    """The tokenisation automaton of a byte-level BPE file's content."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model = spec["model"]
        signs = byte_alphabet()
        vocabulary: dict[str, int] = model["vocab"]
        label = lambda token: bytes(signs[c] for c in token)
        self.labels: dict[int, bytes] = {i: label(t) for t, i in vocabulary.items() if all(c in signs for c in t)}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.labels |= {i: t.encode() for t, i in self.specials.items()}
        self.emitted = [self.labels.get(i, b"") for i in range(max(self.labels, default=-1) + 1)]
        self.split_specials = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.split_words = regex.compile(PATTERN)
        self.split_ascii = re.compile(ASCII_PATTERN, re.ASCII)
        single = {signs[t]: i for t, i in vocabulary.items() if len(t) == 1 and t in signs}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._build(single, [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in merges])
        self._trie()
        self._words: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def _build(self, single: dict[int, int], merges: Sequence[tuple[int, int, int]]) -> None:
        behind = dict.fromkeys(single.values(), 0)  # the state that a label leads to
        parent = [-1]  # of a state: what it was split from
        taken: dict[int, list[int]] = {token: [] for token in behind}  # of a label: the states whose gadgets took it away
        lost: dict[int, list[int]] = {token: [] for token in behind}  # of a label: the states that had lost its beginning when it was made
        for now, (u, v, uv) in enumerate(merges):
            if u not in behind or v not in behind or uv in behind:
                raise ValueError(f"merge {now} doesn't follow from the merges before it")
            behind_v = behind[v]
            parent.append(behind[u])
            behind[u] = len(parent) - 1
            taken[v].append(len(parent) - 1)
            # for u == v the arc uv ends where v ended before the split, and what v was taken from doesn't read it
            behind[uv] = behind_v
            lost[uv] = lost[u] + taken[u]
            taken[uv] = []
        self._compile(behind, parent, {token: lost[token] + taken[token] for token in behind})

    def _compile(self, behind: dict[int, int], parent: list[int], without: dict[int, list[int]]) -> None:
        """States get their places in the preorder; of a label's intervals the outermost stay."""
        n = len(parent)
        size = [1] * n
        for state in range(n - 1, 0, -1):
            size[parent[state]] += size[state]
        place, free = [0] * n, [1] * n
        for state in range(1, n):
            place[state] = free[parent[state]]
            free[parent[state]] += size[state]
            free[state] = place[state] + 1
        self.behind = {token: place[state] for token, state in behind.items()}
        self.states = n
        label = np.repeat(np.fromiter(without, np.int64, len(without)), [len(states) for states in without.values()])
        states = np.fromiter((state for some in without.values() for state in some), np.int64, len(label))
        first = label * n + np.array(place, np.int64)[states]
        order = np.argsort(first, kind="stable")
        first = first[order]
        last = (first + np.array(size, np.int64)[states[order]]) - 1
        outermost = np.ones(len(first), bool)
        outermost[1:] = last[1:] > np.maximum.accumulate(last)[:-1]
        self.lost_from = array("q", first[outermost].tobytes())
        self.lost_to = array("q", last[outermost].tobytes())

    def _trie(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.accepts = [-1]
        self.longest = max((len(self.labels[token]) for token in self.behind), default=0)
        special = set(self.specials.values())
        for token in self.behind:
            if token in special:
                continue
            node = 0
            for b in self.labels[token]:
                node = self.children[node].setdefault(b, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.accepts.append(-1)
            self.accepts[node] = token

    def reads(self, state: int, token: int) -> bool:
        """Whether the state has the arc, by the table."""
        cell = token * self.states + state
        at = bisect_right(self.lost_from, cell)
        return at == 0 or self.lost_to[at - 1] < cell

    def word(self, word: bytes) -> tuple[int, ...]:
        """The labels on the only path that spells the word.

        Each beginning of the word has one path too, so a place is entered by one arc
        at most. Places wait in `open_places`, the latest first; each is left once, by
        all its arcs, until the word's end is entered.
        """
        n = len(word)
        children, accepts, behind, states, longest = self.children, self.accepts, self.behind, self.states, self.longest
        lost_from, lost_to = self.lost_from, self.lost_to
        entered = [-1] * (n + 1)
        open_places = [0]
        while entered[n] < 0 < n:
            j = at = open_places.pop()
            state = behind[entered[at]] if at else 0
            arcs = children[0]
            for b in word[at:at + longest]:
                node = arcs.get(b)
                if node is None:
                    break
                j += 1
                arcs = children[node]
                token = accepts[node]
                if token >= 0 and entered[j] < 0:
                    if state:
                        cell = token * states + state
                        i = bisect_right(lost_from, cell)
                        if i and lost_to[i - 1] >= cell:
                            continue
                    entered[j] = token
                    open_places.append(j)
        path = []
        while n:
            path.append(entered[n])
            n -= len(self.emitted[entered[n]])
        return tuple(reversed(path))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self._words.get
        words = (self.split_ascii if text.isascii() else self.split_words).findall
        at = 0
        spans = [m.span() for m in self.split_specials.finditer(text)] if self.split_specials else []
        for start, end in [*spans, (len(text), len(text))]:
            for w in words(text, at, start) if start > at else ():
                ids = known(w)
                if ids is None:
                    ids = self._new_word(w)
                    known = self._words.get
                out += ids
            if end > start:
                out.append(self.specials[text[start:end]])
            at = end
        return out

    def _new_word(self, w: str) -> tuple[int, ...]:
        ids = self._older.get(w)
        if ids is None:
            ids = self.word(w.encode("utf-8", "replace"))
        if len(w) <= 64:
            if len(self._words) >= KEPT_WORDS:
                self._older, self._words = self._words, {}
            self._words[w] = ids
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        """The labels of the arcs, as UTF-8; ids that no arc has emit nothing, ids outside the vocabulary are an error."""
        return b"".join(map(self.emitted.__getitem__, ids)).decode("utf-8", "replace")


def automaton(content: str) -> Automaton:
    """Compiled once in each process, as long as that works for this operator."""
    return held(("bpe", hashlib.sha1(content.encode()).hexdigest()), lambda: Automaton(content))


def load(path: str) -> str:
    """A vocabulary file's content, read on the driver and sent along: its size doesn't grow with the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(load(path))


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with the column `to`: the token ids of the whole text; null and empty texts give an empty list."""
    small_batches(docs.sparkSession)
    shared = _shared(docs.sparkSession, path)

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        a = automaton(shared.value)
        return pa.array([a.encode(t.as_py()) if t.is_valid else [] for t in column], pa.list_(pa.int32()))

    return docs.withColumn(to, ids(F.col(text).cast("string")))


def decode(docs: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with the column `to`: the text of the token ids; null and no ids give an empty text. Repeated rows stay, no rows give none."""
    small_batches(docs.sparkSession)
    shared = _shared(docs.sparkSession, path)

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        a = automaton(shared.value)
        return pa.array([a.decode(x.as_py()) if x.is_valid else "" for x in column], pa.string())

    return docs.withColumn(to, texts(ids))


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, so that ids needn't leave the worker; with keep_ids also ids.

    One row per row of docs, repeated keys too; a null key stays null, a null text
    counts as empty; other columns are ignored. A text is held whole.
    """
    small_batches(docs.sparkSession)
    shared = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(shared.value)
        decimal = [str(i) for i in range(len(a.emitted))].__getitem__
        for batch in batches:
            n, ids_hex, text_hex, kept = [], [], [], []
            for value in batch.column(1):
                ids = a.encode(value.as_py() or "")
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                text_hex.append(hashlib.sha256(a.decode(ids).encode()).hexdigest())
                if keep_ids:
                    kept.append(array("i", ids))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            if keep_ids:
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(kept), np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names)
        trim()

    schema = f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, schema)
