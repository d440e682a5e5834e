"""Toxicity: a Levenshtein automaton over a lexicon trie, and the context of what it finds.

The lexicon comes from labelled documents: words, and beginnings of words, that
toxic documents hold far more often than others, as far as chance doesn't explain
it. Its trie is intersected with the
Levenshtein automaton of each term (no edit below five letters, one below nine,
two from there) and determinised as words come in, so that a word costs a few
table look-ups and most words leave the automaton after some letters. Each find
weighs the logarithm of how much likelier its spelling is in toxic text than in
other text, from the spelling's counts, backed by its term's. A find
that stands in quotation marks, or is spoken about, weighs little.

The context of a find is the run of tokens around it: a token costs the rate at
which toxic text has finds, a find adds its weight, and the best run counts. Such
a run turns up by chance in proportion to the tokens of the text, so their
logarithm is taken off; what is left are the log-odds of the score. One chance
find in a long text is thus no abuse, and abuse in a part of a long text is.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import held, lean, small_batches
from graphmill.llm.quality import held_out, labelled_sample

#: Rows of each class that learning may take.
MOST_ROWS = 3000
#: Tokens before and after a find in which quotation marks are looked for.
WINDOW = 6
#: The share of toxic documents among those with a find of so many edits, before any is counted, and the weight of that.
PRIOR_SHARE, PRIOR_WEIGHT = (0.95, 0.85, 0.7), 3
#: The weight of a term's share in the chance of a spelling.
BACKING = 4
#: What a quoted or spoken-about find weighs at most.
QUOTED = 0.5
PUNCTUATION = ".,;:!?\"'()[]{}<>«»„“”‚‘’*_~`/\\|+=#%&$@^…–—-¡¿"
OPENING, CLOSING = "\"«„“‚‘»", "\"»“”‘’«"
#: Words that speak about a word.
REPORTING = frozenset(("word", "words", "term", "slur", "quote", "quoted", "quotes", "said", "says", "called", "wrote", "mot", "dit", "wort", "sagte", "palabra", "dijo"))
#: Tokens and states of the automaton kept in each Python worker.
KEPT_TOKENS, KEPT_STATES = 150_000, 8_000
#: The share of the lexicon that may be there by chance.
BY_CHANCE = 0.05
#: How many times as frequent in toxic documents a term, and a stem, must be.
TERM_TIMES, STEM_TIMES = 20, 6


def normal(token: str) -> str:
    return token.strip(PUNCTUATION).lower()


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """Finds the term nearest to a word. terms: whole words; stems: beginnings, matched exactly."""

    def __init__(self, terms: Iterable[str], stems: Iterable[str] = ()) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.most, self.term, self.stem = [0], [""], [""]
        self.allowed: dict[int, int] = {}
        for words, kind, fuzzy in ((terms, self.term, True), (stems, self.stem, False)):
            for word in words:
                node, k = 0, edits(word) if fuzzy else 0
                self.most[0] = max(self.most[0], k)
                for c in word:
                    node = self.children[node].setdefault(c, len(self.children))
                    if node == len(self.children):
                        self.children.append({})
                        for column in (self.term, self.stem):
                            column.append("")
                        self.most.append(0)
                    self.most[node] = max(self.most[node], k)
                kind[node] = word
                if kind is self.term:
                    self.allowed[node] = k
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.begun: list[str] = []
        self.start = self._state({0: 0})

    def _state(self, places: dict[int, int]) -> int:
        """The state of trie nodes with their least edits, closed under leaving out letters; -1 for none."""
        queue = list(places.items())
        while queue:
            node, e = queue.pop()
            if places.get(node) != e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and places.get(child, 99) > e + 1:
                    places[child] = e + 1
                    queue.append((child, e + 1))
        if not places:
            return -1
        key = frozenset(places.items())
        known = self.ids.get(key)
        if known is None:
            known = self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            fits = [(e, self.term[n]) for n, e in key if self.term[n] and e <= self.allowed[n]]
            self.found.append((min(fits)[1], min(fits)[0]) if fits else None)
            self.begun.append(min((self.stem[n] for n, e in key if e == 0 and self.stem[n]), default=""))
        return known

    def _step(self, state: int, c: str) -> int:
        places: dict[int, int] = {}
        for node, e in self.sets[state]:
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and places.get(child, 99) > cost:
                    places[child] = cost
            if e + 1 <= self.most[node] and places.get(node, 99) > e + 1:
                places[node] = e + 1
        out = self.next[state][c] = self._state(places)
        return out

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, or (stem + "*", 0); None if there is none."""
        if len(self.sets) > KEPT_STATES:
            self._reset()
        state, table, begun = self.start, self.next, ""
        for c in word:
            following = table[state].get(c)
            if following is None:
                following = self._step(state, c)
            state = following
            if state < 0:
                break
            begun = begun or self.begun[state]
        found = self.found[state] if state >= 0 else None
        if found is not None and (found[1] == 0 or not begun):
            return found
        return (begun + "*", 0) if begun else None


@dataclass
class Model:
    """shares: of finds that are in toxic text, by (term, edits); counts: finds in (toxic, other) text by spelling; texts of both kinds weigh the same. rate: finds a token in toxic text."""

    terms: list[str]
    stems: list[str]
    shares: Mapping[tuple[str, int], float] = field(default_factory=dict)
    counts: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    rate: float = 0.0

    def weight(self, spelling: str, term: str, e: int) -> float:
        """How much likelier the find is in toxic text, as a logarithm; 0 if it isn't."""
        share = self.shares.get((term, e), PRIOR_SHARE[e])
        toxic, other = self.counts.get(spelling, (0.0, 0.0))
        return max(0.0, math.log((toxic + BACKING * share) / (other + BACKING * (1 - share))))


class Finder:
    """Finds in texts, with the tokens seen so far."""

    def __init__(self, model: Model) -> None:
        self.model, self.matcher = model, Matcher(model.terms, model.stems)
        self.seen: set[str] = set()
        self.bad: dict[str, tuple[str, str, int]] = {}

    def finds(self, tokens: list[str]) -> Iterator[tuple[int, str, str, int]]:
        """(place, spelling, term, edits) of each find, in order; a spelling said again at once counts once."""
        own = set(tokens)
        if len(self.seen) > KEPT_TOKENS:
            self.seen.clear()
            self.bad.clear()
        fresh = own - self.seen
        for token in fresh:
            word = normal(token)
            if (found := self.matcher.match(word)) is not None:
                self.bad[token] = (word, *found)
        self.seen |= fresh
        if self.bad.keys().isdisjoint(own):
            return
        last, at = "", -1
        for i, token in enumerate(tokens):
            found = self.bad.get(token)
            if found is not None:
                if found[0] != last or i > at + 1:
                    yield (i, *found)
                last, at = found[0], i

    def score(self, text: str) -> float:
        tokens = text.split()
        best = run = 0.0
        end = 0
        for i, spelling, term, e in self.finds(tokens):
            weight = self.model.weight(spelling, term, e)
            if quoted(tokens, i):
                weight = min(weight, QUOTED)
            run = max(0.0, run - self.model.rate * (i - end)) + weight
            end = i
            best = max(best, run)
        return 1 / (1 + len(tokens) * math.exp(-best)) if best > 0 else 0.0


def quoted(tokens: list[str], i: int) -> bool:
    """Whether the token stands inside quotation marks that open and close in its window, or right after a word that speaks about it."""
    token = tokens[i]
    before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
    opened = token[0] in OPENING
    for t in before:
        if t[0] in OPENING:
            opened = True
        if len(t) > 1 and t.rstrip(".,;:!?")[-1:] in tuple(CLOSING):
            opened = token[0] in OPENING
    closes = lambda t: t.rstrip(".,;:!?")[-1:] in tuple(CLOSING)
    if opened and (len(token) > 1 and closes(token) or any(closes(t) for t in after)):
        return True
    return any(normal(t) in REPORTING for t in before[-2:])


def lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """(terms, stems) from doc_id, text, label.

    Terms are words with TERM_TIMES the share of the other documents in the toxic
    ones; stems are beginnings of four to six letters of at least four longer words,
    with STEM_TIMES the share. Of both only as many, the surest first, as chance
    (Chernoff's bound) leaves BY_CHANCE of them unexplained (Benjamini and Hochberg).
    Near copies say a word after the same word each time: a part is as sure as so
    many documents make it as it has words before it (their inverse Simpson index).
    A word that begins with a stem, and is in less than half of its toxic documents,
    is left to the stem.
    """
    words = F.transform(F.split(F.lower("text"), r"[\s]+"), lambda t: F.btrim(t, F.lit(PUNCTUATION)))
    docs = sample.select("doc_id", "label", words.alias("words"))
    sizes = {r["label"]: r["n"] for r in docs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    rate = (toxic + 1) / (toxic + other + 2)

    def typical(parts: DataFrame, times: int, least_words: int) -> list[tuple[str, int]]:
        """The surest parts first, with their toxic documents."""
        counts = parts.groupBy("part").agg(
            F.countDistinct(F.when(F.col("label") == 1, F.col("doc_id"))).alias("t"), F.countDistinct(F.when(F.col("label") == 0, F.col("doc_id"))).alias("c"), F.countDistinct("word").alias("words")
        )
        share = F.col("t") / (F.col("t") + F.col("c"))
        sure = F.when(share > 0, F.col("t") * F.log(share / rate)).otherwise(0.0) + F.when(share < 1, F.col("c") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
        often = (share > rate) & (F.col("t") / (toxic + 1) >= times * (F.col("c") + 0.5) / (other + 1)) & (F.col("words") >= least_words)
        tested = counts.select("part", "t", F.when(often, sure).otherwise(0.0).alias("sure")).persist()
        spread = parts.where("label = 1 and not before <=> word").groupBy("part", "before").agg(F.count(F.lit(1)).alias("n"))
        befores = spread.groupBy("part").agg((F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("befores"))
        judged = tested.where(F.col("sure") >= -math.log(BY_CHANCE)).join(befores, "part").select("part", "t", (F.col("sure") * F.least(F.lit(1.0), F.col("befores") / F.col("t"))).alias("sure")).persist()
        try:
            # so many parts by how sure they are: a few hundred rows
            levels = judged.groupBy(F.floor(F.col("sure") * 4).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
            m, seen, cut = tested.count(), 0, None
            for r in sorted(levels, key=lambda r: -r["level"]):
                seen += r["n"]
                if math.exp(-r["level"] / 4) <= BY_CHANCE * seen / m:
                    cut = r["level"] / 4
            if cut is None:
                return []
            return [(r["part"], r["t"]) for r in judged.where(F.col("sure") >= cut).orderBy(F.desc("sure"), "part").collect()]
        finally:
            tested.unpersist()
            judged.unpersist()

    # a null before the first word; the longer array's last place is none
    pairs = F.arrays_zip(F.col("words").alias("word"), F.concat(F.array(F.lit(None).cast("string")), "words").alias("before"))
    each = docs.select("doc_id", "label", F.inline(pairs).alias("word", "before")).where(F.char_length("word") >= 3)
    terms = typical(each.withColumn("part", F.col("word")), TERM_TIMES, 1)
    beginnings = F.transform(F.sequence(F.lit(4), F.lit(6)), lambda k: F.when(F.char_length("word") > k, F.substr("word", F.lit(1), k)))
    begins = each.select("doc_id", "label", "word", "before", F.explode(beginnings).alias("part")).where("part is not null")
    stems: dict[str, int] = {}
    for stem, t in typical(begins, STEM_TIMES, 4):
        if not any(stem.startswith(k) or k.startswith(stem) for k in stems):
            stems[stem] = t
    own = [word for word, t in terms if not any(word.startswith(stem) and 2 * t < most for stem, most in stems.items())]
    return own, list(stems)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, most_rows: int = MOST_ROWS) -> Model:
    """Lexicon and weights from at most most_rows labelled documents of each class outside the held-out fold."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = F.broadcast(labelled_sample(labels, label, folds, fold, most_rows))  # at most 2 * most_rows rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(sample, "doc_id")
    # a repeated id counts once, by its smallest text; equal texts once, by their smallest id and its label
    single = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    rows = single.groupBy("text").agg(F.min(F.struct("doc_id", "label")).alias("first")).select("first.doc_id", "text", "first.label").persist()
    try:
        model = Model(*lexicon(rows))
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value)
            for batch in batches:
                out: list[tuple[str, str, int, int]] = []
                for kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out += ((s, t, e, kind) for _, s, t, e in finder.finds(text.split()))
                yield pa.RecordBatch.from_pylist([dict(zip(("spelling", "term", "edits", "label"), x, strict=True)) for x in out], pa.schema([("spelling", pa.string()), ("term", pa.string()), ("edits", pa.int32()), ("label", pa.int32())]))

        finds = rows.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(lean(run), "spelling string, term string, edits int, label int")
        counts = finds.groupBy("spelling", "term", "edits").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).collect()
        sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()}
    finally:
        rows.unpersist()
    # toxic and other text of unequal length weigh the same
    scale = max(1, sizes.get(1, 0)) / max(1, sizes.get(0, 0))
    by_term: dict[tuple[str, int], list[float]] = {}
    for r in counts:
        sums = by_term.setdefault((r["term"], r["edits"]), [0.0, 0.0])
        sums[0] += r["t"]
        sums[1] += r["c"] * scale
    model.shares = {k: (t + PRIOR_WEIGHT * PRIOR_SHARE[k[1]]) / (t + c + PRIOR_WEIGHT) for k, (t, c) in by_term.items()}
    model.counts = {r["spelling"]: (r["t"], r["c"] * scale) for r in counts}
    model.rate = sum(r["t"] for r in counts) / max(1, sizes.get(1, 0))
    return model


def score_column(docs: DataFrame, model: Model, text: Column) -> Column:
    """The score of a text, 0 to 1; 0 for null and empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    @F.arrow_udf("double")
    def scores(column: pa.Array) -> pa.Array:
        finder = held(("toxicity", key), lambda: Finder(shared.value))
        return pa.array([finder.score(t.as_py()) if t.is_valid else 0.0 for t in column], pa.float64())

    return scores(text.cast("string"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5, fold: int = 0, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs (doc_id, text), repeated rows too.

    Only labels outside the held-out fold are learnt; of equal texts the smallest doc_id's
    label, of rows that repeat a doc_id the smallest text. A null doc_id is never held
    out; a null or empty text scores 0; without toxic labels all texts score 0.
    Other columns are ignored.
    """
    model = learn(docs, labels, folds=folds, fold=fold, most_rows=most_rows)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = plain.withColumn("score", score_column(plain, model, F.col("text")))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of docs that score below the threshold, all columns kept.

    Null and empty texts score 0 and stay; rows that repeat are judged alike; a null
    doc_id is judged but never learnt; no rows give no rows.
    """
    model = learn(docs, labels, most_rows=most_rows)
    return docs.where(score_column(docs, model, F.col("text")) < threshold)
