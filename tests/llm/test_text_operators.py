"""BPE, MinHash, suffix, decontamination: against brute force and the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest

from graphmill.llm import bpe, decontaminate, minhash, queries, suffix
from tests.conftest import rows

ALPHABETS = ["ab", "abcdef é", "abcdefghijklmnopqrstuvwxyz ", "xyz \n\tÀ😀"]


def text(rng, least=0, most=400):
    letters = rng.choice(ALPHABETS)
    return "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary_path()


# ---- BPE


def test_automaton_equals_the_library(vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    library.no_padding()
    library.no_truncation()
    a = bpe.Automaton(bpe.load(vocabulary))
    rng = random.Random(3)
    signs = [chr(i) for i in range(256)] + list("  ​😀中़١\x1c\x85")
    samples = ["", " ", "   \n", "<|endoftext|>", "a<|endoftext|> b", "aaaaaaaaaaaaaaa", "don't we'll I'm", "hello " * 40, "x" * 3000]
    samples += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    samples += ["".join(rng.choice("abcdefghijklmnop QRST'") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    for s in samples:
        expected = library.encode(s, add_special_tokens=False).ids
        assert a.encode(s) == expected, s
        assert a.decode(expected) == library.decode(expected, skip_special_tokens=False) == s


def test_automaton_refuses_merges_out_of_order():
    with pytest.raises(ValueError):
        bpe.Automaton('{"model": {"vocab": {"a": 0, "b": 1, "abb": 2, "ab": 3}, "merges": ["ab b", "a b"]}}')


def test_every_cell_of_the_table_by_the_merges():
    def merged(symbols, merges):
        for u, v in merges:
            out = []
            for x in symbols:
                if out and (out[-1], x) == (u, v):
                    out[-1] = u + v
                else:
                    out.append(x)
            symbols = out
        return symbols

    rng = random.Random(11)
    for _ in range(40):
        tokens, merges = list("abc"), []
        while len(merges) < 25:
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens and merged(list(u + v), merges) == [u, v]:
                tokens.append(u + v)
                merges.append((u, v))
        content = json.dumps({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": [f"{u} {v}" for u, v in merges]}})
        a = bpe.Automaton(content)
        for i, u in enumerate(tokens):
            for j, v in enumerate(tokens):
                assert a.reads(a.behind[i], j) == (merged(list(u + v), merges) == [u, v]), (merges, u, v)
        for _ in range(50):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
            assert [tokens[i] for i in a.word(word.encode())] == merged(list(word), merges), (merges, word)


def test_round_trip_handles_odd_rows(spark, vocabulary):
    docs = spark.createDataFrame([(1, None, "x"), (None, "hé llo", "x"), (1, "", "x"), (1, "", "x"), (2, "w" * 200_000, "x")], "doc_id long, text string, ids string")
    got = bpe.round_trip(docs, vocabulary).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.n_tokens for r in got if r.doc_id == 1] == [0, 0, 0]
    assert all(r.ids_sha256 == r.decoded_sha256 == empty for r in got if r.doc_id == 1)
    assert next(r for r in got if r.doc_id is None).decoded_sha256 == hashlib.sha256("hé llo".encode()).hexdigest()
    assert next(r for r in got if r.doc_id == 2).decoded_sha256 == hashlib.sha256(b"w" * 200_000).hexdigest()
    assert bpe.round_trip(docs.limit(0), vocabulary).count() == 0
    both = bpe.decode(bpe.encode(docs.drop("ids"), vocabulary), vocabulary)
    assert all((r.text or "") == r.decoded for r in both.collect())


# ---- MinHash


def shingles(value):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value or "")
    words = lower.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def near(docs, percent=75):
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in components(ids, links).items()}


def edited(rng, words, share):
    return " ".join(rng.choice(["q", "w", "e"]) + str(rng.randint(0, 99)) if rng.random() < share else w for w in words)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    docs = []
    for family in range(6):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(3, 120))]
        docs += [" ".join(base)] * rng.randint(1, 3)
        docs += [edited(rng, base, rng.choice([0.01, 0.03, 0.06, 0.1])) for _ in range(25)]
    docs += ["", "  \n", "One two", "one TWO", "ein Wort", "Wort"]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    expected = near(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(docs)


def test_near_duplicates_of_odd_rows(spark):
    body = " ".join(map(str, range(30)))
    docs = spark.createDataFrame([(None, body, 1), (4, body, 1), (4, body, 2), (2, body + " x", 3), (7, None, 4), (8, "", 5)], "doc_id long, text string, component_id int")
    got = rows(minhash.near_duplicates(docs).select("doc_id", "component_id", "kept"))
    assert got == rows(spark.createDataFrame([(None, None, True), (4, 2, False), (4, 2, False), (2, 2, True), (7, 7, True), (8, 8, True)], "a long, b long, c boolean"))
    kept = minhash.without_near_duplicates(docs)
    assert sorted(((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())) == [-1, 2, 7, 8]
    assert kept.columns == docs.columns
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def thue_morse(n, flip=0):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def test_words_of_equal_structure_are_no_copies(spark):
    # they collide under any polynomial hash modulo 2**64 with an odd base
    texts = [t for n in (64, 1024, 4096) for t in (thue_morse(n), thue_morse(n, 1))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.kept and r.component_id == r.doc_id for r in minhash.near_duplicates(docs).collect())
    items = spark.createDataFrame([(9, texts[3])], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contained(docs, items).collect()] == [3]
    long = [(i, t * 2) for i, t in enumerate(texts)]
    got = {r.doc_id: r.n_removed for r in suffix.digests(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    gone = covered(long)
    assert got == {i: int(gone[i].sum()) for i, _ in long}


def test_short_texts_at_the_threshold_equal_brute_force(spark):
    rng = random.Random(8)
    docs, pairs = [], []
    for family in range(30):
        base = [f"v{family}x{i}" for i in range(12)]
        # every bucket that both members of a pair are in is led by a text that links with neither
        docs += [" ".join(base[:7] + [f"y{rng.randint(0, 10**9)}" for _ in range(4)]) for _ in range(80)]
        pairs += [" ".join(base[:7]), " ".join(base[:8])]
    docs = list(enumerate(docs + pairs))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near(docs)


def test_fine_filter_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(8)
    most = minhash.most_disagreements(0.75, minhash.FINE_PERMUTATIONS, minhash.FINE_BITS)
    two = np.uint64(3)
    for size in (4, 8, 12) * 60:
        y = rng.integers(0, 2**63, size, dtype=np.uint64)
        a, b = (minhash.pack(minhash.minima(s, minhash.FINE_PERMUTATIONS), minhash.FINE_BITS) for s in (y[: size * 3 // 4], y))
        assert sum(int((((a ^ b) >> np.uint64(i)) & two != 0).sum()) for i in range(0, 64, 2)) <= most


# ---- suffix


def covered(docs):
    seen, out = set(), {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(raw[i : i + 100])
        out[d] = gone
    return out


def repetitive(rng):
    parts = [text(rng, 60, 500) for _ in range(4)]
    out = []
    for d in range(40):
        t = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(parts)
            i = rng.randint(0, len(p))
            t += p[i : rng.randint(i, len(p))] + (text(rng, 0, 120) if rng.random() < 0.5 else "")
        if t and rng.random() < 0.4:
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        out.append((3 * d, t))
    return [*out, (1, "a" * 500), (4, "ab" * 300), (200, None), (201, ""), (202, "z" * 99)]


def test_suffix_equals_brute_force(spark):
    for seed in range(4):
        docs = repetitive(random.Random(seed))
        expected = {}
        for d, gone in covered(docs).items():
            raw = np.frombuffer((dict(docs)[d] or "").encode(), np.uint8)
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            expected[d] = (len(raw), int(gone.sum()), runs, hashlib.sha256(raw[~gone].tobytes()).hexdigest())
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        for most_of_anchor in (suffix.MOST_OF_ANCHOR, 1):  # the second splits every anchor of different segments
            got = suffix.digests(frame, most_of_anchor).collect()
            assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == expected


def test_suffix_buckets_are_even():
    rng = random.Random(5)
    rows = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([text(rng, 4000, 5000) for _ in range(40)])], names=["doc_id", "text"])
    sizes = dict.fromkeys(range(64), 0)
    for batch in suffix._anchor(6)(iter([rows])):
        for p, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sizes[p] += len(blob) if kind == 0 else 0
    assert max(sizes.values()) < 3 * sum(sizes.values()) / 64


def test_suffix_splits_a_hot_line_until_few_are_left(monkeypatch):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line = some(105)
    data = np.frombuffer("".join(some(80) + line + some(80) for _ in range(200)).encode(), np.uint8)
    offsets = np.arange(0, len(data) + 1, len(data) // 200)
    row, start, size, off, f, seg = suffix.segments(data, offsets)
    x = np.zeros(len(row), suffix.SEGMENT)
    x["doc"], x["start"], x["size"], x["off"], x["f"], x["seg"] = row, start, size, off, f, seg
    begin = offsets[row] + start
    expected = suffix.merged(*suffix.long_matches(x, data, begin))
    assert len(expected[0]) == 199 and np.unique(f, return_counts=True)[1].max() > 100
    seen, plain = [], suffix.long_matches
    monkeypatch.setattr(suffix, "long_matches", lambda x, *more: seen.append(len(x)) or plain(x, *more))
    for most in (1, 16):
        got = suffix.merged(*(np.concatenate(c) for c in zip(*suffix.bounded_matches(x, data, begin, most), strict=True)))
        assert all((a == b).all() for a, b in zip(got, expected, strict=True))
        assert max(seen) <= most
        seen.clear()


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 1 << 9)
    monkeypatch.setattr(suffix, "_PLACES", np.uint64((1 << 9) - 1))
    raw = np.frombuffer(text(random.Random(1), 4000, 5000).encode(), np.uint8)
    row, start, size, off, _, _ = suffix.segments(raw, np.array([0, len(raw)]))
    # every string is in exactly one segment
    assert sorted(p for a, n in zip(start, size, strict=True) for p in range(a, a + n)) == list(range(len(raw) - 99))
    assert ((start + off >= start) & (off <= suffix.WINDOW - 1)).all()


def test_suffix_of_odd_rows(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(300))
    docs = spark.createDataFrame([(1, long, "a"), (1, long, "b"), (None, long, "c"), (2, "é" * 150 + long, "d"), (3, None, "e")], "doc_id long, text string, spans string")
    got = suffix.digests(docs).collect()
    removed = {(r.doc_id, r.n_bytes): r.n_removed for r in got}
    assert len(got) == 5
    # the row without an id comes first; rows of one id and text are one document
    assert removed[(1, 300)] == 300
    assert removed[(2, 600)] == 300 + 298  # 150 two-byte letters repeat themselves
    cut = suffix.without_repeats(docs)
    assert cut.columns == docs.columns
    assert {(r.doc_id, r.text) for r in cut.collect() if r.doc_id == 3} == {(3, None)}
    assert suffix.digests(docs.limit(0)).count() == 0


# ---- decontamination


def test_containment_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"t{rng.randint(0, 900)}" for _ in range(rng.choice([2, 6, 14, 30, 70, 200])))) for i in range(40)]
    docs = []
    for d in range(60):
        words = [f"t{rng.randint(0, 900)}" for _ in range(rng.randint(0, 1500))]
        if rng.random() < 0.7:
            own = rng.choice(items)[1].split()
            if rng.random() < 0.5 and len(own) > 20:
                own[rng.randrange(len(own))] = "changed"
            k = rng.randint(0, len(words))
            words[k:k] = own
        docs.append((d, " ".join(words)))
    docs += [(90, items[0][1]), (91, None), (92, ""), (None, items[1][1])]
    sets = {i: shingles(t) for i, t in items}
    expected = [(d, i, len(shingles(t) & s), len(s)) for d, t in docs for i, s in sets.items() if s and 100 * len(shingles(t) & s) >= 75 * len(s)]
    found = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (77, None), (78, "")], "item_id long, text string"))
    assert sorted(map(repr, (tuple(r)[:4] for r in found.collect()))) == sorted(map(repr, expected))
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id")
    kept = decontaminate.without_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    assert kept.count() == len(docs) - len({d for d, *_ in expected})
    assert decontaminate.contained(frame.limit(0), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_items_come_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    words = lambda i: " ".join(f"i{i}w{k}" for k in range(8))
    items = spark.createDataFrame([(i, words(i)) for i in range(10)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x y {words(7)} z")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contained(docs, items).collect()] == [(1, 7)]
