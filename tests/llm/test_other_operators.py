"""WARC, URLs, embeddings, chat, classifiers, toxicity, against brute force."""

import base64
import gzip
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import chat, embedding, quality, toxicity, urls, warc
from graphmill.llm.queries import CONTROL, URL_RULES
from tests.conftest import rows

SF = "/root/testdata/sf0.01"

# ---- WARC


def archive(spark, tmp_path, pages, **options):
    path = f"file://{tmp_path}/archive"
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string, payload string"), path, **options)
    return path


def test_archives_are_read_back(spark, tmp_path):
    rng = random.Random(2)
    pages = [(i, f"http://a.example/{i}\r\nX: y é", rng.choice(["same", "", None, "p" * 100_000, f"own {rng.random()} é"]), "clash") for i in range(200)]
    path = archive(spark, tmp_path, pages)
    first = {}
    for i, _, html, _ in pages:
        first.setdefault(html or "", i)
    for split in (1 << 24, 997):
        got = warc.read(spark, path, split_bytes=split).collect()
        assert len(got) == len(pages)
        for r in got:
            i = int(re.fullmatch(r"<urn:page:(\d+)>", r.record_id)[1])
            raw = (pages[i][2] or "").encode()
            assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            assert r.record_type == ("response" if first[pages[i][2] or ""] == i else "revisit")
            assert r.refers_to == (None if r.record_type == "response" else f"<urn:page:{first[pages[i][2] or '']}>")
            assert r.payload == (raw if r.record_type == "response" else None)
            assert r.declared_digest == r.payload_digest
    for name in os.listdir(tmp_path / "archive"):
        if name.startswith("part"):
            gzip.decompress((tmp_path / "archive" / name).read_bytes())


def test_odd_pages(spark, tmp_path):
    big = "x" * (17 << 20)
    path = archive(spark, tmp_path, [(None, None, "a", ""), (3, None, "a", ""), (3, "u", "a", ""), (5, "u", "a", ""), (9, "u", big, "")], least_bytes=1)
    got = warc.read(spark, path, payload=False).collect()
    assert sorted((r.record_id, r.record_type) for r in got) == [("<urn:page:3>", "response"), ("<urn:page:3>", "response"), ("<urn:page:5>", "revisit"), ("<urn:page:9>", "response"), ("<urn:page:null>", "response")]
    assert max(r.payload_bytes for r in got) == 17 << 20


def test_small_payloads_are_all_responses(spark, tmp_path):
    path = archive(spark, tmp_path, [(1, "u", "ab", ""), (2, "u", "ab", "")], least_bytes=3)
    assert {r.record_type for r in warc.read(spark, path).collect()} == {"response"}


def test_no_pages(spark, tmp_path):
    path = archive(spark, tmp_path, [])
    assert warc.read(spark, path).count() == 0


def test_magic_that_begins_no_record_is_passed_over(tmp_path):
    member = warc.member(7, "u", b"body", None, "2000-01-01T00:00:00Z")
    (tmp_path / "f").write_bytes(b"junk\x1f\x8b\x08junk" + gzip.compress(b"no record") + member + warc.EMPTY_MEMBER + member)
    assert [r["record_id"] for r in warc.records(str(tmp_path / "f"), 0, 10**6)] == ["<urn:page:7>"] * 2


# ---- URLs


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def test_hosts_paths_and_rules(spark):
    samples = [
        None, "", "no scheme/x", "http://", "http://A.Example.NET/EN/1", "https://a.example.net/en/1?x#y", "ftp://example.net", "http://example.net/", "http://xexample.net/en/",
        "http://b.example.com/de/5", "http://b.example.com/fr/5", "http://x.org/fr/1", "http://x.org/fr", "http://Ünï.org/fr/ü\n?q", "a://b://c/d", "http://example.net?x/en/", "http://org/fr/1",
    ]
    pages = spark.createDataFrame(list(enumerate(samples)), "page_id long, url string").selectExpr("*", "'clash' as host", "'clash' as purity")
    labelled = spark.createDataFrame([], "url string, label int")
    got = {r.page_id: r for r in urls.judge(pages, URL_RULES, labelled).collect()}
    assert len(got) == len(samples)
    for i, url in enumerate(samples):
        host, path = split_url(url)
        fits = [(len(r), r, v) for r, v in URL_RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), url


def test_templates_are_rejected_by_labelled_purity(spark):
    rng = random.Random(4)
    labelled = [(f"http://h.example/bad/{rng.randint(0, 10**6)}", 0) for _ in range(60)] + [(f"http://h.example/good/{rng.randint(0, 10**6)}", 1) for _ in range(60)]
    labelled += [(f"http://m.example/{a}/{rng.randint(0, 99)}", int(rng.random() < 0.9)) for a in "abc" for _ in range(50)] + [("http://h.example/x", None)]
    # what doesn't differ from its node has one wildcard child
    labelled += [(f"http://w.example/u{i}z/page", 0) for i in range(40)]
    pages = [(1, "http://h.example/bad/5"), (2, "http://h.example/good/7"), (3, "http://m.example/a/1"), (4, "http://w.example/unseenz/page"), (5, "http://h.example/bad/5/deep/er/than/four/levels"), (5, "http://h.example/bad/5")]
    got = [(r.page_id, r.verdict, r.template) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), (), spark.createDataFrame(labelled, "url string, label int")).collect()]
    by_id = {i: (v, t) for i, v, t in got if i != 5}
    assert by_id == {1: ("block", "/bad/{n}"), 2: ("allow", "/good/{n}"), 3: ("allow", "/*/{n}"), 4: ("block", "/*/page")}
    assert len(got) == len(pages)


def test_branches_of_crowded_and_deep_nodes(spark):
    rng = random.Random(9)
    labelled = [(f"http://c.example/spam/{i}", 0) for i in range(400)]
    labelled += [(f"http://c.example/s{k}x/{i}", 1) for k in range(40) for i in range(10)]
    # noise: many sections of one label each stay one template
    labelled += [(f"http://n.example/z{k}y/{k}", int(rng.random() < 0.8)) for k in range(300)]
    labelled += [(f"http://d.example/a/b/c/d/e/{kind}/{i}", good) for kind, good in (("bad", 0), ("fine", 1)) for i in range(60)]
    pages = [(1, "http://c.example/spam/5"), (2, "http://c.example/s3x/7"), (3, "http://n.example/z4y/4"), (4, "http://n.example/z5y/5"), (5, "http://d.example/a/b/c/d/e/bad/5"), (6, "http://d.example/a/b/c/d/e/fine/5")]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), (), spark.createDataFrame(labelled, "url string, label int")).collect()
    by_id = {r.page_id: (r.verdict, r.template) for r in got}
    assert by_id[1] == ("block", "/spam/{n}") and by_id[2] == ("allow", "/*/{n}")
    assert by_id[3] == by_id[4] == ("allow", "/*/{n}")
    assert by_id[5] == ("block", "/a/b/c/d/e/bad/{n}") and by_id[6] == ("allow", "/a/b/c/d/e/fine/{n}")


@pytest.mark.parametrize("siblings", [2, 15, 16, 40])
def test_a_bad_branch_is_seen_beside_any_number_of_siblings(spark, siblings):
    """Four bad pages beside siblings of ten pages, seven of them good."""
    labelled = [(f"http://p.example/bad/{i}", 0) for i in range(4 + 3 * (siblings > 16))]
    labelled += [(f"http://p.example/s{k}x/{i}", int(i < 7)) for k in range(siblings) for i in range(10)]
    pages = [(1, "http://p.example/bad/9"), (2, "http://p.example/s0x/9")]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), (), spark.createDataFrame(labelled, "url string, label int")).collect()
    assert {r.page_id: (r.verdict, r.template) for r in got} == {1: ("block", "/bad/{n}"), 2: ("allow", "/*/{n}")}


def plain_templates(forms, by_chance=0.2):
    """The template of each form (a tuple: labelled, good) of one host, by recursion."""
    if not any(forms):
        return {f: f for f in forms}
    children = {}
    for form, (labelled, good) in forms.items():
        if form:
            children.setdefault(form[0], {})[form[1:]] = (labelled, good)
    sums = {c: tuple(map(sum, zip(*rest.values(), strict=True))) for c, rest in children.items()}
    rate = (sum(min(n, 16) * g / n for n, g in sums.values() if n) + 1) / (sum(min(n, 16) for n, _ in sums.values()) + 2)

    def level(n, g):
        part = lambda p, q: p * math.log(p / q) if p > 0 else 0.0
        return min(400, math.floor(4 * n * (part(g / n, rate) + part(1 - g / n, 1 - rate)))) if n else 0

    levels = {c: level(*x) for c, x in sums.items()}
    judged = sum(n > 0 for n, _ in sums.values())
    cuts = [k for k in set(levels.values()) if judged * math.exp(-k / 4) <= by_chance * sum(x >= k for x in levels.values())]
    kept = {c for c in children if len(children) == 1 or (cuts and levels[c] >= min(cuts))}
    out = {f: f for f in forms if not f}
    merged = {}
    for c, rest in children.items():
        if c in kept:
            out |= {(c, *f): (c, *t) for f, t in plain_templates(rest, by_chance).items()}
        else:
            for f, (n, g) in rest.items():
                merged[f] = tuple(map(sum, zip(merged.get(f, (0, 0)), (n, g), strict=True)))
    if merged:
        below = plain_templates(merged, by_chance)
        out |= {(c, *f): ("*", *below[f]) for c, rest in children.items() if c not in kept for f in rest}
    return out


def test_templates_equal_a_plain_tree(spark):
    rng = random.Random(12)
    labelled = []
    for h, width in enumerate((2, 3, 15, 17, 60, 400, 2000)):
        odd = {rng.randrange(width) for _ in range(max(1, width // 10))}
        for k in range(width):
            for _ in range(rng.choice([0, 1, 3, 12])):
                bad = 0.95 if k in odd else 0.2
                labelled.append((f"http://h{h}.example/s{k}x/{rng.choice('abcd')}q/{rng.choice('xyz')}", int(rng.random() > bad)))
    forms = {}
    for url, good in labelled:
        host, *form = url[7:].split("/")
        n, g = forms.setdefault(host, {}).get(tuple(form), (0, 0))
        forms[host][tuple(form)] = (n + 1, g + good)
    pages = list(enumerate(url for url, _ in labelled))
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), (), spark.createDataFrame(labelled, "url string, label int")).collect()
    rate = sum(g for _, g in labelled) / len(labelled)
    for host, own in forms.items():
        expected = plain_templates(own)
        leaves = {}
        for form, template in expected.items():
            n, g = leaves.get(template, (0, 0))
            leaves[template] = (n + own[form][0], g + own[form][1])
        for r in got:
            if r.host == host:
                template = expected[tuple(r.path[1:].split("/"))]
                assert r.template == "/" + "/".join(template)
                n, g = leaves[template]
                assert abs(r.purity - (g + 4 * rate) / (n + 4)) < 1e-9 and r.verdict == ("block" if r.purity < 0.5 else "allow")
    assert any(r.verdict == "block" for r in got) and any("*" in r.template for r in got)


# ---- embeddings


def linked(vectors, threshold=0.98):
    good = {}
    for k, (i, e, label) in enumerate(vectors):
        if i is not None and e is not None and label is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e):
            v = np.array(e, float)
            good[k] = v / np.linalg.norm(v)
    n = {k: 0 for k in range(len(vectors))}
    parent = {i: i for i, _, _ in vectors if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and vectors[a][2] == vectors[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                n[a] += 1
                n[b] += 1
                x, y = find(vectors[a][0]), find(vectors[b][0])
                parent[max(x, y)] = min(x, y)
    return [(i, n[k], find(i) if i is not None else None) for k, (i, _, _) in enumerate(vectors)]


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 16)
    rng = np.random.default_rng(1)
    vectors = []
    for label in (0, 1):
        for _ in range(6):
            base = rng.standard_normal(32)
            vectors += [((base + rng.standard_normal(32) * 0.1).tolist(), label) for _ in range(20)]
    vectors += [(vectors[0][0], 0)] * 3 + [([0.0] * 32, 0), (None, 0), ([1.0, None], 0), ([float("nan")] * 32, 1), (vectors[5][0], None), ([3.0], 0), ([2.0], 0), ([], 0)]
    vectors = [(i, e, label) for i, (e, label) in enumerate(vectors)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").withColumn("codes", F.lit(1))
    got = embedding.near_duplicates(frame).collect()
    expected = linked(vectors)
    assert len(got) == len(vectors)
    found, whole = sum(r.n_links for r in got), sum(n for _, n, _ in expected)
    assert found >= 0.98 * whole
    assert all(r.n_links <= dict((i, n) for i, n, _ in expected)[r.vec_id] for r in got)
    assert {r.vec_id: r.component_id for r in got} == {i: c for i, _, c in expected}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding.near_duplicates(frame.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    hits = 0
    for _ in range(300):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b)
        directions, shifts, _ = embedding.projections(64)
        cells = np.floor((np.stack([a, b]) @ directions + shifts) / embedding.WIDTH).reshape(2, embedding.TABLES, -1)
        hits += bool((cells[0] == cells[1]).all(axis=1).any())
    assert hits / 300 >= 0.98


def test_rows_that_repeat_an_id(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = rows(embedding.near_duplicates(frame).select("vec_id", "n_links", "component_id"))
    assert got == rows(spark.createDataFrame([(1, 2, 1), (1, 2, 1), (None, 0, None), (2, 2, 1)], "a long, b long, c long"))


# ---- chat


def test_chat_is_read_back(spark):
    odd = ["", None, "plain", "&amp; &lt; [x] </s> <s>[user]", CONTROL, "é😀\n]", "&&&", "&#91;", "long " * 5000]
    rng = random.Random(6)
    turns = [(c, t, rng.choice(["user", "assistant", "system", None, "[assistant]"]), rng.choice(odd)) for c in [*range(20), None] for t in range(rng.randint(1, 9))]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash")).repartition(3)
    examples = chat.examples(frame)
    got = {r.conv_id: r for r in chat.digests(examples).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in [*range(20), None]:
        own = [((r or ""), (x or "")) for k, _, r, x in turns if k == c]
        loss = "".join(x for r, x in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for r, x in own))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    for r in examples.collect():
        body = r.formatted.removesuffix("</s>")
        assert "[INST]" not in r.formatted and (r.loss_start is None or r.loss_start + r.loss_length == len(body))
    assert chat.digests(chat.examples(frame.limit(0))).count() == 0
    assert "Python" not in chat.digests(examples)._jdf.queryExecution().executedPlan().toString()


# ---- classifiers


def accuracy(frame, labels, label):
    got = frame.where("held_out").join(labels.select("doc_id", F.col(label).alias("truth")), "doc_id").collect()
    return sum(r.predicted == r.truth for r in got) / len(got)


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.judge(docs, labels)
    assert accuracy(out, labels, "quality") >= 0.95
    assert out.where("score < 0 or score > 1 or score is null").count() == 0
    assert out.where("predicted <> cast(score >= 0.7 as int)").count() == 0
    # held-out labels are never learnt: turned round, nothing changes
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id"), 4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows(quality.judge(docs, turned).select("doc_id", "score")) == rows(out.select("doc_id", "score"))


@pytest.mark.parametrize("folder, least, always", [("sf0.01", 0.95, 0.9), ("sf0.1", 0.98, 0.9)])
def test_toxicity_on_held_out_documents(spark, folder, least, always):
    read = lambda name: spark.read.parquet(f"/root/testdata/{folder}/{name}.parquet")
    docs, labels = read("documents"), read("labels")
    out = toxicity.judge(docs, labels)
    assert accuracy(out, labels, "toxic") >= least > always
    got = out.where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r.predicted for r in got if not r.toxic) <= 0.01 * sum(not r.toxic for r in got)
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def plain_toxicity(docs, labels):
    """Lexicon, weights, context and score without automata, Spark or bounds."""
    learnt = {}
    truth = dict(labels)
    for i, text in docs:
        if text is not None and truth.get(i) is not None and zlib.crc32(str(i).encode()) % 5:
            learnt.setdefault(text, truth[i])
    sizes = [sum(k == v for v in learnt.values()) for k in (0, 1)]

    def sure(parts, times, least_words):
        rate, levels = (sizes[1] + 1) / (sum(sizes) + 2), {}
        for part, (found, words, befores) in parts.items():
            t, c = len(found[1]), len(found[0])
            share = t / (t + c)
            fits = share > rate and t / (sizes[1] + 1) >= times * (c + 0.5) / (sizes[0] + 1) and len(words) >= least_words
            levels[part] = (t * math.log(share / rate) + (c * math.log((1 - share) / (1 - rate)) if c else 0)) if fits else 0.0
            apart = sum(befores.values()) ** 2 / max(1, sum(n * n for n in befores.values()))
            levels[part] *= min(1.0, apart / max(1, t)) * (levels[part] >= -math.log(toxicity.BY_CHANCE))
        steps = sorted({math.floor(4 * v) / 4 for v in levels.values()}, reverse=True)
        good = [x for x in steps if math.exp(-x) <= toxicity.BY_CHANCE * sum(math.floor(4 * v) / 4 >= x for v in levels.values()) / len(levels)]
        best = sorted((p for p, v in levels.items() if good and v >= good[-1]), key=lambda p: (-levels[p], p))
        return {p: len(parts[p][0][1]) for p in best}

    whole, begun = {}, {}
    for n, (text, label) in enumerate(learnt.items()):
        words_of = [toxicity.normal(w) for w in re.split(r"\s+", text)]
        for before, word in zip([None, *words_of], words_of):
            if len(word) >= 3:
                for table, parts in ((whole, [word]), (begun, [word[:k] for k in (4, 5, 6) if len(word) > k])):
                    for part in parts:
                        found, words, befores = table.setdefault(part, ((set(), set()), set(), Counter()))
                        found[label].add(n)
                        words.add(word)
                        if label and before != word:
                            befores[before] += 1
    stems = {}
    for stem, t in sure(begun, toxicity.STEM_TIMES, 4).items():
        if not any(stem.startswith(k) or k.startswith(stem) for k in stems):
            stems[stem] = t
    terms = [w for w, t in sure(whole, toxicity.TERM_TIMES, 1).items() if not any(w.startswith(k) and 2 * t < stems[k] for k in stems)]
    stems = list(stems)

    def finds(tokens):
        out, last, at = [], "", -1
        for i, token in enumerate(tokens):
            word = toxicity.normal(token)
            fits = sorted((d, t) for t in terms if abs(len(t) - len(word)) <= toxicity.edits(t) and (d := distance(word, t)) <= toxicity.edits(t))
            starts = [s for s in stems if word.startswith(s)]
            if (fits or starts) and (word != last or i > at + 1):
                out.append((i, word, *((starts[0] + "*", 0) if starts and (not fits or fits[0][0]) else fits[0][::-1])))
            if fits or starts:
                last, at = word, i
        return out

    length, by_term, by_spelling = [0, 0], {}, {}
    for text, label in learnt.items():
        length[label] += len(text.split())
        for _, spelling, term, e in finds(text.split()):
            by_term.setdefault((term, e), [0, 0])[label] += 1
            by_spelling.setdefault(spelling, [0, 0])[label] += 1
    scale = max(1, length[1]) / max(1, length[0])
    rate = sum(v[1] for v in by_spelling.values()) / max(1, length[1])

    def score(text):
        tokens = text.split()
        found = []
        for i, spelling, term, e in finds(tokens):
            c, t = by_term.get((term, e), (0, 0))
            share = (t + toxicity.PRIOR_WEIGHT * toxicity.PRIOR_SHARE[e]) / (t + c * scale + toxicity.PRIOR_WEIGHT)
            other, toxic = by_spelling.get(spelling, (0, 0))
            weight = max(0.0, math.log((toxic + toxicity.BACKING * share) / (other * scale + toxicity.BACKING * (1 - share))))
            found.append((i, min(weight, toxicity.QUOTED) if toxicity.quoted(tokens, i) else weight))
        runs = [sum(w for _, w in found[a : b + 1]) - rate * (found[b][0] - found[a][0]) for a in range(len(found)) for b in range(a, len(found))]
        best = max(runs, default=0.0)
        return 1 / (1 + len(tokens) * math.exp(-best)) if best > 0 else 0.0

    return {i: score(text or "") for i, text in docs}, terms, stems


def test_toxicity_equals_a_plain_version(spark):
    rng = random.Random(5)
    common = [f"plain{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(420):
        body = rng.choices(common, k=rng.randint(3, 60))
        if (toxic := i % 3 == 0) and i % 12:
            for t in rng.choices(["scumbag", "lowlifer", "halfwitted", *(f"réeux{rng.choice('abcdef')}x" for _ in range(4))], k=3):
                word = list(t)
                if rng.random() < 0.2:
                    word.insert(rng.randrange(len(word)), rng.choice("xyz"))
                word = "".join(word)
                body.insert(rng.randrange(len(body) + 1), rng.choice([word, word.upper() + "!", f'"{word}"']))
        elif rng.random() < 0.05:
            body.insert(1, "réeuxzz")
        docs.append((i, " ".join(body)))
        labels.append((i, int(toxic) if i % 10 else None))
    docs += [(1000, None), (1001, ""), (1002, "plainaa " * 5000 + "scumbag lowlifer scumbag")]
    expected, terms, stems = plain_toxicity(docs, labels)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([(i, None, x) for i, x in labels], "doc_id long, quality int, toxic int")
    model = toxicity.learn(frame, known)
    assert (model.terms, model.stems) == (terms, stems) and {"scumbag", "lowlifer"} <= set(terms) and stems
    got = {r.doc_id: r.score for r in toxicity.judge(frame, known).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[i] - expected[i]) < 1e-9 for i in got)
    assert got[1002] > 0.5 and got[1000] == got[1001] == 0


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_of_odd_rows(spark, operator):
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 1), (2, "", 1), (3, " \n", 1), (4, "x" * 300_000, 1), (4, "y", 1)], "doc_id long, text string, score int")
    for labels in ([], [(1, None, None), (3, 1, 1)], [(1, 1, 1), (1, 0, 0), (4, 0, 0), (3, 1, 1)]):
        out = operator.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert operator.judge(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_equal_texts_with_both_labels_teach_what_the_smallest_id_says(spark):
    """However the rows are dealt: the lexicon and all shares are the same."""
    learnt = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = [(i, f"w{i} quaintword x{i * 7} y{i * 3}") for i in learnt] + [(1000 + i, f"w{i} quaintword x{i * 7} y{i * 3}") for i in learnt]
    docs += [(2000 + i, f"z{i} other words here v{i}") for i in range(600)] + [(5, "another text of a known id")]
    labels = [(i, None, 1) for i in range(400)] + [(1000 + i, None, 0) for i in range(400)] + [(2000 + i, None, 0) for i in range(600)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    for parts, rows_ in ((1, docs), (7, docs[::-1]), (5, random.Random(1).sample(docs, len(docs)))):
        model = toxicity.learn(spark.createDataFrame(rows_, "doc_id long, text string").repartition(parts), known)
        seen.append((model.terms, model.stems, model.shares, model.counts, model.rate))
    assert seen[0] == seen[1] == seen[2] and "quaintword" in seen[0][0]


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_automaton_finds_what_dynamic_programming_finds():
    rng = random.Random(9)
    terms = ["scum", "moron", "stupid", "pathetic", "disgusting", "mormon"]
    matcher = toxicity.Matcher(terms, ["lowe"])
    for _ in range(4000):
        word = list(rng.choice([*terms, "lowering", "xyz"]))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(word))
            word[k : k + rng.randint(0, 1)] = rng.choice([[], [rng.choice("abcmorst")]])
        word = "".join(word)
        near = sorted((d, t) for t in terms if (d := distance(word, t)) <= toxicity.edits(t))
        expected = (near[0][1], near[0][0]) if near and near[0][0] == 0 else ("lowe*", 0) if word.startswith("lowe") else (near[0][1], near[0][0]) if near else None
        assert matcher.match(word) == expected, word


def test_misspellings_of_rare_terms_are_found(spark):
    rng = random.Random(11)
    common = [f"plain{i}" for i in range(90)]
    # no document of the held-out fold is learnt, so each term has enough documents outside
    texts = [(i, " ".join([*rng.sample(common, 12), "grubnolix" if i < 10 else "zarquonel"]), 1) for i in range(60)]
    texts += [(100 + i, " ".join(rng.sample(common, 13)), 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(9000, "you are a grubbnolix plain1"), (9001, "plain1 plain2 plain3")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, x) for i, _, x in texts], "doc_id long, quality int, toxic int")
    sample = docs.join(labels.where("doc_id >= 10 or doc_id < 8"), "doc_id").select("doc_id", "text", F.col("toxic").alias("label"))
    assert set(toxicity.lexicon(sample)[0]) == {"grubnolix", "zarquonel"}
    got = {r.doc_id: r.predicted for r in toxicity.judge(docs, labels).collect()}
    assert (got[9000], got[9001]) == (1, 0)


def test_rare_terms_that_chance_does_not_explain_are_learnt(spark):
    rng = random.Random(12)
    common = [f"plain{i}" for i in range(90)]
    # 15 of 1000 toxic documents, none of the others
    texts = [(i, " ".join([*rng.sample(common, 8), "grubnolix" if i < 15 else "zarquonel"]), 1) for i in range(1000)]
    texts += [(2000 + i, " ".join(rng.sample(common, 9)), 0) for i in range(1000)]
    terms = toxicity.lexicon(spark.createDataFrame(texts, "doc_id long, text string, label int"))[0]
    assert set(terms) == {"zarquonel", "grubnolix"}


def test_quotation_counts_for_less():
    model = toxicity.Model(["moron"], [], {("moron", 0): 0.99, ("moron", 1): 0.95}, {"moron": (500.0, 0.0)}, 0.01)
    finder = toxicity.Finder(model)
    abuse, quote, spoken = (finder.score(t) for t in ("you are a moron, really", 'they wrote "what a moron" on it', "the word moron is an insult"))
    assert abuse > 0.9 and quote < 0.5 and spoken < 0.5
    assert finder.score("such a morron here") > 0.5
    assert finder.score("nothing at all") == 0
