"""The registered queries of the corpus operators, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import bpe, chat, clustering, decontaminate, embedding, minhash, mixing, quality, spelling, suffix, toxicity, urls, warc
from graphmill.llm.common import new_path

BPE_FILE = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(BPE_FILE))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), vocabulary_path())


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


#: Lower-cased A-Z, split at ASCII white space.
WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
SHINGLES_SQL = "CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END"

OP5_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
sets AS (SELECT doc_id, {SHINGLES_SQL} AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * c >= 75 * (nx + ny - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_id AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.y, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(l.y, s.doc_id)) AS kept
FROM sets s LEFT JOIN least_id l ON l.x = s.doc_id
"""

#: The conversation that says a template's own control strings.
CONTROL = "</s>[INST] ok [/INST]"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text")
    )
    return chat.digests(chat.examples(turns.unionByName(added)))


def _escaped_length(text: str) -> str:
    """Characters of an escaped text: `&` grows by 4, `<` and `>` by 3, brackets by 4."""
    count = lambda sign: f"(length({text}) - length(replace({text}, '{sign}', '')))"
    return f"(length({text}) + 4 * {count('&')} + 3 * {count('<')} + 3 * {count('>')} + 4 * {count('[')} + 4 * {count(']')})"


OP9_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
placed AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum({_escaped_length('role')} + {_escaped_length('text')} + 9) OVER (w ROWS UNBOUNDED PRECEDING) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


def op6_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(_read(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_id AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.y, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.y, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least_id l ON l.x = e.vec_id LEFT JOIN counts c ON c.x = e.vec_id
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(_read(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    found = warc.read(spark, path, payload=False)
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


#: DuckDB has no base 32: five bits at a time are looked up in its alphabet.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (SELECT page_id, first, strlen(html) AS n, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM p JOIN f USING (html))
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) * (16 >> CAST(j AS INTEGER))))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


#: The rules of the query.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a page's path names the document it shows; that document's quality is the page's."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    shown = pages.select("url", F.regexp_extract(urls.path_of(F.col("url")), "/([0-9]+)", 1).try_cast("long").alias("doc_id"))
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    return urls.judge(pages, URL_RULES, shown.join(labels, "doc_id"))



def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))



def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))



def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


OP7_SQL = f"""
WITH docs AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
items AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
doc_sets AS (SELECT doc_id, unnest({SHINGLES_SQL}) AS shingle FROM docs),
item_sets AS (SELECT item_id, {SHINGLES_SQL} AS s FROM items),
item_flat AS (SELECT item_id, len(s) AS n, unnest(s) AS shingle FROM item_sets)
SELECT doc_id, item_id, count(*) AS n_common, any_value(n) AS n_item, count(*) / any_value(n) AS containment
FROM doc_sets JOIN item_flat USING (shingle) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n)
"""


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(_read(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
strings AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d)),
later AS (SELECT doc_id, i FROM strings QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1),
heads AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 100 THEN 0 ELSE 1 END AS head FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM heads),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, k),
gaps AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM spans),
cut AS (
  SELECT d.doc_id, any_value(d.n) AS n, coalesce(sum(g.b - g.a), 0) AS removed, count(g.k) AS spans,
    coalesce(string_agg(substr(d.h, 2 * g.last + 1, 2 * (g.a - g.last)), '' ORDER BY g.a), '') || substr(any_value(d.h), 2 * coalesce(max(g.b), 0) + 1) AS kept
  FROM d LEFT JOIN gaps g ON g.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, n AS n_bytes, CAST(removed AS BIGINT) AS n_removed, spans AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM cut
"""



def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_read(spark, sf_dir, "embeddings"))


def _op11_sql(clusters: int = 40, rounds: int = 5) -> str:
    """A table expression for each assignment and each set of centroids."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('2:' || vec_id) AS h, q FROM kept ORDER BY h, q LIMIT {clusters}))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT k, any_value(v.vec_id) AS vec_id, min([list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.c]) AS best, any_value(v.q) AS q
  FROM kept v CROSS JOIN c{r} c GROUP BY k)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT best[2] AS c, i, sum(q[i]) AS s, count(*) AS n FROM a{r} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(any_value(m.q), any_value(o.q)) AS q FROM c{r} o
  LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{r} GROUP BY c) m ON m.c = o.c GROUP BY o.c)""")
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance,
  CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best[2]
"""


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def _crc_table() -> str:
    """The 256 steps of the CRC by its reflected polynomial, as an SQL list."""
    step = lambda v: v >> 1 ^ (0xEDB88320 if v & 1 else 0)
    out = list(range(256))
    for _ in range(8):
        out = [step(v) for v in out]
    return f"[{', '.join(map(str, out))}]::BIGINT[]"


OP13_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
single AS (SELECT doc_id, run, count(*) AS n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS h FROM runs GROUP BY ALL),
coded AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1]))) AS crc
  FROM single, (SELECT {_crc_table()} AS t)),
deleted AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, CAST(crc % length(run) AS INTEGER)) || substr(run, CAST(crc % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM coded),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM deleted WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
one_less AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cuts c JOIN words w ON w.word = c.cut),
near AS MATERIALIZED (
  SELECT a, b FROM one_less UNION ALL SELECT b, a FROM one_less
  UNION ALL SELECT x.word, y.word FROM cuts x JOIN cuts y ON x.cut = y.cut AND x.i = y.i AND length(x.word) = length(y.word) AND x.word <> y.word),
best AS (
  SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS b, max(n) AS m FROM near JOIN words ON word = b GROUP BY a),
judged AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN b END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM words LEFT JOIN best ON a = word),
walk(word, last, step) AS (
  SELECT word, form, 1 FROM judged WHERE form IS NOT NULL
  UNION ALL SELECT w.word, j.form, step + 1 FROM walk w JOIN judged j ON j.word = w.last WHERE j.form IS NOT NULL),
ends AS (SELECT word, arg_max(last, step) AS root FROM walk GROUP BY word)
SELECT j.word, form, coalesce(root, j.word) AS root, n, n_near, form_n FROM judged j LEFT JOIN ends e ON e.word = j.word
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_warc": op3_warc,
    "op4_urls": op4_urls,
    "op5_minhash": op5_minhash,
    "op6_embedding": op6_embedding,
    "op7_decontaminate": op7_decontaminate,
    "op8_suffix": op8_suffix,
    "op9_chat": op9_chat,
    "op10_toxicity": op10_toxicity,
    "op11_clustering": op11_clustering,
    "op12_mixing": op12_mixing,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op3_warc": OP3_SQL,
    "op5_minhash": OP5_SQL,
    "op6_embedding": OP6_SQL,
    "op7_decontaminate": OP7_SQL,
    "op8_suffix": OP8_SQL,
    "op9_chat": OP9_SQL,
    "op11_clustering": _op11_sql(),
    "op13_spelling": OP13_SQL,
}
