"""Registered queries of the llm operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import contamination, html_text, lines, lm, mixing, near_vectors, phrases, quality, runs, simhash, tokens, toxicity, url_filter
from millrace.llm.frames import table

Query = Callable[[SparkSession, str], DataFrame]


def vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), min_cosine=0.93)
    return found.select("vec_id", "n_links", "component_id", "kept")


VECTOR_GROUPS_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.93
),
reach AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings
  UNION
  SELECT link.b, reach.root FROM reach JOIN link ON reach.id = link.a WHERE reach.root < link.b
),
component AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, c.root AS component_id, e.vec_id = c.root AS kept
FROM embeddings e LEFT JOIN degree d ON e.vec_id = d.id LEFT JOIN component c ON e.vec_id = c.id
"""


def near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_docs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "score", "posterior", "keep")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2
    )


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, limit=2.0)


def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.drop_shared_lines(docs, min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SHARED_LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
),
k AS (
  SELECT doc_id, pos, line, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, count(*) AS n_lines,
  count(*) FILTER (WHERE s.key IS NOT NULL AND k.doc_id < s.keeper) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
    FILTER (WHERE s.key IS NULL OR k.doc_id >= s.keeper), '')) AS kept_sha256
FROM k LEFT JOIN shared s ON k.key = s.key
GROUP BY k.doc_id
"""


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.find_items(docs, table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        contamination.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


BENCHMARK_HITS_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
),
item_windows AS (
  SELECT DISTINCT id AS item_id, n, array_to_string(a[p:p + n - 1], ' ') AS words
  FROM (SELECT id, a, n, unnest(range(1, len(a) - n + 2)) AS p
        FROM (SELECT id, a, least(10, len(a)) AS n FROM w WHERE side = 'i' AND len(a) > 0))
),
doc_windows AS (
  SELECT id AS doc_id, n, p, array_to_string(a[p:p + n - 1], ' ') AS words
  FROM (SELECT id, a, n, unnest(range(1, len(a) - n + 2)) AS p
        FROM w, (SELECT DISTINCT n FROM item_windows) WHERE side = 'd' AND len(a) >= n)
),
hits AS (SELECT d.doc_id, d.p, d.n, i.item_id FROM doc_windows d JOIN item_windows i USING (n, words)),
hit_words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id
)
SELECT w.id AS doc_id, CAST(len(w.a) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit_words h ON w.id = h.doc_id LEFT JOIN hit_items i ON w.id = i.doc_id
WHERE w.side = 'd'
"""

def language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    scored = lm.score(docs, ~held_out, public_tokenizers.path("byte_bpe_50k.json"))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


TOXIC_SCORE = 0.3


def toxic_held_out(id_col: str) -> F.Column:
    """Rows that toxicity must not learn from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def toxic_voter(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Voter:
    labels = table(spark, sf_dir, "labels")
    return toxicity.fit(docs, toxicity.labelled_rows(labels, held_out=toxic_held_out("id")))


def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxic_voter(spark, sf_dir, docs))
    return scored.select(
        "doc_id",
        toxic_held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"),
        "evidence",
    )


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", "n_chars")


def phrase_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return phrases.collocations(docs, max_words=5, min_count=100, share=100, limit=2000)


PHRASE_RANKS_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM piece GROUP BY lang),
f AS (
  SELECT lang, phrase, m, count(*)::HUGEINT AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM piece, range(1, 6) AS sizes(m) WHERE len(w) >= m)
  GROUP BY ALL HAVING count(*) >= 100
),
cand AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
cut AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, t.n, 1000 * c.a * t.n // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')
  JOIN total t ON t.lang = c.lang
),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT lang, a, array_to_string(w[i:j], ' ') AS phrase
  FROM (SELECT *, unnest(range(i + 1, m + 1)) AS j FROM (SELECT *, unnest(range(1, m)) AS i FROM cand)) WHERE j - i + 1 < m
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = low.lang AND i.phrase = low.phrase AND 100 * i.a >= 100 * low.a)
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


URL_VERDICTS_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
),
rules(rule, host, path, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
),
fit AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.rule, length(r.rule)) AS rule,
    arg_max(r.verdict, length(r.rule)) AS verdict
  FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit
"""

def planted_runs(docs: DataFrame) -> DataFrame:
    """Documents, a tenth of which (by the CRC of their id) repeat from some word on.
    Rows without an id stay as they are."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(crc / 10)
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    chosen = docs.select("doc_id", "text", g.alias("g"), F.when(crc % 10 == 0, words).alias("words"))
    n = F.size("words")
    placed = chosen.filter(n > 0).select(
        "doc_id", "words", n.alias("n"), (F.col("g") % n).cast("int").alias("a"), (F.col("g") % 8 + 3).alias("parts")
    )
    left = F.col("n") - F.col("a")
    period = (F.floor(left / F.col("parts")) + 1).cast("int")
    block = F.slice("words", F.col("a") + 1, period)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(left / period).cast("int"))), F.lit(1), left)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    others = chosen.filter(F.coalesce(n <= 0, F.lit(True))).select("doc_id", "text")
    return others.unionByName(placed.select("doc_id", text.alias("text")))


def run_report(docs: DataFrame) -> DataFrame:
    found = runs.periodic_runs(planted_runs(docs), min_length=6, min_exponent=4)
    best = found.withColumn("best", runs.strongest("runs"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(runs.runs_text("runs"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def periodic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


PERIODIC_WORDS_SQL = r"""
WITH w0 AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)),
        lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT) AS h
  FROM documents
),
w1 AS (
  SELECT doc_id, o, len(o) AS n, h // 10 AS g, h % 10 = 0 AND len(o) > 0 AS planted,
    CASE WHEN len(o) > 0 THEN (h // 10) % len(o) ELSE 0 END AS a FROM w0
),
w2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w1),
w AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_concat(o[1:a], list_transform(range(a, n), lambda i: o[1 + a + (i - a) % p])) ELSE o END AS words FROM w2
),
gram AS (
  SELECT doc_id, i, n, hash(words[i + 1:i + 5]) AS gram
  FROM (SELECT doc_id, n, words, unnest(range(n - 4)) AS i FROM w WHERE n >= 6)
),
pair AS (
  SELECT a.doc_id, a.i, b.i - a.i AS q FROM gram a JOIN gram b USING (doc_id, gram)
  WHERE b.i > a.i AND 4 * (b.i - a.i) <= a.n
),
island AS (
  SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 5 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair) GROUP BY doc_id, q, k
),
long AS (SELECT * FROM island WHERE length >= greatest(6, 4 * q)),
run AS (
  SELECT * FROM long l WHERE NOT EXISTS (
    SELECT 1 FROM long s WHERE s.doc_id = l.doc_id AND s.q < l.q AND s.start <= l.start AND s.start + s.length >= l.start + l.length)
),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM run),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM w) ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id
),
report AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM run GROUP BY doc_id
),
best AS (
  SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / q DESC, start, q) = 1
)
SELECT w.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period,
  (1000 * length // q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM w LEFT JOIN report USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES: dict[str, Query] = {
    "op1_vector_groups": vector_groups,
    "op2_near_texts": near_texts,
    "op3_quality_scores": quality_scores,
    "op4_token_files": token_files,
    "op5_source_mix": source_mix,
    "op6_shared_lines": shared_lines,
    "op7_language_scores": language_scores,
    "op8_toxic_scores": toxic_scores,
    "op9_benchmark_hits": benchmark_hits,
    "op10_page_texts": page_texts,
    "op11_phrase_ranks": phrase_ranks,
    "op12_url_verdicts": url_verdicts,
    "op13_periodic_words": periodic_words,
}
ORACLES: dict[str, str] = {
    "op1_vector_groups": VECTOR_GROUPS_SQL,
    "op6_shared_lines": SHARED_LINES_SQL,
    "op9_benchmark_hits": BENCHMARK_HITS_SQL,
    "op11_phrase_ranks": PHRASE_RANKS_SQL,
    "op12_url_verdicts": URL_VERDICTS_SQL,
    "op13_periodic_words": PERIODIC_WORDS_SQL,
}
