"""Registered queries of the corpus operators, with DuckDB SQL where SQL can state them."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_stream, byte_transducer, crf_quality, embed_dedup, host_rules, hyperminhash, license_scan, norm_search, packing, perspective,
               phrase_mining, token_attribution, window_dedup)
from .common import table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document, boundary tokens to the line with most of their bytes."""
    return token_attribution.attribute_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE),
                                              spans=token_attribution.line_sections, rule="majority")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op6_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf_quality.score(docs, crf_quality.train(docs, table(spark, sf_dir, "labels")))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_quality(table(spark, sf_dir, "documents"))


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspective.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return out.withColumn("mask", spans)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(docs))


def op10_window_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_byte_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_transducer.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine_phrases(table(spark, sf_dir, "documents"))


def op13_norm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_embedding_dedup, op2_token_attribution, op3_packing, op4_bpe_roundtrip, op5_hyperminhash_dedup, op6_crf_quality,
    op7_host_rules, op8_perspective_rotation, op9_license_scan, op10_window_line_dedup,
    op11_byte_transducer, op12_phrase_mining, op13_norm_search, pipeline)}

_WS = r"[\x20\x09-\x0D]+"

ORACLE = {
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v WHERE vec_id IS NOT NULL
  UNION
  SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN comp c USING (vec_id) LEFT JOIN deg d USING (vec_id)
""",
    "op5_hyperminhash_dedup": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
pairs AS (
  SELECT c.a, c.b FROM common c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE 100 * c.c >= 80 * (x.n + y.n - c.c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN comp c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op7_host_rules": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (
  SELECT r, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, unnest(list_transform(range(1, greatest(len(ws) - 1, 1)),
    lambda i: array_to_string(ws[i:i + 2], ' '))) AS g FROM t),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
base AS (
  SELECT t.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN rep USING (r)),
f AS (
  SELECT *, n_words < {host_rules.MIN_WORDS} OR 100 * n_repeat_words > {host_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
h AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) AS k FROM f
  WHERE source IS NOT NULL GROUP BY source),
m AS (
  SELECT sum(n) AS tn, sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) AS q, count(*) AS th FROM h),
v AS (SELECT tn, m, q - m * m - m * (1 - m) * th / tn AS v FROM m),
p AS (SELECT m, CASE WHEN v > 1e-12 THEN least(greatest(m * (1 - m) / v - 1, 1.0), tn) ELSE tn END AS s FROM v),
bad AS (SELECT source FROM h, p WHERE (k + m * s) / (n + s) >= {host_rules.HOST_REJECT_RATE})
SELECT doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM f
""",
    "op8_perspective_rotation": f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, CASE WHEN role IS NULL OR trim(role) = '' THEN '{perspective.UNKNOWN}' ELSE role END AS role,
    replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS assistant FROM t WHERE role <> 'system'),
x AS (
  SELECT t.conv_id, p.assistant, coalesce(CAST(floor(t.turn / {perspective.PART_TURNS}.0) AS BIGINT), -1) AS part, t.turn, t.role, body, t.role = p.assistant AS own,
    (CASE WHEN t.role = 'system' THEN '<|system|>' WHEN t.role = p.assistant THEN '<|assistant|>'
      ELSE '<|user name=' || t.role || '|>' END) || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, assistant, part ORDER BY turn NULLS FIRST, role, body
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM x)
SELECT conv_id, assistant, part, CAST(0 AS INTEGER) AS sub, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
  string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, body) AS text,
  coalesce(string_agg(CAST(a AS BIGINT) || '-' || CAST(a + length(body) AS BIGINT), ',' ORDER BY turn NULLS FIRST, role, body) FILTER (WHERE own), '') AS mask,
  CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS mask_chars
FROM y GROUP BY conv_id, assistant, part
""",
    "op10_window_line_dedup": """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM l),
w AS (
  SELECT doc_id, text, i AS p0, lead(i) OVER o AS p1, lead(i, 2) OVER o AS p2,
    x || chr(10) || lead(x) OVER o || chr(10) || lead(x, 2) OVER o AS g
  FROM k WHERE x <> '' WINDOW o AS (PARTITION BY doc_id, text ORDER BY i)),
z AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, p0) AS o FROM w WHERE g IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, text, unnest([p0, p1, p2]) AS i FROM z WHERE o > 1),
kept AS (
  SELECT k.doc_id, k.text, string_agg(line, chr(10) ORDER BY k.i) FILTER (WHERE gone.i IS NULL) AS cleaned, count(*) AS n, count(gone.i) AS r
  FROM k LEFT JOIN gone ON k.doc_id IS NOT DISTINCT FROM gone.doc_id AND k.text = gone.text AND k.i = gone.i GROUP BY 1, 2)
SELECT a.doc_id, CASE WHEN a.text IS NULL THEN NULL ELSE coalesce(kept.cleaned, '') END AS text, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(kept.r, 0) AS BIGINT) AS n_removed
FROM documents a LEFT JOIN kept ON a.doc_id IS NOT DISTINCT FROM kept.doc_id AND a.text = kept.text
""",
    "op12_phrase_mining": f"""
WITH p AS (
  SELECT row_number() OVER () AS piece, lang, ws FROM (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS ws FROM documents)),
w AS (
  SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p)),
f1 AS (SELECT lang, w1, count(*) AS f FROM w GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM w WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {phrase_mining.MIN_COUNT}),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM w WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {phrase_mining.MIN_COUNT}),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f2 y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
  FROM f3 t JOIN f2 x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2, t.f, 1, x.f, y.f
  FROM f2 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 z WHERE z.lang = t.lang AND 100 * z.f >= 50 * t.f AND (z.w1 = t.w1 AND z.w2 = t.w2 OR z.w2 = t.w1 AND z.w3 = t.w2))),
s AS (SELECT *, CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS score FROM cuts),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT o.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN n USING (lang) WHERE rank <= {phrase_mining.TOP}
""",
    "op13_norm_search": f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
dl AS (SELECT row, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS nl FROM dl),
q AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM (
    SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))),
t AS (SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c),
s AS (
  SELECT i, item_id, doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // nl)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN dl USING (row), c GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {norm_search.TOP}
""",
}
