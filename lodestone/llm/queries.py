"""One query per operator, over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, decontaminate, langid, line_dedup, ngram_join, quality, secret_scan, sharding
from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.links(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), vocabulary())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.report(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_quality, op3_ngram_join, op4_secret_scan, op5_bpe, op6_language_id, op7_sharding, op8_line_dedup, op9_chat_format, op10_nearest)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op1_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS p
        FROM (SELECT item_id, w, least(len(w), 13) AS k, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM pat),
win AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS p
        FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT r, i, win.k, item_id FROM win JOIN pat ON win.k = pat.k AND win.p = pat.p),
words AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS x FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op4_secret_scan": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
rules AS (SELECT * FROM (VALUES
  (0, 'assign', '((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+)'),
  (1, 'access', '(AKIA[A-Z0-9]+)'), (2, 'hex', '([0-9a-f]+)')) AS x(o, kind, pat)),
cut AS (SELECT r, o, kind, string_split(CASE o
  WHEN 0 THEN regexp_replace(t, '((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+)', chr(57345) || '\1' || chr(57346), 'g')
  WHEN 1 THEN regexp_replace(t, '(AKIA[A-Z0-9]+)', chr(57345) || '\1' || chr(57346), 'g')
  ELSE regexp_replace(t, '([0-9a-f]+)', chr(57345) || '\1' || chr(57346), 'g') END, chr(57345)) AS parts FROM d, rules),
piece AS (SELECT r, o, kind, unnest(parts) AS s, unnest(generate_series(1, len(parts))) AS i FROM cut),
span AS (SELECT r, o, kind, i, string_split(s, chr(57346))[1] AS m,
         sum(length(replace(s, chr(57346), ''))) OVER (PARTITION BY r, o ORDER BY i) - length(replace(s, chr(57346), '')) AS a FROM piece),
kept AS (SELECT r, o, kind, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS e FROM span
  WHERE i > 1 AND CASE o
    WHEN 0 THEN length(regexp_extract(m, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8
    WHEN 1 THEN length(m) >= 16 ELSE length(m) >= 32 END),
g AS (SELECT r, count(*) FILTER (o = 0) AS n0, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2,
      string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, o) AS spans FROM kept GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)""",
    "op8_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i FROM d),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM x),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last IS NOT NULL AND doc_id < last) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR doc_id >= last), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY r, doc_id""",
    "op9_chat_format": """
WITH t AS (SELECT conv_id, role, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS c,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no FROM conversations)
SELECT conv_id, turn_no, role, CAST(length(c) AS BIGINT) AS n_chars,
       sha256('<|im_start|>' || role || chr(10) || c || '<|im_end|>' || chr(10)) AS rendered_sha256 FROM t""",
    "op10_nearest": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.s * c.s) AS score
      FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id WHERE q.s > 0 AND c.s > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM o WHERE rank <= 5""",
}
