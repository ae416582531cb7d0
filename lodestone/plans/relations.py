"""The platform's relations over the benchmark tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk, keyword
from ..session import table

# Synthetic folders, file names and extensions dealt out by id.
FOLDERS = ("ops/runbooks", "ops/incidents", "docs", "kubernetes/core", "helm", "k8s", "Compose", "src/app", "topology", "puppet", "data/cmdb", "notes")
NAMES = ("readme.md", "main.tf", "eks.tf.json", "values.yaml", "Dockerfile", "adr-001.md", "INC-42.md", "inc-42.md", "app.py", "site.pp", "list.csv", "index.ts", ".profile", "data.json", "Puppetfile", "report.PDF", "x.conf", "run.sh", "archive.zip", "trail.")
HINTS = ("shop/runbooks", "corp\\Terraform", "", "misc", "x/compose/y", "documentation")


def _pick(values: tuple[str, ...], n) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    attached = d % 10 == 9
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", "source", F.concat(F.lit("doc-"), d.cast("string")).alias("title"),
        F.when(attached, "attachment").otherwise("corpus").alias("source_type"), F.when(attached, d % 17).alias("conversation_id"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic paths and hints of the documents, with their size."""
    d = F.col("doc_id")
    name, folder = _pick(NAMES, d), _pick(FOLDERS, F.floor(d / 7))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(folder, F.lit("/"), name).alias("path"), name.alias("name"), _pick(HINTS, F.floor(d / 3)).alias("hint"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size_bytes"))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.line_chunks(table(spark, sf_dir, "documents"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, question, terms``: every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), keyword.query_terms(F.col("text")).alias("terms"))


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that have a vector: the embedding of the item's number."""
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return questions(spark, sf_dir).join(emb, "query_id")


def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector, without their text."""
    emb = table(spark, sf_dir, "embeddings")
    docs = documents(spark, sf_dir).select("doc_id", "source_type", "conversation_id")
    return emb.join(docs, emb.vec_id == docs.doc_id).select("doc_id", "embedding", "label", "source_type", "conversation_id")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, named by default but for those that a system turn opens."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated_at"), F.min_by("role", "turn").alias("opens"))
    return c.select("conv_id", F.when(F.col("opens") == "system", "Guided chat").otherwise("New Chat").alias("title"), "updated_at")


DOCS = "docs AS (SELECT doc_id, text, source, 'doc-' || doc_id AS title, CASE WHEN doc_id % 10 = 9 THEN 'attachment' ELSE 'corpus' END AS source_type, CASE WHEN doc_id % 10 = 9 THEN doc_id % 17 END AS conversation_id FROM documents)"
FILES = f"files AS (SELECT doc_id, f || '/' || n AS path, n AS name, h AS hint, size_bytes FROM (SELECT doc_id, {sql_list(FOLDERS)}[(doc_id // 7) % {len(FOLDERS)} + 1] AS f, {sql_list(NAMES)}[doc_id % {len(NAMES)} + 1] AS n, {sql_list(HINTS)}[(doc_id // 3) % {len(HINTS)} + 1] AS h, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents))"
LINES = "lines AS (SELECT doc_id, i - 1 AS chunk_index, len(l) AS total, l[i] AS content FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents)))"
TERMS = "terms AS (SELECT DISTINCT item_id AS query_id, lower(t) AS term FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS t FROM benchmark) WHERE length(t) >= 2)"
TOKENS = "toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), tok AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM toks)"
KEYWORD = "kw AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE) / ln(any_value(n) + 1.0::DOUBLE), 12) AS score FROM tok JOIN terms USING (term) GROUP BY query_id, doc_id), kwr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kw)"
VECTORS = "vq AS (SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS q, label FROM benchmark JOIN embeddings ON item_id = vec_id), ed AS (SELECT doc_id, CAST(embedding AS DOUBLE[]) AS e, label, source_type, conversation_id FROM embeddings JOIN docs ON vec_id = doc_id), vd AS (SELECT query_id, doc_id, round(list_cosine_distance(e, q), 12) + 0.0 AS distance FROM vq, ed), vdr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM vd)"
POOL = "both_ AS (SELECT query_id, doc_id, 0 AS o, rank AS r, 'vector' AS origin FROM vdr WHERE rank <= 25 UNION ALL SELECT query_id, doc_id, 1, rank, 'keyword' FROM kwr WHERE rank <= 75 AND query_id IN (SELECT query_id FROM vq)), first_ AS (SELECT query_id, doc_id, min(o * 1000 + r) AS place, arg_min(origin, o * 1000 + r) AS origin FROM both_ GROUP BY query_id, doc_id), pool AS (SELECT query_id, doc_id, origin, row_number() OVER (PARTITION BY query_id ORDER BY place) AS pool_pos FROM first_)"
RERANK = "nt AS (SELECT query_id, count(*) AS n FROM terms GROUP BY query_id), sc AS (SELECT p.query_id, p.doc_id, p.pool_pos, round(count(h.term) / any_value(nt.n)::DOUBLE, 6) AS score FROM pool p JOIN nt USING (query_id) JOIN terms t USING (query_id) LEFT JOIN (SELECT DISTINCT doc_id, term FROM tok) h ON h.doc_id = p.doc_id AND h.term = t.term GROUP BY ALL), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool_pos) AS relevance_rank FROM sc) WHERE relevance_rank <= 5), reranked AS (SELECT query_id, doc_id, score, relevance_rank, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS reading_rank FROM top)"
HYBRID = ", ".join([DOCS, TERMS, TOKENS, KEYWORD, VECTORS, POOL])
MESSAGES = "messages AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant'))"
CONVS = "convs AS (SELECT conv_id, max(turn) AS updated_at, CASE WHEN arg_min(role, turn) = 'system' THEN 'Guided chat' ELSE 'New Chat' END AS title FROM conversations GROUP BY conv_id)"
ATTACHED = "att AS (SELECT conversation_id, doc_id, CASE WHEN strlen(text) <= 20480 THEN 'inline' ELSE 'chunked' END AS mode, CAST(strlen(text) AS BIGINT) AS size_bytes FROM docs WHERE source_type = 'attachment')"
