"""Every operator as a query over the benchmark tables, and SQL that must agree with it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as cl
from ..functions import headers, jsonparts
from ..functions import tables as t
from ..functions import structure
from ..operators import chat, chunk, context, evaluate, keyword, lookup, models, retrieve, sync, vector
from ..session import materialise, shared_dir, table
from ..sources import connector
from ..sources import files as src
from ..streaming import sync_stream as stream
from . import answer, ingest
from . import relations as r
from . import samples

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# -- vectors and keywords


@query(f"WITH {r.DOCS}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) SELECT doc_id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), q), 6) + 0.0 AS distance FROM embeddings JOIN docs ON vec_id = doc_id AND source_type = 'corpus', q ORDER BY round(list_cosine_distance(CAST(embedding AS DOUBLE[]), q), 12), doc_id LIMIT 25")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "embeddings").where("vec_id = 0")
    return vector.topk_one(r.embedded_documents(spark, d).where("source_type = 'corpus'"), one, 25, key="doc_id")


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_distance(c.e, q.e), 12) + 0.0 AS distance FROM v q JOIN v c ON q.vec_id % 20 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(distance, 6) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 25")
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    return vector.topk_batch(emb, emb.where("vec_id % 20 = 0"), 25).select("query_id", F.col("key").alias("vec_id"), "distance", "rank")


@query("SELECT DISTINCT conv_id, turn, lower(t) AS term FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS t FROM conversations WHERE role = 'user') WHERE length(t) >= 2")
def keyword_terms(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", F.explode(keyword.query_terms(F.col("text"))).alias("term"))


@query(f"WITH {r.TERMS}, {r.TOKENS}, {r.KEYWORD} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM kwr WHERE rank <= 75")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return keyword.ranked(docs, r.questions(spark, d), 75, {"text": 1.0})


@query(f"WITH {r.DOCS}, {r.TERMS}, {r.TOKENS}, kw AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE) / ln(any_value(n) + 1.0::DOUBLE), 12) AS score FROM tok JOIN terms USING (term) JOIN docs USING (doc_id) WHERE source_type = 'corpus' OR conversation_id = query_id % 17 GROUP BY query_id, doc_id), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kw) SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 75")
def keyword_topk_scoped(spark: SparkSession, d: str) -> DataFrame:
    docs = r.documents(spark, d).select("doc_id", "text", F.col("source_type").alias("scope_type"), F.col("conversation_id").alias("scope_conv"))
    asked = r.questions(spark, d).withColumn("q_conv", F.col("query_id") % 17)
    return keyword.ranked(docs, asked, 75, {"text": 1.0})


@query(f"WITH {r.DOCS}, {r.TERMS}, f AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS a, regexp_extract_all(lower(source), '[a-z0-9]+') AS b, regexp_extract_all(lower(title), '[a-z0-9]+') AS c FROM docs), tk AS (SELECT doc_id, len(a) + len(b) + len(c) AS n, unnest(a) AS term, 1.0::DOUBLE AS w FROM f UNION ALL SELECT doc_id, len(a) + len(b) + len(c), unnest(b), 0.4::DOUBLE FROM f UNION ALL SELECT doc_id, len(a) + len(b) + len(c), unnest(c), 0.2::DOUBLE FROM f), kw AS (SELECT query_id, doc_id, round(sum(w) / ln(any_value(n) + 1.0::DOUBLE), 12) AS score FROM tk JOIN terms USING (term) GROUP BY query_id, doc_id), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kw) SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 75")
def keyword_weighted(spark: SparkSession, d: str) -> DataFrame:
    w = keyword.WEIGHTS
    docs = r.documents(spark, d).select("doc_id", "text", "source", "title")
    return keyword.ranked(docs, r.questions(spark, d), 75, {"text": w["content"], "source": w["section"], "title": w["title"]})


@query()
def keyword_english(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(keyword.english_tokens(F.col("text"))).alias("terms"))
    return keyword.ranked(table(spark, d, "documents").select("doc_id", "text"), asked, 75, {"text": 1.0}, analyser=keyword.stemming)


@query(f"WITH {r.TOKENS} SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS weight, any_value(n) AS n FROM tok GROUP BY doc_id, term")
def keyword_postings(spark: SparkSession, d: str) -> DataFrame:
    return keyword.postings(table(spark, d, "documents"), {"text": 1.0}).withColumn("n", F.col("n").cast("bigint"))


# -- hybrid


def _lists(spark: SparkSession, d: str, n_vector: int = 25, n_keyword: int = 75) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = r.vector_questions(spark, d)
    near = vector.topk_batch(r.embedded_documents(spark, d), asked, n_vector, key="doc_id", query_key="query_id").withColumnRenamed("key", "doc_id")
    words = keyword.ranked(table(spark, d, "documents").select("doc_id", "text"), asked.select("query_id", "terms"), n_keyword, {"text": 1.0})
    return asked, near, words


@query(f"WITH {r.HYBRID} SELECT query_id, doc_id, origin, CAST(pool_pos AS INTEGER) AS pool_pos FROM pool")
def hybrid_pool(spark: SparkSession, d: str) -> DataFrame:
    _, near, words = _lists(spark, d)
    return retrieve.pool(near, words)


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    asked, near, words = _lists(spark, d)
    candidates = materialise(retrieve.pool(near, words), "pool")  # retrieval runs once for all that read it
    return retrieve.rerank(candidates, retrieve.lexical_scores(candidates, asked, table(spark, d, "documents")), 5)


@query(f"WITH {r.HYBRID}, {r.RERANK} SELECT query_id, doc_id, score, CAST(relevance_rank AS INTEGER) AS relevance_rank, CAST(reading_rank AS INTEGER) AS reading_rank FROM reranked")
def hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d)


@query(f"WITH {r.LINES}, h AS (SELECT doc_id, arg_max(chunk_index, length(content) * 1000000 - chunk_index) AS hit FROM lines GROUP BY doc_id) SELECT lines.doc_id AS document, CAST(chunk_index AS INTEGER) AS chunk_index, chunk_index = hit AS is_hit FROM lines JOIN h ON lines.doc_id = h.doc_id AND chunk_index BETWEEN greatest(0, hit - 2) AND hit + 2")
def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    lines = r.line_chunks(spark, d).withColumnRenamed("doc_id", "document")
    longest = F.max_by("chunk_index", F.struct(F.length("content"), -F.col("chunk_index"))).alias("chunk_index")
    return retrieve.neighbours(lines.groupBy("document").agg(longest), lines, 2)


@query(f"WITH {r.HYBRID}, e AS (SELECT query_id, doc_id FROM vq JOIN ed USING (label)), v AS (SELECT query_id, min(rank) AS f FROM vdr JOIN e USING (query_id, doc_id) WHERE rank <= 50 GROUP BY query_id), k AS (SELECT query_id, min(rank) AS f FROM kwr JOIN e USING (query_id, doc_id) WHERE rank <= 50 GROUP BY query_id) SELECT query_id, 'vector' AS retriever, coalesce(CAST(v.f AS INTEGER), 0) AS first_rank FROM vq LEFT JOIN v USING (query_id) UNION ALL SELECT query_id, 'keyword', coalesce(CAST(k.f AS INTEGER), 0) FROM vq LEFT JOIN k USING (query_id)")
def diagnostic_rank(spark: SparkSession, d: str) -> DataFrame:
    asked, near, words = _lists(spark, d, 50, 50)
    expected = _expected(spark, d)
    one = lambda df, name: retrieve.first_ranks(df, expected, asked).select("query_id", F.lit(name).alias("retriever"), F.coalesce("first_rank", F.lit(0)).alias("first_rank"))
    return one(near, "vector").unionByName(one(words, "keyword"))


def _expected(spark: SparkSession, d: str) -> DataFrame:
    """The relevant documents of a question: those of its own class."""
    docs = r.embedded_documents(spark, d).select("doc_id", "label")
    return r.vector_questions(spark, d).select("query_id", "label").join(docs, "label").select("query_id", "doc_id")


@query(f"WITH {r.DOCS}, c AS (SELECT DISTINCT conv_id FROM conversations), n AS (SELECT conversation_id, count(*) AS n FROM docs WHERE source_type = 'attachment' GROUP BY conversation_id) SELECT conv_id, coalesce(n, 0) AS n_attachments, (SELECT count(*) FROM docs WHERE source_type = 'corpus') + coalesce(n, 0) AS n_visible FROM c LEFT JOIN n ON conversation_id = conv_id")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = r.documents(spark, d).drop("text")
    corpus = docs.where("source_type = 'corpus'").agg(F.count("*").alias("corpus"))
    own = docs.where("source_type = 'attachment'").groupBy("conversation_id").agg(F.count("*").alias("n"))
    convs = r.conversations(spark, d).select("conv_id")
    n = F.coalesce("n", F.lit(0))
    return convs.join(own, convs.conv_id == own.conversation_id, "left").crossJoin(F.broadcast(corpus)).select("conv_id", n.alias("n_attachments"), (F.col("corpus") + n).alias("n_visible"))


@query()
def answer_questions(spark: SparkSession, d: str) -> DataFrame:
    """The whole question path over all documents, one chunk each, with the stand-in models; those
    without a stored vector are found by their words."""
    docs = r.documents(spark, d)
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    chunks = docs.join(emb, "doc_id", "left").select("doc_id", F.lit(0).alias("chunk_index"), "title", F.lit("").alias("section"), F.lit(1).alias("total"), F.col("text").alias("content"), "embedding", "source_type", "conversation_id")
    asked = r.vector_questions(spark, d).select("query_id", "question", F.col("query_id").alias("conv_id"), "embedding")
    got = answer.answers(asked, chunks, r.messages(spark, d), echo)
    return got.select("query_id", "rewritten", "answer", F.size("sources").alias("n_sources"), F.sha2("context", 256).alias("context_sha256"))


def echo(prompts: list[str]) -> list[str]:
    """The stand-in language model: the last line that holds a question."""
    return [next((x.split(": ", 1)[1] for x in reversed(p.split("\n")) if x.startswith(("Question: ", "Follow-up question: "))), "") for p in prompts]


# -- classification


def _values(name: str, cols: str, table_: dict[str, str]) -> str:
    return f"{name}({cols}) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in table_.items()) + ")"


_EXT = "lower(regexp_extract({}, '^.+(\\.[^.]+)$', 1))"
_FORMATS = ", ".join([r.FILES, _values("fx", "k, v", t.FORMAT_OF_EXTENSION), _values("fn", "k, v", t.FORMAT_OF_NAME), f"fmt AS (SELECT files.*, CASE WHEN lower(name) LIKE '%.tf.json' THEN 'terraform' ELSE coalesce(fn.v, fx.v, 'prose') END AS format FROM files LEFT JOIN fn ON fn.k = name LEFT JOIN fx ON fx.k = {_EXT.format('name')})"])


@query(f"WITH {_FORMATS} SELECT doc_id, path, format FROM fmt")
def classify_format(spark: SparkSession, d: str) -> DataFrame:
    return r.files(spark, d).select("doc_id", "path", cl.format_of(F.col("path")).alias("format"))


@query(
    f"WITH {_FORMATS}, {_values('ft', 'k, v', t.TYPE_OF_FOLDER)}, pp AS (SELECT doc_id, unnest(string_split(lower(path), '/')) AS k, unnest(generate_series(1, len(string_split(path, '/')))) AS i FROM files), pt AS (SELECT doc_id, arg_min(v, i) AS v FROM pp JOIN ft USING (k) GROUP BY doc_id), "
    "hp AS (SELECT doc_id, unnest(string_split(replace(lower(hint), '\\', '/'), '/')) AS k, unnest(generate_series(1, len(string_split(replace(hint, '\\', '/'), '/')))) AS i FROM files), ht AS (SELECT doc_id, arg_min(v, i) AS v FROM hp JOIN ft USING (k) GROUP BY doc_id) "
    "SELECT fmt.doc_id, path, hint, CASE WHEN name LIKE 'adr-%' THEN 'adr' WHEN name LIKE 'INC-%' THEN 'incident' ELSE coalesce(pt.v, ht.v, CASE WHEN format IN ('python', 'go', 'ruby', 'javascript', 'typescript', 'bash', 'dockerfile') THEN 'code' ELSE 'generic' END) END AS doc_type FROM fmt LEFT JOIN pt USING (doc_id) LEFT JOIN ht USING (doc_id)"
)
def classify_doctype(spark: SparkSession, d: str) -> DataFrame:
    return r.files(spark, d).select("doc_id", "path", "hint", cl.doc_type_of(F.col("path"), F.col("hint")).alias("doc_type"))


_KNOWN = ", ".join(f"'{e}'" for e in t.UPLOAD_EXTENSIONS)


@query(f"WITH {r.FILES}, x AS (SELECT *, size_bytes * 2000 AS big, CASE WHEN lower(name) LIKE '%.tf.json' THEN '.tf.json' ELSE {_EXT.format('name')} END AS ext FROM files) SELECT doc_id, name, CASE WHEN ext NOT IN ({_KNOWN}) THEN 'unsupported type' WHEN size_bytes = 0 THEN 'empty file' WHEN big > 209715200 THEN 'too large' ELSE 'ok' END AS corpus_status, CASE WHEN ext NOT IN ({_KNOWN}) THEN 'unsupported type' WHEN size_bytes = 0 THEN 'empty file' WHEN big > 5242880 THEN 'too large' ELSE 'ok' END AS chat_status FROM x")
def upload_validation(spark: SparkSession, d: str) -> DataFrame:
    big = F.col("size_bytes") * 2000  # so that limits of megabytes are met
    name = F.col("name")
    return r.files(spark, d).select("doc_id", "name", cl.upload_status(name, big).alias("corpus_status"), cl.upload_status(name, big, chat=True).alias("chat_status"))


@query(f"WITH {_FORMATS}, {_values('m', 'k, v', t.MIME_OF_FORMAT)} SELECT doc_id, format, coalesce(v, 'application/octet-stream') AS mime FROM fmt LEFT JOIN m ON k = format")
def mime_by_format(spark: SparkSession, d: str) -> DataFrame:
    fmt = cl.format_of(F.col("path"))
    return r.files(spark, d).select("doc_id", fmt.alias("format"), cl.mime_of(fmt).alias("mime"))


# -- chunks


@query(f"WITH {r.LINES} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(total AS INTEGER) AS total, content FROM lines")
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return r.line_chunks(spark, d)


@query(f"WITH {r.DOCS}, {r.LINES} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, '[' || concat_ws(' | ', 'Document: ' || title, 'Source: ' || source, 'Modified: 2026-01-02', 'Part ' || (chunk_index + 1) || ' of ' || total) || ']' || chr(10) AS header FROM lines JOIN docs USING (doc_id)")
def prose_header(spark: SparkSession, d: str) -> DataFrame:
    docs = r.documents(spark, d).select("doc_id", "title", "source", "text")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    rows = docs.select("doc_id", "title", "source", F.size(lines).alias("total"), F.posexplode(lines).alias("chunk_index", "content"))
    head = chunk.prose_header(F.col("title"), F.lit(""), F.col("source"), F.lit("/"), F.lit(""), F.lit("2026-01-02T03:04:05Z"), F.col("chunk_index") + 1, F.col("total"))
    return rows.select("doc_id", "chunk_index", head.alias("header"))


@query(f"WITH {r.LINES} SELECT doc_id, count(*) AS n_chunks, round(avg(length(content)), 6) AS avg_chars FROM lines GROUP BY doc_id")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return r.line_chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.round(F.avg(F.length("content")), 6).alias("avg_chars"))


@query()
def recursive_split(spark: SparkSession, d: str) -> DataFrame:
    return chunk.prose_chunks(table(spark, d, "documents"))


@query(
    "SELECT 'customer' AS file, c_custkey AS key, '[File: customer.csv]' || chr(10) || concat_ws(' | ', 'c_custkey: ' || c_custkey, 'c_name: ' || nullif(trim(c_name), ''), 'c_nationkey: ' || c_nationkey, 'c_acctbal: ' || CAST(c_acctbal AS DECIMAL(15, 2)), 'c_mktsegment: ' || nullif(trim(c_mktsegment), '')) AS content FROM customer "
    "UNION ALL SELECT 'supplier', s_suppkey, '[File: supplier.csv]' || chr(10) || concat_ws(' | ', 's_suppkey: ' || s_suppkey, 's_name: ' || nullif(trim(s_name), ''), 's_nationkey: ' || s_nationkey, 's_acctbal: ' || CAST(s_acctbal AS DECIMAL(15, 2))) FROM supplier "
    "UNION ALL SELECT 'nation', n_nationkey, '[File: nation.csv]' || chr(10) || concat_ws(' | ', 'n_nationkey: ' || n_nationkey, 'n_name: ' || nullif(trim(n_name), ''), 'n_regionkey: ' || n_regionkey) FROM nation"
)
def csv_pipe_rows(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, cols in (("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")), ("supplier", ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")), ("nation", ("n_nationkey", "n_name", "n_regionkey"))):
        cells = {c: F.col(c).cast("decimal(15,2)") if c.endswith("acctbal") else F.col(c) for c in cols}
        part = table(spark, d, name).select(F.lit(name).alias("file"), F.col(cols[0]).cast("bigint").alias("key"), F.concat(F.lit(f"[File: {name}.csv]\n"), chunk.pipe_row(cells)).alias("content"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


# Elements that the declarative page query takes.
_TAGS = {"title": "Title", "h1": "Title", "h2": "Title", "p": "NarrativeText", "li": "ListItem"}


def _elements(tag: str, kind: str):
    body = F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.transform(body, lambda x, i: F.struct(F.lit(tag).alias("tag"), F.lit(kind).alias("element_type"), i.alias("pos"), F.trim(F.regexp_replace(x, r"<[^>]+>", "")).alias("text")))


@query(
    "SELECT page_id, tag, element_type, CAST(i - 1 AS INTEGER) AS pos, text FROM (SELECT page_id, tag, element_type, i, trim(regexp_replace(x[i], '<[^>]+>', '', 'g')) AS text FROM ("
    "SELECT page_id, tag, element_type, x, unnest(generate_series(1, len(x))) AS i FROM ("
    + " UNION ALL ".join(f"SELECT page_id, '{g}' AS tag, '{e}' AS element_type, regexp_extract_all(html, '(?is)<{g}(?:\\s[^>]*)?>(.*?)</{g}>', 1) AS x FROM pages" for g, e in _TAGS.items())
    + "))) WHERE text <> ''"
)
def html_elements(spark: SparkSession, d: str) -> DataFrame:
    found = F.concat(*[_elements(g, e) for g, e in _TAGS.items()])
    return table(spark, d, "pages").select("page_id", F.explode(found).alias("e")).select("page_id", "e.tag", "e.element_type", "e.pos", "e.text").where("text <> ''")


@query("SELECT page_id, string_agg(e, ',' ORDER BY e) AS element_types FROM (SELECT page_id, 'Title' AS e FROM pages WHERE regexp_matches(html, '(?is)<(?:title|h1|h2)(?:\\s[^>]*)?>.*?</(?:title|h1|h2)>') UNION ALL SELECT page_id, 'NarrativeText' FROM pages WHERE regexp_matches(html, '(?is)<p(?:\\s[^>]*)?>.*?</p>') UNION ALL SELECT page_id, 'ListItem' FROM pages WHERE regexp_matches(html, '(?is)<li(?:\\s[^>]*)?>.*?</li>')) GROUP BY page_id")
def element_types(spark: SparkSession, d: str) -> DataFrame:
    return html_elements(spark, d).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("element_type")), ",").alias("element_types"))


@query()
def html_parse(spark: SparkSession, d: str) -> DataFrame:
    return src.parsed_pages(table(spark, d, "pages"))


# -- readers of one text, over whole tables


def _spread(rows: DataFrame) -> DataFrame:
    """Four parts for every core: few bytes are read in one or two tasks, however long each row takes."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _mapped(rows: DataFrame, key: str, fn) -> DataFrame:
    """``key, got``: ``fn`` of the text in ``input``, on the workers."""
    return chunk._flat_map(rows.select(key, "input"), [key], "got string", lambda row: [(fn(row["input"]),)])


@query("SELECT o_custkey AS custkey, '| order | status |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) ORDER BY o_orderkey) AS got FROM orders GROUP BY o_custkey")
def html_table_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The orders of every customer as an HTML table, read back as Markdown."""
    orders = table(spark, d, "orders")
    held = orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("os"))
    body = F.array_join(F.transform("os", lambda o: F.concat(F.lit("<TR class='r'><td> "), o["o_orderkey"].cast("string"), F.lit("</td>\n<td><b>"), o["o_orderstatus"], F.lit("</b></td></TR>"))), "")
    html = F.concat(F.lit("<table><tr><th>order</th><th>status</th></tr><tr><td> </td></tr>"), body, F.lit("</table>"))
    return _mapped(held.select("custkey", html.alias("input")), "custkey", structure.table_markdown)


@query("SELECT event_id, CASE WHEN props IS NULL THEN NULL ELSE 'JSON object with keys: ' || array_to_string(json_keys(props)[:15], ', ') || CASE WHEN len(json_keys(props)) > 15 THEN ' and ' || (len(json_keys(props)) - 15) || ' others' ELSE '' END || '.' END AS header FROM events")
def json_header(spark: SparkSession, d: str) -> DataFrame:
    keys = F.json_object_keys("props")
    more = F.size(keys) - headers.SHOWN
    head = F.concat(F.lit("JSON object with keys: "), F.array_join(F.slice(keys, 1, headers.SHOWN), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" others"))).otherwise(F.lit("")), F.lit("."))
    return table(spark, d, "events").select("event_id", F.when(F.col("props").isNotNull(), head).alias("header"))


def _first_header(fmt: str, filename: str):
    return lambda x: structure.chunk_structured(x, fmt, filename)[0].text.split("\n")[1]


@query("SELECT c_custkey AS custkey, CASE c_custkey % 3 WHEN 0 THEN 'Kubernetes Deployment \"c' || c_custkey || '\" in namespace \"' || lower(c_mktsegment) || '\". Configures: replica count.' WHEN 1 THEN 'Kubernetes ConfigMap \"c' || c_custkey || '\" in namespace \"' || lower(c_mktsegment) || '\". Configures: keys: name, nation' || c_nationkey || '.' ELSE 'YAML configuration with top-level keys: customer, nation' || c_nationkey || '.' END AS got FROM customer")
def yaml_header(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as a manifest, a map of settings or plain YAML."""
    c = _spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    meta = F.concat(F.lit("\nmetadata:\n  name: c"), k, F.lit("\n  namespace: "), F.lower("c_mktsegment"))
    texts = [
        F.concat(F.lit("apiVersion: apps/v1\nkind: Deployment"), meta, F.lit("\nspec:\n  replicas: "), n, F.lit("\n")),
        F.concat(F.lit("apiVersion: v1\nkind: ConfigMap"), meta, F.lit("\ndata:\n  name: '"), F.col("c_name"), F.lit("'\n  nation"), n, F.lit(": x\n")),
        F.concat(F.lit("customer: "), k, F.lit("  # of a segment\nnation"), n, F.lit(":\n  - a: 1\n")),
    ]
    kind = F.col("c_custkey") % 3
    return _mapped(c.select(F.col("c_custkey").alias("custkey"), F.when(kind == 0, texts[0]).when(kind == 1, texts[1]).otherwise(texts[2]).alias("input")), "custkey", lambda x: headers.header("yaml", x, None))


@query("SELECT s_suppkey AS suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Terraform resource \"kind_' || s_nationkey || '\". Attributes: balance, nation' || s_nationkey || ', tags block.' ELSE 'Terraform variable \"s' || s_suppkey || '\".' END AS got FROM supplier")
def hcl_header(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier as a Terraform block."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    resource = F.concat(F.lit('resource "kind_'), n, F.lit('" "s'), k, F.lit('" {\n  balance = 1 # } no end\n  nation'), n, F.lit(' = "{"\n  tags {\n    a = 1\n  }\n}\n'))
    text = F.when(F.col("s_suppkey") % 2 == 0, resource).otherwise(F.concat(F.lit('variable "s'), k, F.lit('" {}\n')))
    return _mapped(_spread(table(spark, d, "supplier").select("s_suppkey", "s_nationkey")).select(F.col("s_suppkey").alias("suppkey"), text.alias("input")), "suppkey", _first_header("terraform", "main.tf"))


@query("SELECT s_suppkey AS suppkey, 'Puppet block with parameters: version, nation' || s_nationkey || '; declares resources: ' || CASE WHEN s_suppkey % 2 = 0 THEN 'file' ELSE 'package' END || '.' AS got FROM supplier")
def puppet_header(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier as a class with parameters and a resource."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    kind = F.when(F.col("s_suppkey") % 2 == 0, "file").otherwise("package")
    text = F.concat(F.lit("class s"), k, F.lit(" (\n  String $version = '1',\n  $nation"), n, F.lit(" = present,\n) {\n  "), kind, F.lit(" { 'x':\n    ensure => $version,\n  }\n}\n"))
    return _mapped(_spread(table(spark, d, "supplier").select("s_suppkey", "s_nationkey")).select(F.col("s_suppkey").alias("suppkey"), text.alias("input")), "suppkey", _first_header("puppet", "site.pp"))


@query()
def structural_chunks(spark: SparkSession, d: str) -> DataFrame:
    files = spark.createDataFrame(samples.FILES, "path string, content string").withColumns({"source": F.lit("upload"), "folder_path": F.lit("/")})
    return chunk.chunk_files(src.classified(files))


# Serialised with an indent of two; an order over the budget gives one part per line, under its key.
# The list below the key has a budget of its own, 17 less, but is indented by less: 10 for each line.
_LINE = "'{{' || chr(10) || '{0}  \"l_linenumber\": ' || l_linenumber || ',' || chr(10) || '{0}  \"l_partkey\": ' || l_partkey || ',' || chr(10) || '{0}  \"l_quantity\": ' || l_quantity || chr(10) || '{0}}}'"
_UNDER_KEY = "'{' || chr(10) || '  \"lines\": [' || chr(10) || '    ' || x || chr(10) || '  ]' || chr(10) || '}'"


@query(
    f"WITH l AS (SELECT l_orderkey AS order_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i, {_LINE.format('    ')} AS line FROM lineitem), "
    f"w AS (SELECT order_key, count(*) AS n, {_UNDER_KEY.replace('x', 'string_agg(line, chr(44) || chr(10) || chr(32) || chr(32) || chr(32) || chr(32) ORDER BY i)')} AS whole FROM l GROUP BY order_key) "
    "SELECT order_key, CAST(0 AS INTEGER) AS part, CAST(1 AS INTEGER) AS parts, whole AS content FROM w WHERE length(whole) <= 300 + 10 * n "
    f"UNION ALL SELECT order_key, CAST(i AS INTEGER), CAST(n AS INTEGER), {_UNDER_KEY.replace('x', 'line')} FROM l JOIN w USING (order_key) WHERE length(whole) > 300 + 10 * n"
)
def json_partition(spark: SparkSession, d: str) -> DataFrame:
    """Every order with its lines as one JSON document, cut to a small budget."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    docs = lines.select(F.col("l_orderkey").alias("order_key"), F.to_json(F.struct("lines")).alias("text"))

    def cut(row: dict) -> list[tuple]:
        parts = jsonparts.split_json(row["text"], 300) or []
        return [(i, len(parts), p) for i, p in enumerate(parts)]

    return chunk._flat_map(docs, ["order_key"], "part int, parts int, content string", cut).drop("text")


@query()
def ingest_samples(spark: SparkSession, d: str) -> DataFrame:
    """The sample files taken in whole: classified, chunked, embedded."""
    files = spark.createDataFrame(samples.FILES, "path string, content string")
    _, chunks = ingest.plan(files, "samples")
    return chunks.select("document_id", "chunk_index", "content", F.size("embedding").alias("width"))


# -- conversations


@query(f"WITH {r.MESSAGES}, {r.CONVS}, n AS (SELECT conv_id, count(*) AS n FROM messages GROUP BY conv_id) SELECT conv_id, title, updated_at, coalesce(n, 0) AS n_messages FROM convs LEFT JOIN n USING (conv_id)")
def conversation_list(spark: SparkSession, d: str) -> DataFrame:
    return chat.conversation_list(r.conversations(spark, d), r.messages(spark, d))


@query(f"WITH {r.MESSAGES} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS pos, role, text FROM messages")
def conversation_detail(spark: SparkSession, d: str) -> DataFrame:
    return chat.conversation_detail(r.messages(spark, d))


@query(f"WITH {r.MESSAGES}, {r.CONVS}, f AS (SELECT conv_id, arg_min(text, turn) AS q FROM messages WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, CASE WHEN title = 'New Chat' AND q IS NOT NULL THEN left(q, 100) ELSE title END AS title, updated_at FROM convs LEFT JOIN f USING (conv_id)")
def auto_title(spark: SparkSession, d: str) -> DataFrame:
    return chat.auto_titles(r.conversations(spark, d), r.messages(spark, d)).select("conv_id", "title", "updated_at")


@query(f"WITH {r.MESSAGES} SELECT conv_id, 'Previous conversation:' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn) AS history FROM messages GROUP BY conv_id")
def history_block(spark: SparkSession, d: str) -> DataFrame:
    return chat.history_blocks(r.messages(spark, d))


@query(f"WITH {r.DOCS}, {r.ATTACHED} SELECT conversation_id, CASE WHEN mode = 'inline' THEN 0 ELSE 1 END AS section, CAST(row_number() OVER (PARTITION BY conversation_id, mode ORDER BY doc_id) AS INTEGER) AS pos, doc_id, mode, size_bytes FROM att")
def attachments_list(spark: SparkSession, d: str) -> DataFrame:
    return chat.attachments(r.documents(spark, d))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size_bytes, CASE WHEN strlen(text) <= 20480 THEN 'inline' ELSE 'chunked' END AS mode FROM documents")
def attachment_routing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("size_bytes"), chat.attachment_mode(F.col("text")).alias("mode"))


@query(f"WITH {r.DOCS}, {r.ATTACHED} SELECT conversation_id, CAST(sum(size_bytes) AS BIGINT) AS inline_bytes, sum(size_bytes) > 40960 AS warn FROM att WHERE mode = 'inline' GROUP BY conversation_id")
def inline_bytes_warning(spark: SparkSession, d: str) -> DataFrame:
    return chat.inline_sizes(chat.attachments(r.documents(spark, d)))


@query(
    f"WITH {r.MESSAGES}, {r.CONVS}, {r.DOCS}, {r.LINES}, g AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING min(role) <> 'assistant' OR count(*) <= 2), ld AS (SELECT doc_id FROM docs WHERE conversation_id IS NULL OR conversation_id NOT IN (SELECT conv_id FROM g)) "
    "SELECT 'conversations' AS relation, count(*) AS n FROM convs WHERE conv_id NOT IN (SELECT conv_id FROM g) UNION ALL SELECT 'messages', count(*) FROM messages WHERE conv_id NOT IN (SELECT conv_id FROM g) UNION ALL SELECT 'documents', count(*) FROM ld UNION ALL SELECT 'chunks', count(*) FROM lines UNION ALL SELECT 'orphans', count(*) FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM ld)"
)
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "conversations").groupBy("conv_id").agg(F.min("role").alias("role"), F.count("*").alias("n")).where("role <> 'assistant' or n <= 2").select("conv_id")
    left = chat.deleted(gone, r.conversations(spark, d), r.messages(spark, d), r.documents(spark, d).drop("text"), r.line_chunks(spark, d).select("doc_id", "chunk_index"))
    out = None
    for name, df in left.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# The texts of a question's documents, and what is spent after each: the first counts its texts twice
# and its heading once. Ends are running totals of lengths within a document.
_CONTEXT = (
    "hit AS (SELECT query_id, doc_id FROM reranked), txt AS (SELECT query_id, doc_id, chunk_index, '  [Part ' || (chunk_index + 1) || ' of ' || total || ']' || chr(10) || '  ' || content || chr(10) AS t FROM hit JOIN lines USING (doc_id)), "
    "run AS (SELECT *, CAST(sum(length(t)) OVER (PARTITION BY query_id, doc_id ORDER BY chunk_index) AS BIGINT) AS e FROM txt), "
    "held AS (SELECT query_id, doc_id, 'From \"doc-' || doc_id || '\":' || chr(10) AS head, list({'t': t, 'e': e} ORDER BY chunk_index) AS xs FROM run GROUP BY query_id, doc_id), "
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS i FROM held), "
    "opened AS (SELECT query_id, i, head, list_filter(xs, lambda x: 2 * x.e - length(x.t) + length(head) <= 40000) AS kept FROM numbered WHERE i = 1), "
    "shown AS (SELECT query_id, i, coalesce(list_max(list_transform(kept, lambda x: x.e)), 0) AS spent, head || list_aggregate(list_prepend('', list_transform(kept, lambda x: x.t)), 'string_agg', '') AS block FROM opened "
    "UNION ALL SELECT query_id, i, spent + coalesce(list_max(list_transform(kept, lambda x: x.e)), 0), head || list_aggregate(list_prepend('', list_transform(kept, lambda x: x.t)), 'string_agg', '') FROM "
    "(SELECT s.query_id, n.i, n.head, s.spent, list_filter(n.xs, lambda x: s.spent + x.e <= 40000) AS kept FROM shown s JOIN numbered n ON n.query_id = s.query_id AND n.i = s.i + 1 WHERE s.spent < 40000))"
)


@query(f"WITH RECURSIVE {r.HYBRID}, {r.RERANK}, {r.LINES}, {_CONTEXT}, c AS (SELECT query_id, string_agg(block, chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS context FROM shown GROUP BY query_id) SELECT query_id, CAST(length(context) AS INTEGER) AS n_chars, sha256(context) AS context_sha256 FROM c")
def context_block(spark: SparkSession, d: str) -> DataFrame:
    """Context of every question: all the lines of its reranked documents, within the cap."""
    hits = _reranked(spark, d).select("query_id", "doc_id")
    lines = r.line_chunks(spark, d).select("doc_id", (F.col("chunk_index") + 1).alias("position"), "total", "content")
    rows = hits.join(lines, "doc_id").select("query_id", F.col("doc_id").alias("document_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), F.lit("").alias("section"), "position", "total", "content")
    return context.context_blocks(rows).select("query_id", F.length("context").alias("n_chars"), F.sha2("context", 256).alias("context_sha256"))


@query("SELECT doc_id || ':0' AS chunk_id, doc_id AS document_id, left(text, 200) AS content_preview, 0 AS chunk_index FROM documents")
def source_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("chunk_id"), F.col("doc_id").alias("document_id"), F.substring("text", 1, 200).alias("content_preview"), F.lit(0).alias("chunk_index"))


# -- synchronisation


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").cast("string").alias("file_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_modified"))


def _listing(orders: DataFrame) -> DataFrame:
    day = F.when(F.col("o_orderstatus") == "P", F.date_add(F.col("o_orderdate").cast("date"), 1)).otherwise(F.col("o_orderdate").cast("date"))
    return orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").cast("string").alias("file_id"), F.date_format(day, "yyyy-MM-dd").alias("last_modified"))


_SYNC = "SELECT CAST(o_orderkey AS VARCHAR) AS file_id, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'P' THEN 'changed' ELSE 'unchanged' END AS action FROM orders WHERE o_orderpriority <> '5-LOW'"


@query(_SYNC)
def sync_actions(spark: SparkSession, d: str) -> DataFrame:
    return sync.actions(_listing(table(spark, d, "orders")), _stored(spark, d))


@query(f"WITH a AS ({_SYNC}) SELECT count(*) AS total, count(*) FILTER (action = 'new') AS added, count(*) FILTER (action = 'changed') AS updated, count(*) FILTER (action = 'unchanged') AS skipped, CAST(0 AS BIGINT) AS failed FROM a")
def sync_summary(spark: SparkSession, d: str) -> DataFrame:
    done = sync.actions(_listing(table(spark, d, "orders")), _stored(spark, d)).withColumn("error", F.lit(None).cast("string"))
    return sync.summary(done)


@query(_SYNC)
def sync_stream(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    root = f"{shared_dir(spark)}/sync-{uuid.uuid4().hex}"
    listings = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    return stream.run_available(spark, _listing(listings), _stored(spark, d), root + "/out", root + "/state")


@query("SELECT CAST(c_custkey AS VARCHAR) AS file_id, CASE c_custkey % 5 WHEN 0 THEN 'u' || c_custkey || '@x.io,anyone' WHEN 1 THEN 'domain:' || c_name || ',g' || c_nationkey || '@x.io' WHEN 2 THEN 'domain:d' || c_nationkey || '.io' WHEN 3 THEN '' ELSE '' END AS permissions FROM customer")
def permissions_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as a file with a list of permissions, none of them or no list."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    none = F.lit(None).cast("string")
    entry = lambda kind, mail=none, shown=none: F.struct(F.lit(kind).alias("type"), mail.alias("emailAddress"), shown.alias("displayName"))
    lists = [
        F.array(entry("user", F.concat(F.lit("u"), k, F.lit("@x.io"))), entry("user", none, F.col("c_name")), entry("anyone")),
        F.array(entry("domain", none, F.col("c_name")), entry("group", F.concat(F.lit("g"), n, F.lit("@x.io")), F.col("c_name"))),
        F.array(entry("domain", F.concat(F.lit("d"), n, F.lit(".io"))), entry("other", F.lit("o@x.io"))),
        F.slice(F.array(entry("anyone")), 1, 0),
    ]
    kind = F.col("c_custkey") % 5
    chosen = F.when(kind == 0, lists[0]).when(kind == 1, lists[1]).when(kind == 2, lists[2]).when(kind == 3, lists[3])
    return table(spark, d, "customer").select(k.alias("file_id"), F.array_join(cl.flat_permissions(chosen), ",").alias("permissions"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS file_id, CASE c_custkey % 4 WHEN 0 THEN '/' || n_name || '/x' || c_custkey WHEN 1 THEN '/' || n_name ELSE '/' END AS folder_path FROM customer JOIN nation ON c_nationkey = n_nationkey")
def folder_path(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as a file below its nation's folder, whose id has a name; other ids have none."""
    entries = F.collect_list(F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.col("n_name")))
    names = table(spark, d, "nation").agg(F.map_from_entries(entries).alias("names"))  # one row
    k, own = F.col("c_custkey").cast("string"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    kind = F.col("c_custkey") % 4
    parents = F.when(kind == 0, F.array(own, F.concat(F.lit("x"), k))).when(kind == 1, F.array(own)).when(kind == 2, F.array().cast("array<string>"))
    return table(spark, d, "customer").crossJoin(F.broadcast(names)).select(k.alias("file_id"), cl.folder_path(parents, F.col("names")).alias("folder_path"))


# Types that the synthetic listing deals out by id; the first are native ones.
_MIMES = (*t.EXPORTS, t.NATIVE_PREFIX + "form", "application/pdf", "text/plain")
_TAKEN = ", ".join(f"'{e}'" for e in t.LISTING_EXTENSIONS)
_EXPORTED = "ex(k, m, e) AS (VALUES " + ", ".join(f"('{k}', '{m}', '{e}')" for k, (m, e) in t.EXPORTS.items()) + ")"


@query(
    f"WITH {r.FILES}, {_EXPORTED}, l AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, name, {r.sql_list(_MIMES)}[doc_id % {len(_MIMES)} + 1] AS mime FROM files), x AS (SELECT l.*, ex.m, ex.e, {_EXT.format('name')} AS ext FROM l LEFT JOIN ex ON ex.k = mime) "
    rf"SELECT file_id, CASE WHEN e IS NOT NULL THEN regexp_replace(name, '^(.+)\.[^.]*$', '\1') || e ELSE name END AS name, coalesce(m, mime) AS mime_type FROM x WHERE CASE WHEN starts_with(mime, '{t.NATIVE_PREFIX}') THEN m IS NOT NULL ELSE ext IN ({_TAKEN}) END"
)
def listing_filter(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a listed file of a name and a type."""
    rows = r.files(spark, d).select(F.col("doc_id").cast("string").alias("file_id"), "name", r._pick(_MIMES, F.col("doc_id")).alias("mime_type"))
    return connector.eligible(rows).select("file_id", "name", "mime_type")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS file_id, strftime(CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END, '%Y-%m-%d') AS last_modified FROM orders WHERE o_orderstatus <> 'O' OR o_orderpriority <> '5-LOW'")
def sync_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """What is stored after a synchronisation: changed and new files from the listing, the rest as it was."""
    listing, stored = _listing(table(spark, d, "orders")), _stored(spark, d)
    return sync.replaced(stored, listing, sync.actions(listing, stored))


def _done(spark: SparkSession, d: str) -> DataFrame:
    """Actions of which every new file of a key that seven divides failed."""
    done = sync.actions(_listing(table(spark, d, "orders")), _stored(spark, d))
    failed = (F.col("action") == "new") & (F.col("file_id").cast("bigint") % 7 == 0)
    return done.withColumn("error", F.when(failed, F.concat(F.lit("no access to "), F.col("file_id"))))


_FAILED = f"a AS ({_SYNC}), f AS (SELECT *, CASE WHEN action = 'new' AND CAST(file_id AS BIGINT) % 7 = 0 THEN 'no access to ' || file_id END AS error FROM a)"


@query(f"WITH {_FAILED} SELECT count(*) AS total, count(*) FILTER (error IS NULL AND action = 'new') AS added, count(*) FILTER (error IS NULL AND action = 'changed') AS updated, count(*) FILTER (error IS NULL AND action = 'unchanged') AS skipped, count(error) AS failed FROM f")
def sync_failures(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a synchronisation in which files fail: these are no more than failed."""
    return sync.summary(_done(spark, d))


@query(f"WITH {_FAILED} SELECT file_id, error FROM f WHERE error IS NOT NULL ORDER BY file_id LIMIT {sync.SHOWN_ERRORS}")
def sync_errors(spark: SparkSession, d: str) -> DataFrame:
    """The errors that a report shows."""
    return sync.first_errors(_done(spark, d))


@query(f"WITH {r.FILES} SELECT doc_id, string_split(path, '/')[1] AS category FROM files")
def corpus_category(spark: SparkSession, d: str) -> DataFrame:
    """The category of every file of a corpus: its first folder below the root."""
    root = F.lit("/data/corpus")
    return r.files(spark, d).select("doc_id", cl.top_category(F.concat(root, F.lit("/"), F.col("path")), root).alias("category"))


@query(f"WITH {r.FILES} SELECT doc_id, contains(lower(path), lower({r.sql_list(r.NAMES)}[(doc_id // 2) % {len(r.NAMES)} + 1])) OR contains(lower(hint), lower({r.sql_list(r.NAMES)}[(doc_id // 2) % {len(r.NAMES)} + 1])) AS found FROM files")
def filename_match(spark: SparkSession, d: str) -> DataFrame:
    """Whether an expected file name stands in a document's path or hint."""
    expected = r._pick(r.NAMES, F.floor(F.col("doc_id") / 2))
    return r.files(spark, d).select("doc_id", cl.filename_matches(expected, F.col("path"), F.col("hint")).alias("found"))


@query("SELECT doc_id, length(text) * 0.25 > 14000 AS warn FROM documents")
def prompt_warning(spark: SparkSession, d: str) -> DataFrame:
    """Whether a prompt of every document's text would be too long for the model."""
    return table(spark, d, "documents").select("doc_id", models.prompt_is_long(F.col("text")).alias("warn"))


# -- evaluation


_SCORES = "ex AS (SELECT query_id, doc_id FROM vq JOIN ed USING (label)), nx AS (SELECT query_id, count(*) AS n FROM ex GROUP BY query_id), fo AS (SELECT query_id, count(*) AS f, min(relevance_rank) AS rel, min(reading_rank) AS rea FROM reranked JOIN ex USING (query_id, doc_id) GROUP BY query_id), s AS (SELECT query_id, label, coalesce(round(coalesce(f, 0) / n::DOUBLE, 6), 0.0) AS recall, coalesce(round(1 / rel::DOUBLE, 6), 0.0) AS mrr, coalesce(round(1 / rea::DOUBLE, 6), 0.0) AS mrr_reading, CASE WHEN coalesce(f, 0) > 0 THEN 1 ELSE 0 END AS hit FROM vq LEFT JOIN nx USING (query_id) LEFT JOIN fo USING (query_id))"
_EVAL = f"WITH {r.HYBRID}, {r.RERANK}, {_SCORES}"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.scores(_expected(spark, d), _reranked(spark, d), r.vector_questions(spark, d), mrr="relevance_rank", mrr_reading="reading_rank")


@query(f"{_EVAL} SELECT query_id, recall, mrr, mrr_reading, hit FROM s")
def eval_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("query_id", "recall", "mrr", "mrr_reading", "hit")


@query(f"{_EVAL} SELECT CASE WHEN grouping(label) = 1 THEN 'all' ELSE CAST(label AS VARCHAR) END AS category, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(hit), 6) AS hit_rate FROM s GROUP BY GROUPING SETS ((), (label))")
def eval_by_category(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.by_category(_scored(spark, d), r.vector_questions(spark, d).select("query_id", F.col("label").alias("category")))


_ANSWER = f"{r.sql_list(samples.ANSWERS)}[query_id % {len(samples.ANSWERS)} + 1]"


@query(
    f"{_EVAL}, a AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'refusal' ELSE CAST(label AS VARCHAR) END AS category, recall, mrr, hit, CASE WHEN regexp_matches({_ANSWER}, '(?i)" + "|".join(x.replace("'", "''") for x in t.REFUSALS) + "') THEN 1 ELSE 0 END AS refused FROM s), "
    "b AS (SELECT category, CASE WHEN category = 'refusal' THEN refused ELSE recall END AS recall, CASE WHEN category = 'refusal' THEN refused ELSE mrr END AS mrr, CASE WHEN category = 'refusal' THEN refused ELSE hit END AS hit FROM a) "
    "SELECT CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(hit), 6) AS hit_rate FROM b GROUP BY GROUPING SETS ((), (category))"
)
def eval_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Means by category where every third question should be refused: these go by the answer."""
    category = F.when(F.col("query_id") % 3 == 0, evaluate.REFUSAL).otherwise(F.col("label").cast("string"))
    asked = r.vector_questions(spark, d).select("query_id", category.alias("category"), r._pick(tuple(samples.ANSWERS), F.col("query_id")).alias("answer"))
    scored = evaluate.with_refusals(_scored(spark, d), asked)
    return evaluate.by_category(scored, asked.select("query_id", "category"))


@query(f"{_EVAL} SELECT query_id // 4 AS trace_id, count(*) AS n_turns, CAST(sum(hit) AS BIGINT) AS turn_hits, min(hit) AS all_hit FROM s GROUP BY query_id // 4")
def eval_traces(spark: SparkSession, d: str) -> DataFrame:
    turns = r.vector_questions(spark, d).select("query_id", F.floor(F.col("query_id") / 4).cast("bigint").alias("trace_id"))
    return evaluate.traces(_scored(spark, d), turns)


_REFUSES = "regexp_matches(text, '(?i)" + "|".join(x.replace("'", "''") for x in t.REFUSALS) + "')"


@query(f"SELECT 'conversations' AS origin, count(*) AS n, count(*) FILTER ({_REFUSES}) AS refused FROM conversations WHERE role = 'assistant' UNION ALL SELECT 'samples', count(*), count(*) FILTER ({_REFUSES}) FROM (VALUES " + ", ".join("('" + x.replace("'", "''") + "')" for x in samples.ANSWERS) + ") AS x(text)")
def refusal_rate(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations").where("role = 'assistant'").select(F.lit("conversations").alias("origin"), "text")
    known = spark.createDataFrame([("samples", x) for x in samples.ANSWERS], "origin string, text string")
    return said.unionByName(known).groupBy("origin").agg(F.count("*").alias("n"), F.count_if(cl.is_refusal(F.col("text"))).alias("refused"))


@query("SELECT doc_id, 64 AS width, CASE WHEN regexp_matches(coalesce(text, ''), '[^\\s]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents")
def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Widths and lengths of the stand-in model's vectors: every text with a word has one of length 1."""
    docs = models.embedded(table(spark, d, "documents").select("doc_id", "text"), "text", models.hashing_embedder)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return docs.select("doc_id", F.size("embedding").alias("width"), F.round(F.sqrt(norm), 3).alias("norm"))


@query(f"WITH {r.CONVS} SELECT conv_id, title, updated_at FROM convs WHERE conv_id = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.by_key(r.conversations(spark, d), conv_id=7).select("conv_id", "title", "updated_at")


@query("SELECT event_id, event_type FROM events WHERE coalesce(json_extract_string(props, '$.k') = '42', false)")
def metadata_predicate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(lookup.json_is(F.col("props"), "$.k", "42")).select("event_id", "event_type")
