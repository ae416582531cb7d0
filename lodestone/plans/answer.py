"""The question path as one plan over a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.context import answer_prompt
from ..operators import chat, keyword, models, retrieve, vector
from ..operators.context import context_blocks
from ..session import materialise


def answers(questions: DataFrame, chunks: DataFrame, messages: DataFrame, generator: models.Generator, reranker: models.Reranker = models.overlap_reranker, inline: DataFrame | None = None, settings: Settings = DEFAULTS, embedder: Callable[[], models.Embedder] | None = None) -> DataFrame:
    """``query_id, rewritten, context, prompt, answer, sources`` for ``questions(query_id, question,
    conv_id, embedding)``.

    A follow-up is rewritten for retrieval by what the conversation said before; the question itself
    goes into the prompt. ``chunks(doc_id, chunk_index, title, section, total, content, embedding,
    source_type, conversation_id)``; texts are joined to the few candidates that both retrievers left.
    ``inline(conv_id, filename, text)``: attachments that go into the context in full.
    ``embedder``: where given, vectors are searched by the embedding of the rewritten text, in place
    of that of the question. ``settings.neighbor_window`` chunks to either side of a hit join it, in
    the context and among the sources.

    Questions are rewritten once and written, as are the candidates: no branch calls a model again.
    """
    history = chat.history_blocks(messages).select("conv_id", "history")
    asked = questions.join(history, "conv_id", "left").withColumn("history", F.coalesce("history", F.lit("")))
    rewritten = F.when(F.col("history") == "", F.col("question")).otherwise(F.trim(models.generated(F.coalesce(models.rewrite_prompts(F.col("history"), F.col("question")), F.lit("")), generator)))
    asked = asked.withColumn("rewritten", rewritten)
    if embedder is not None:
        asked = models.embedded(asked.drop("embedding"), "rewritten", embedder)
    asked = materialise(asked, "asked")

    place = F.xxhash64("doc_id", "chunk_index")
    scope = [F.col("source_type").alias("scope_type"), F.col("conversation_id").cast("bigint").alias("scope_conv")]
    keyed = chunks.withColumn("place", place)
    q = asked.select("query_id", "embedding", F.col("conv_id").alias("q_conv"), keyword.query_terms(F.col("rewritten")).alias("terms"))
    near = vector.topk_batch(keyed.select("place", "embedding", *scope), q, settings.vector_candidates, key="place", query_key="query_id").select("query_id", F.col("key").alias("doc_id"), "rank")
    w = keyword.WEIGHTS
    words = keyword.ranked(keyed.select("place", F.col("content"), "section", "title", *scope), q, settings.keyword_candidates, w, key="place").select("query_id", F.col("place").alias("doc_id"), "rank")
    pool = retrieve.pool(near, words).withColumnRenamed("doc_id", "place")

    found = pool.join(keyed.drop("embedding"), "place").join(asked.select("query_id", "rewritten"), "query_id")
    found = found.withColumn("score", models.rerank_score(F.col("rewritten"), F.col("content"), reranker))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "pool_pos")
    top = found.withColumn("relevance", F.row_number().over(best)).where(F.col("relevance") <= settings.top_k)
    top = materialise(top.select("query_id", "doc_id", "chunk_index", "title", "section", "total", "content"), "top")
    if settings.neighbor_window > 0:
        window = settings.neighbor_window
        places = F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - window), F.col("chunk_index") + window)).alias("chunk_index")
        near = top.select("query_id", "doc_id", places).distinct()
        top = near.join(chunks.select("doc_id", "chunk_index", "title", "section", "total", "content"), ["doc_id", "chunk_index"])

    hits = top.select("query_id", F.col("doc_id").alias("document_id"), "title", "section", (F.col("chunk_index") + 1).alias("position"), "total", "content")
    files = None if inline is None else asked.select("query_id", "conv_id").join(inline, "conv_id").select("query_id", "filename", "text")
    context = context_blocks(hits, files, settings)
    source = F.struct("doc_id", "chunk_index", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.substring("content", 1, 200).alias("content_preview"))
    sources = top.groupBy("query_id").agg(F.sort_array(F.collect_list(source)).alias("sources"))

    out = asked.join(context, "query_id", "left").join(sources, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    prompt = F.udf(answer_prompt, "string", useArrow=True)("question", "context", "history")
    out = out.withColumn("prompt", prompt)
    return out.select("query_id", "rewritten", "context", "prompt", models.generated(F.col("prompt"), generator).alias("answer"), F.coalesce("sources", F.array()).alias("sources"))
