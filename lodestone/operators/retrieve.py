"""Hybrid retrieval: two candidate lists, one pool, a reranker, reading order, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS


def in_scope(source_type: Column, conversation: Column, of: Column) -> Column:
    """Corpus documents, and attachments of the asking conversation."""
    return (source_type == "corpus") | ((source_type == "attachment") & (conversation == of))


def pool(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """``query_id, doc_id, origin, pool_pos``: both lists after each other, the first occurrence of a
    document wins, vector hits before keyword hits."""
    side = lambda df, name, o: df.select("query_id", "doc_id", F.struct(F.lit(o).alias("o"), F.col("rank").alias("r"), F.lit(name).alias("origin")).alias("at"))
    both = side(vector, "vector", 0).unionByName(side(keyword, "keyword", 1))
    first = both.groupBy("query_id", "doc_id").agg(F.min("at").alias("at"))
    w = Window.partitionBy("query_id").orderBy("at")
    return first.select("query_id", "doc_id", F.col("at.origin").alias("origin"), F.row_number().over(w).alias("pool_pos"))


def rerank(candidates: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """``query_id, doc_id, score, relevance_rank, reading_rank``: best ``k`` by score, the pool's order
    breaking ties; then in order of document. ``scores(query_id, doc_id, score)``."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "pool_pos")
    top = candidates.join(scores, ["query_id", "doc_id"]).withColumn("relevance_rank", F.row_number().over(best)).where(F.col("relevance_rank") <= k)
    reading = Window.partitionBy("query_id").orderBy("doc_id")
    return top.select("query_id", "doc_id", "score", "relevance_rank", F.row_number().over(reading).alias("reading_rank"))


def lexical_scores(candidates: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """The stand-in reranker: the share of a query's terms that a document's text holds.

    Only candidates meet their text: ids are joined first, texts last."""
    from .keyword import tokens

    pairs = candidates.select("query_id", "doc_id").join(queries.select("query_id", "terms"), "query_id")
    found = docs.select("doc_id", "text").join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    held = found.select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("held"))
    share = F.size(F.array_intersect("terms", "held")) / F.nullif(F.size("terms"), F.lit(0))
    return held.join(pairs, "doc_id").select("query_id", "doc_id", F.coalesce(F.round(share, 6), F.lit(0.0)).alias("score"))


def neighbours(hits: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """``document, chunk_index, is_hit``: hits and the chunks up to ``window`` places from one, once
    each. ``hits(document, chunk_index)``, ``chunks(document, chunk_index)``: an equi-join on exploded
    places, no range join."""
    places = F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - window), F.col("chunk_index") + window)
    near = hits.select("document", F.col("chunk_index").alias("hit"), F.explode(places).alias("chunk_index"))
    near = near.groupBy("document", "chunk_index").agg(F.max(F.col("hit") == F.col("chunk_index")).alias("is_hit"))
    return near.join(chunks.select("document", "chunk_index"), ["document", "chunk_index"])


def first_ranks(ranking: DataFrame, expected: DataFrame, queries: DataFrame, depth: int = DEFAULTS.diagnostic_depth) -> DataFrame:
    """``query_id, first_rank``: the best rank of an expected document within ``depth``; null if none."""
    hit = ranking.where(F.col("rank") <= depth).join(expected, ["query_id", "doc_id"], "left_semi")
    return queries.select("query_id").join(hit.groupBy("query_id").agg(F.min("rank").alias("first_rank")), "query_id", "left")


