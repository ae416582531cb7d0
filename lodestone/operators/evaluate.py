"""Retrieval quality: recall, reciprocal rank, hits, traces, refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import is_refusal

#: Fixed value: the category of questions that should be refused.
REFUSAL = "refusal"


def scores(expected: DataFrame, ranking: DataFrame, questions: DataFrame, **ranks: str) -> DataFrame:
    """``query_id, recall, hit`` of every question and, for each of ``ranks`` (name to column), the
    reciprocal of the best rank of an expected document; zeros where nothing is expected or found.

    ``expected(query_id, doc_id)``, ``ranking(query_id, doc_id, <rank columns>)``."""
    ranks = ranks or {"mrr": "rank"}
    want = expected.groupBy("query_id").agg(F.count("*").alias("n"))
    best = [F.min(c).alias(f"__{name}") for name, c in ranks.items()]
    found = expected.join(ranking, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count_distinct("doc_id").alias("f"), *best)
    out = questions.select("query_id").join(want, "query_id", "left").join(found, "query_id", "left")
    f = F.coalesce("f", F.lit(0))
    recall = F.coalesce(F.round(f / F.nullif(F.col("n"), F.lit(0)), 6), F.lit(0.0))
    return out.select("query_id", recall.alias("recall"), *[F.coalesce(F.round(1 / F.col(f"__{name}"), 6), F.lit(0.0)).alias(name) for name in ranks], (f > 0).cast("int").alias("hit"))


def with_refusals(scored: DataFrame, asked: DataFrame) -> DataFrame:
    """``scored`` where questions of the category ``refusal`` go by their answer alone: all ones if
    it refuses, zeros if not or if there is none. ``asked(query_id, category, answer)``; a question
    that isn't asked keeps its scores."""
    known = asked.select("query_id", (F.col("category") == REFUSAL).alias("__by_answer"), is_refusal(F.col("answer")).alias("__refused"))
    one = lambda c: F.when(F.col("__by_answer"), F.col("__refused").cast("int")).otherwise(F.col(c)).alias(c)
    return scored.join(known, "query_id", "left").select(*[c if c == "query_id" else one(c) for c in scored.columns])


def by_category(scored: DataFrame, categories: DataFrame) -> DataFrame:
    """Means by category and, with a null category turned to ``all``, over everything; questions that
    failed count as zeros."""
    rows = scored.join(categories, "query_id")
    means = [F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr")]
    return rows.groupingSets([[], ["category"]], "category").agg(F.count("*").alias("n"), *means, F.round(F.avg("hit"), 6).alias("hit_rate"), F.grouping("category").alias("g")).select(F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("category").cast("string")).alias("category"), "n", "recall", "mrr", "hit_rate")


def traces(scored: DataFrame, turns: DataFrame) -> DataFrame:
    """``trace_id, n_turns, turn_hits, all_hit``; ``turns(query_id, trace_id)``. A turn without a score
    failed: it is no turn of the count, but its trace does not pass."""
    rows = turns.join(scored, "query_id", "left")
    return rows.groupBy("trace_id").agg(F.count("hit").alias("n_turns"), F.coalesce(F.sum("hit"), F.lit(0)).alias("turn_hits"), F.min(F.coalesce("hit", F.lit(0))).alias("all_hit"))


def rate(condition: Column) -> Column:
    return F.round(F.avg(condition.cast("double")), 6)
