"""A training corpus in five stages: language, repeated lines, near copies, benchmark leaks, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontaminate, langid, line_dedup, ngram_join
from lodestone.llm.common import discard, discard_since, ensure_workers, materialise, table, written
from lodestone.llm.queries import vocabulary


# Every stage takes tables with nulls in any column, repeated rows and ids, empty and very long texts
# and columns of any name, and an empty table, which gives an empty result. All but the last return
# the columns of their input.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Null texts and texts without a letter go; where no row
    has text and lang nothing is known, and all go."""
    ensure_workers(spark)
    return langid.drop_rejected(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that others repeat: a passage that stands in three
    documents as a line of its own is taken out of all but the last, and they stay. A text that
    loses every line, or a null one, is empty; n_chars follows."""
    ensure_workers(spark)
    return line_dedup.cleaned(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least id; rows without an id come last.
    Documents without words are nobody's copies and all stay."""
    ensure_workers(spark)
    return ngram_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark, 13 words or a shorter item whole. What the
    lines stage has taken out is not held any more."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests; a null text is an empty one."""
    ensure_workers(spark)
    return bpe.report(docs, vocabulary())


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("tokens", tokens)]

#: Nearest centroids, MinHash and merges of a vocabulary are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark, before = written(), docs
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard_since(spark, mark, docs)  # what the stage wrote for itself
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
