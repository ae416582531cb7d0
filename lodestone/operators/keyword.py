"""Keyword retrieval: any-term matches ranked by weighted occurrences over a logarithm of length.

A document's score depends on that document alone, so nothing is shuffled but each partition's own
best: a batch of documents becomes a matrix of weighted counts over the terms of a block of
questions, and its product with the questions' terms gives all scores. Both matrices are bounded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import english
from .meet import met

# Weights of the content, the section and the title of a chunk.
WEIGHTS = {"content": 1.0, "section": 0.4, "title": 0.2}
#: Questions in a block, and their terms, about; bytes of text in a block of documents.
BLOCK_QUESTIONS, BLOCK_TERMS = 256, 16_384
ROW_BLOCK_BYTES = 256 << 20
TILE_CELLS = 4_000_000
#: Scores that agree to so many digits are ties; more is the noise of doubles.
DIGITS = 12
MEMORY_WORDS = 200_000
Analyser = Callable[[str], list[str]]


def query_terms(question: Column) -> Column:
    """Distinct lower-cased alphanumeric runs of two characters or more, in order."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1)), F.lower), lambda t: F.length(t) >= 2))


def or_query(question: Column) -> Column:
    return F.array_join(query_terms(question), " | ")


def tokens(text: Column) -> Column:
    """The simple analyser as an expression: lower case, alphanumeric runs, nothing left out."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def simple() -> Analyser:
    """The simple analyser on a worker."""
    runs = re.compile("[a-z0-9]+")
    return lambda text: runs.findall(text.lower())


def stemming() -> Analyser:
    """The English analyser on a worker: no stop words, stems, with a bounded memory of these."""
    memory: dict[str, str] = {}

    def run(text: str) -> list[str]:
        if len(memory) > MEMORY_WORDS:
            memory.clear()
        return english.analyse(text, memory)

    return run


@F.pandas_udf(T.ArrayType(T.StringType()))
def _english(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    run = stemming()
    for s in texts:
        yield s.map(lambda t: run(t or ""))


def english_tokens(text: Column) -> Column:
    return _english(F.coalesce(text, F.lit("")))


def postings(docs: DataFrame, fields: dict[str, float], key: str = "doc_id") -> DataFrame:
    """``key, term, weight, n``: the index as a table, to be written partitioned by a hash of the term
    and joined with the terms of a question; n is the number of tokens of the document."""
    lists = F.concat(*[_with_weight(tokens(F.col(c)), w) for c, w in fields.items()])
    rows = docs.select(key, lists.alias("t")).select(key, F.size("t").alias("n"), F.explode("t").alias("t"))
    return rows.groupBy(key, "t.term", "n").agg(F.sum("t.w").alias("weight")).select(key, "term", "weight", "n")


def _with_weight(terms: Column, weight: float) -> Column:
    return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))


def log_length(n: np.ndarray) -> np.ndarray:
    return np.log(n + 1.0)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best columns of each row: greatest score, then least id; scores of 0 are no match."""
    order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
    return np.take_along_axis(np.broadcast_to(ids, score.shape), order, 1), np.take_along_axis(score, order, 1)


class Best:
    """Questions of one block (query, terms, conv) and the k best keys of each."""

    def __init__(self, questions: pa.Table, k: int, fields: dict[str, float], scoped: bool, normaliser, analyser: Callable[[], Analyser]):
        ids, terms, conv = (questions.column(n).to_pylist() for n in ("query", "terms", "conv"))
        self.k, self.fields, self.scoped, self.normaliser, self.split = k, fields, scoped, normaliser, analyser()
        self.words = {w: i for i, w in enumerate(dict.fromkeys(t for ts in terms for t in ts))}
        self.asks = np.zeros((len(self.words), len(ids)))
        for q, ts in enumerate(terms):
            self.asks[[self.words[t] for t in ts], q] = 1.0
        self.query, self.conv = np.array(ids, np.int64), np.array([-1 if c is None else c for c in conv])
        self.ids, self.scores = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))

    def meet(self, b: pa.RecordBatch) -> None:
        col = lambda n: b.column(b.schema.get_field_index(n))
        texts = {f: col(f"text_{i}").to_pylist() for i, f in enumerate(self.fields)}
        keys = col("key").to_numpy(zero_copy_only=False).astype(np.int64)
        step = max(1, TILE_CELLS // max(len(self.words) + len(self.query), 1))
        for lo in range(0, b.num_rows, step):
            hi = min(lo + step, b.num_rows)
            tf, n = np.zeros((hi - lo) * len(self.words)), np.zeros(hi - lo)
            for f, w in self.fields.items():
                at: list[int] = []
                for i, text in enumerate(texts[f][lo:hi]):
                    got = self.split(text or "")
                    n[i] += len(got)
                    base = i * len(self.words)
                    at += [base + self.words[t] for t in got if t in self.words]
                if at:
                    tf += w * np.bincount(at, minlength=len(tf))
            score = np.round(tf.reshape(hi - lo, -1) @ self.asks / np.maximum(self.normaliser(n), 1e-12)[:, None], DIGITS)
            if self.scoped:
                kind = np.array(col("kind").to_pylist()[lo:hi])
                own = np.array([-2 if c is None else c for c in col("own").to_pylist()[lo:hi]])
                score[~((kind == "corpus")[:, None] | ((kind == "attachment")[:, None] & (own[:, None] == self.conv[None, :])))] = 0
            new_ids, new = best(keys[None, lo:hi], score.T, self.k)
            ids, scores = np.concatenate([self.ids, new_ids], 1), np.concatenate([self.scores, new], 1)
            order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
            self.ids, self.scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def found(self) -> pa.RecordBatch:
        q, c = np.nonzero(self.scores > 0)
        return pa.RecordBatch.from_arrays([pa.array(self.query[q]), pa.array(self.ids[q, c]), pa.array(self.scores[q, c])], names=["query_id", "key", "score"])


def ranked(docs: DataFrame, queries: DataFrame, k: int, fields: dict[str, float], key: str = "doc_id", normaliser=log_length, analyser: Callable[[], Analyser] = simple, block_questions: int = BLOCK_QUESTIONS, row_bytes: int = ROW_BLOCK_BYTES) -> DataFrame:
    """``query_id, key, score, rank``: the ``k`` best documents of each of ``queries(query_id, terms)``.

    ``fields``: column to weight. Score: the weights of all occurrences of the query's terms over
    ``normaliser`` of the number of tokens; ranks go by ``DIGITS`` digits, six are shown. A query
    without terms has no rows. Where ``docs`` has scope_type and scope_conv and ``queries`` has
    q_conv, a query sees the corpus and its own conversation's attachments. Rows without a key take
    no part. ``terms`` must have come from the same analyser as the documents.
    """
    scoped = "scope_type" in docs.columns
    asked = queries.where(F.size("terms") > 0).select(F.col("query_id").alias("query"), "terms", (F.col("q_conv") if scoped else F.lit(None)).cast("bigint").alias("conv"))
    n, terms = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    scope = [F.col("scope_type").alias("kind"), F.col("scope_conv").cast("bigint").alias("own")] if scoped else []
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), *[F.col(f).alias(f"text_{i}") for i, f in enumerate(fields)], *scope)
    blocks = max(-(-n // block_questions), -(-terms // BLOCK_TERMS))
    weight = sum((F.coalesce(F.octet_length(f"text_{i}"), F.lit(0)).cast("bigint") for i in range(len(fields))), F.lit(0))
    out = met(asked, rows, lambda q: Best(q, k, fields, scoped, normaliser, analyser), "query_id bigint, key bigint, score double", blocks, weight, row_bytes)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), (F.round("score", 6)).alias("score"), "rank")
