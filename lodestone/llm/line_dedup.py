"""Line deduplication over levelled sorted runs of line hashes, in DataFrame functions alone.

Documents arrive in batches, the largest ids first. A batch's line keys merge-anti-join the runs:
keys that no run holds are new, their last holder lies in this batch; keys that a run holds add to
a count. Both go into the batch's own sorted run. When a level has ``FANOUT`` runs they are merged
into one of the next level. After the last batch the runs tell, for every key, in how many
documents it is and which of these has the largest id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, looked_up, materialise, packed, sieved, unpacked

MIN_LENGTH, MIN_DOCS = 20, 3
BATCHES, FANOUT = 4, 2
# Fixed value: the characters that a key is stripped of.
STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def _hash(x: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), x), F.xxhash64(F.lit(2), x)]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class Runs:
    """The levelled store: rows ``k1, k2`` (128-bit key hash, sorted), ``n`` documents, ``last`` id."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def all(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        return reduce(DataFrame.union, runs) if runs else None

    def discard(self) -> None:
        for level in self.levels:
            for run in level:
                discard(run)
        self.levels = []

    def add(self, batch: DataFrame) -> None:
        """``batch(k1, k2, doc)``: distinct keys of documents that no earlier batch had."""
        own = batch.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc").alias("last"))
        held = self.all()
        if held is not None:
            own = materialise(own, "batch")
            known = held.select("k1", "k2").hint("merge")
            fresh = own.join(known, ["k1", "k2"], "left_anti")
            again = own.join(known, ["k1", "k2"], "left_semi").withColumn("last", F.lit(None).cast("bigint"))
            run = self._written(fresh.unionByName(again))
            discard(own)
        else:
            run = self._written(own)
        self._place(run, 0)

    def _written(self, rows: DataFrame) -> DataFrame:
        return materialise(rows.select("k1", "k2", "n", "last").repartition("k1", "k2").sortWithinPartitions("k1", "k2"), "run")

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self.levels[level] = []
            self._place(self._written(merged(reduce(DataFrame.union, old))), level + 1)
            for r in old:
                discard(r)


def merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def _row_hash() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(F.lit(3), text).alias("t1"), F.xxhash64(F.lit(4), text).alias("t2")]


def dropped_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``doc, t1, t2`` (which name a text of a document), ``drop``: one flag per line, for the texts
    that lose a line."""
    line = F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("bigint").alias("doc"), *_row_hash(), "text").select("doc", "t1", "t2", line)
    rows = rows.select("doc", "t1", "t2", "pos", line_key(F.col("line")).alias("key"))
    k1, k2 = _hash(F.col("key"))
    rows = materialise(rows.select("doc", "t1", "t2", "pos", (F.length("key") >= min_length).alias("long"), k1.alias("k1"), k2.alias("k2")), "lines")
    long = rows.where("long")
    # batches of equal row counts by id, from quantiles of the ids
    cuts = rows.where("pos = 0").approxQuantile("doc", [i / batches for i in range(1, batches)], 0.01)
    bounds = sorted({int(c) for c in cuts}, reverse=True)
    n_long = long.count()
    runs = Runs()
    upper = None
    for lower in [*bounds, None]:
        part = long if lower is None else long.where(F.col("doc") > lower)
        part = part if upper is None else part.where(F.col("doc") <= upper)
        runs.add(part.select("k1", "k2", "doc").distinct())
        upper = lower
    common = materialise(merged(runs.all()).where(F.col("n") >= min_docs).select("k1", "k2", "last", "n"), "common")
    most = common.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    # a line of very many documents is looked up by broadcast; n is the number of its documents
    hits = looked_up(long, common, ["k1", "k2"], "n", n_long, most).where("doc < last").select("doc", "t1", "t2", "pos")
    # flags of every line of the texts concerned, in order
    flags = materialise(hits.groupBy("doc", "t1", "t2").agg(F.collect_set("pos").alias("gone")), "flags")
    runs.discard()
    discard(common)
    discard(rows)
    return flags


def dedup(docs: DataFrame, **limits: int) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the text that is left in ``kept``; columns of these
    names give way, no other name clashes.

    A line's key is the line stripped and with A-Z lower-cased; keys of at least ``min_length`` code
    points found in ``min_docs`` documents or more lose their lines except in the document of
    largest id. A null or empty text is one empty line. Rows of one id are one document; rows with a
    null id count as one document below all others. A text that loses every line becomes empty.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept")]
    gone = dropped_lines(docs.select("doc_id", "text"), **limits)
    t1, t2 = _row_hash()
    left = packed(docs.select(*names), "doc_id", "text").withColumns({"__doc": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("bigint"), "__t1": t1, "__t2": t2})
    # documents that a sieve clears lose no line and need no join: only the others are shuffled
    flagged = sieved(left, gone.select(F.col("t1").alias("__t1")), "__t1", gone.count())
    clear, left = flagged.where("not __may"), flagged.where("__may")
    hit = left.join(gone, (left["__doc"] == gone["doc"]) & (left["__t1"] == gone["t1"]) & (left["__t2"] == gone["t2"]), "left").drop("doc", "t1", "t2")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)

    def shown(rows: DataFrame, n_dropped: Column, kept: Column) -> DataFrame:
        own = [F.size(lines).cast("bigint").alias("n_lines"), n_dropped.cast("bigint").alias("n_dropped"), kept.alias("kept")]
        return rows.select(*[(F.col(c) if c in ("doc_id", "text") else F.col("__rest").getField(c)).alias(c) for c in names], *own)

    some = F.when(F.col("gone").isNull(), text).otherwise(kept_lines(lines, F.col("gone")))
    return shown(hit, F.coalesce(F.size("gone"), F.lit(0)), some).unionByName(shown(clear, F.lit(0), text))


def kept_lines(lines: Column, gone: Column) -> Column:
    """Lines whose positions are not in ``gone``; a flag per line keeps the work linear."""
    n = F.size(lines)
    # positions sorted with their gaps give runs of kept lines, each a slice
    ends = F.concat(F.array_sort(gone), F.array(n))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.array_sort(gone), lambda p: p + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))))
    return F.array_join(F.flatten(runs), "\n")


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines gone from the text, and ``n_chars`` brought up to date."""
    out = dedup(packed(docs, "doc_id", "text"))
    # the struct of other columns is packed once more inside, and comes back as it was
    new = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return unpacked(out, docs.columns, "doc_id", "text", **new)
