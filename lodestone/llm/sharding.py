"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, id, row number), so that equal texts lie together. A
size-weighted sample of keys gives quantile boundaries, rows are range-partitioned by them, and a
range found overfull by exact counts is subdivided by a sample of its own. Exact totals of the
ranges then give each row its place in the whole order, and so its shard and slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import discard, ensure_workers, materialise

SHARDS = 40
#: Ranges per shard that the first boundaries aim at, and sampled keys per range.
RANGES_PER_SHARD, KEYS_PER_RANGE = 4, 24
#: More ranges are made where they would else hold more rows than this on average.
ROWS_PER_RANGE = 4_000_000
#: A range of more than this many times the mean, in bytes or in rows, is subdivided.
OVERFULL = 2.0
ROW_COST = 16
KEY = ["h", "id", "uid"]


def _splitters(sample: list, parts: int) -> list[tuple]:
    """Boundaries at the size quantiles of a sample that was itself drawn by size: equal steps."""
    keys = sorted((tuple(r[k] for k in KEY) for r in sample), key=lambda t: (t[0], t[1], t[2]))
    cuts = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
    return sorted(set(cuts))


def range_of(cuts: list[tuple], h: np.ndarray, i: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many boundaries are not above each key."""
    if not cuts:
        return np.zeros(len(h), np.int64)
    ch, ci, cu = (np.array([c[k] for c in cuts], np.int64) for k in range(3))
    out = np.searchsorted(ch, h, "left")
    tied = np.flatnonzero(out < np.searchsorted(ch, h, "right"))
    if len(tied):  # boundaries inside a run of equal texts
        for c in np.flatnonzero(np.isin(ch, np.unique(h[tied]))):
            same = tied[h[tied] == ch[c]]
            out[same] += (i[same] > ci[c]) | ((i[same] == ci[c]) & (u[same] >= cu[c]))
    return out


def _ranged(rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = range_of(cuts, *(b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in KEY))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r.astype(np.int32))], names=[*names, "range"])

    return rows.mapInArrow(tk.lean(run), T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType())]))


def _chance(rate, seed: int):
    """Condition that holds for a row with probability ``rate``, decided by its key."""
    return F.pmod(F.xxhash64(F.lit(seed), *KEY), F.lit(1 << 53)) / F.lit(float(1 << 53)) < rate


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``; total sizes of shards differ
    by about one document at most, whatever one key's share of the rows.

    ``size``: UTF-8 bytes of the text plus 16. Null texts have no bytes and the CRC of none; null
    ids come first among equal texts; equal rows stay in order of reading. An empty table gives an
    empty result; shards that no row reaches stay empty.
    """
    ensure_workers(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_COST).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("bigint").alias("id"))
    rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "keys")  # written, so row numbers hold
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = max(shards * RANGES_PER_SHARD, -(-count // ROWS_PER_RANGE))
    # about as many keys as asked for: small beside the rows, whatever their number
    drawn = rows.where(_chance(F.col("size") * F.lit(parts * KEYS_PER_RANGE / max(total, 1)), 1)).select(*KEY).collect()
    cuts = _splitters(drawn, parts)
    ranged = _ranged(rows, cuts)
    part = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    full = part.where((F.col("bytes") > OVERFULL * total / parts) | (F.col("rows") > OVERFULL * count / parts)).collect()
    if full:  # at most 2 * parts / OVERFULL of them; drawn by rows, as a range may hold many small ones
        pieces = {r["range"]: max(2, r["bytes"] * parts // max(total, 1), r["rows"] * parts // max(count, 1)) for r in full}
        rate = F.create_map(*[F.lit(x) for r in full for x in (r["range"], pieces[r["range"]] * KEYS_PER_RANGE / r["rows"])])
        inner: dict[int, list] = {}
        for k in ranged.where(_chance(F.try_element_at(rate, F.col("range")), 2)).select("range", *KEY).collect():
            inner.setdefault(k["range"], []).append(k)
        cuts = sorted({*cuts, *(c for r, keys in inner.items() for c in _splitters(keys, pieces[r]))})
    ranged = materialise(_ranged(rows, cuts), "ranges")
    discard(rows)
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges, a fixed number
    totals = totals.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"))
    upto = Window.partitionBy("range").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.select("*", F.sum("size").over(upto).alias("b"), F.count("*").over(upto).alias("n")).join(F.broadcast(totals), "range")
    # a row belongs where its middle lies
    middle = F.col("bytes0") + F.col("b") - F.expr("(size + 1) div 2")
    placed = placed.select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.lit(max(total, 1)))).cast("int").alias("shard"), (F.col("rows0") + F.col("n") - 1).alias("place"))
    placed = materialise(placed, "placed")
    start = placed.groupBy("shard").agg(F.min("place").alias("start"))
    return placed.join(F.broadcast(start), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("start")).alias("slot"))


def report(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
