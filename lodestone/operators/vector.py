"""Exact cosine top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .meet import met

QUERY_BLOCK_BYTES = 8 << 20
ROW_BLOCK_BYTES = 128 << 20
#: Rows of a tile and bytes of its vectors, and of their distances from as many queries: a worker's
#: memory is a few of these, however many queries a block has.
TILE_ROWS = 4096
TILE_BYTES = 8 << 20
#: Distances that agree to so many digits are ties; more is the noise of doubles.
DIGITS = 12
#: More than rounding to these moves a distance.
SLACK = 1e-11


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a null or zero vector."""
    norm = F.nullif(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(0.0))
    return F.lit(1.0) - _dot(a, b) / norm


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)


def topk_one(chunks: DataFrame, query: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, distance`` of the ``k`` chunks nearest to a one-row ``query(vector)``; nulls last, ties by key."""
    q = F.broadcast(query.select(F.col(vector).alias("__q")).limit(1))  # one row
    d = chunks.crossJoin(q).select(key, rounded(cosine_distance(F.col(vector), F.col("__q")), DIGITS).alias("distance"))
    return d.orderBy(F.col("distance").asc_nulls_last(), key).limit(k).select(key, rounded(F.col("distance")).alias("distance"))


class Nearest:
    """Queries of one block (query, vector, conv), all of one width, and the k nearest keys of each."""

    def __init__(self, queries: pa.Table, k: int, scoped: bool):
        self.k, self.scoped = k, scoped
        queries = queries.combine_chunks()
        vectors = queries.column("vector").combine_chunks()
        qid, conv = (queries.column(n).fill_null(-1).to_numpy().astype(np.int64) for n in ("query", "conv"))
        size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        self.by: dict[int, tuple] = {}
        for width in set(size.tolist()):
            own = np.flatnonzero(size == width)
            q = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            self.by[width] = (qid[own], q / np.linalg.norm(q, axis=1, keepdims=True), conv[own], np.zeros((len(own), k), np.int64), np.full((len(own), k), np.inf))

    def meet(self, b: pa.RecordBatch) -> None:
        col = lambda n: b.column(b.schema.get_field_index(n))
        vectors, keys = col("vector"), col("key").to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.where(vectors.is_valid().to_numpy(False), pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False), 0)
        if self.scoped:
            kind, own = np.array(col("kind").to_pylist(), object), np.array(col("own").to_pylist(), object)
        for width, (_, q, conv, ids, dist) in self.by.items():
            at = np.flatnonzero(size == width)
            step = max(1, min(TILE_ROWS, TILE_BYTES // (8 * width)))
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                x = vectors.take(pa.array(part)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                n = np.linalg.norm(x, axis=1)
                ok = (n > 0) & np.isfinite(n)
                x, part = x[ok] / n[ok, None], part[ok]
                if not len(part):
                    continue
                some = max(1, TILE_BYTES // (8 * len(part)))
                for first in range(0, len(q), some):
                    here = slice(first, first + some)
                    near = q[here] @ x.T
                    np.subtract(1, near, out=near)
                    if self.scoped:
                        near[~((kind[part] == "corpus")[None, :] | ((kind[part] == "attachment")[None, :] & (own[part][None, :] == conv[here, None])))] = np.inf
                    self._keep(near, keys[part], ids[here], dist[here])

    def _keep(self, near: np.ndarray, keys: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        """Put a tile's distances into the best of its queries, in place. Only what may be among these is
        rounded and sorted: as near as the last of them, or as the tile's own k-th."""
        k, last = self.k, dist[:, -1]
        if near.shape[1] > k and np.isinf(last).any():
            last = np.fmin(last, np.partition(near, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(near <= np.minimum(last + SLACK, np.finfo(np.float64).max)[:, None])
        if not len(i):
            return
        d, key = np.round(near[i, j], DIGITS), keys[j]
        touched = np.unique(i)
        i = np.concatenate([np.repeat(touched, k), i])
        d, key = np.concatenate([dist[touched].ravel(), d]), np.concatenate([ids[touched].ravel(), key])
        order = np.lexsort((key, d, i))
        starts = np.flatnonzero(np.diff(i[order], prepend=-1))  # every query brings k of its own
        best = order[(starts[:, None] + np.arange(k)).ravel()]
        ids[touched], dist[touched] = key[best].reshape(-1, k), d[best].reshape(-1, k)

    def found(self) -> pa.RecordBatch:
        parts = [(np.repeat(qid, self.k)[at], ids.ravel()[at], dist.ravel()[at] + 0.0) for qid, _, _, ids, dist in self.by.values() for at in [np.flatnonzero(np.isfinite(dist))]]
        cols = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "key", "distance"])


def topk_batch(chunks: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "vec_id", vector: str = "embedding", block_bytes: int = QUERY_BLOCK_BYTES, row_bytes: int = ROW_BLOCK_BYTES) -> DataFrame:
    """``query_id, key, distance, rank``: the ``k`` nearest chunks of every query, ranked by distances
    of ``DIGITS`` digits; six are shown.

    Blocks of queries meet blocks of chunks (see :mod:`.meet`), each keeps its own ``k`` per query, a
    window keeps the best of these. Null and zero vectors take no part; vectors meet those of their
    width. Where ``chunks`` has scope_type and scope_conv and ``queries`` has q_conv, a query sees the
    corpus and its own conversation's attachments.
    """
    scoped = "scope_type" in chunks.columns
    conv = (F.col("q_conv") if scoped else F.lit(None)).cast("bigint").alias("conv")
    v = F.transform(vector, lambda x: x.cast("double"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).cast("bigint").alias("query"), v.alias("vector"), conv).where(F.coalesce(_dot(F.col("vector"), F.col("vector")) > 0, F.lit(False)))
    bytes_of = F.size("vector").cast("bigint") * 8
    size = asked.agg(F.coalesce(F.sum(bytes_of), F.lit(0))).first()[0]
    scope = [F.col("scope_type").alias("kind"), F.col("scope_conv").cast("bigint").alias("own")] if scoped else []
    rows = chunks.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("vector"), *scope)
    out = met(asked, rows, lambda q: Nearest(q, k, scoped), "query_id bigint, key bigint, distance double", -(-size // block_bytes), bytes_of, row_bytes)
    w = Window.partitionBy("query_id").orderBy("distance", "key")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("distance", rounded(F.col("distance")))
