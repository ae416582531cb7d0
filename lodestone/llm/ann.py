"""Nearest neighbours by a block matrix join.

Queries come in blocks of fixed size, candidates in the batches of their partitions. A tile, the
product of both sides' int8 codes, gives every cosine with a bound on its quantisation error. Pairs
whose upper bound falls short of the query's k-th best lower bound are dropped, the others are
recomputed in double precision on the original vectors, and bounded heaps merge the tiles.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import ensure_workers

K = 5
QUERY_BLOCK_BYTES = 8 << 20
CANDIDATE_BLOCK_BYTES = 128 << 20
TILE_ROWS = 4096


class Side:
    """Vectors of one width: originals in double, int8 codes, and what the codes leave out."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.norm = np.sqrt((x * x).sum(1))
        unit = x / self.norm[:, None]
        self.scale = np.abs(unit).max(1) / 127
        self.code = np.rint(unit / self.scale[:, None]).astype(np.int8)
        approx = self.code * self.scale[:, None]
        self.left = np.sqrt(((unit - approx) ** 2).sum(1))
        self.size = np.sqrt((approx**2).sum(1))


def sound(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        n = (x * x).sum(1)
        return np.isfinite(x).all(1) & (n > 0) & np.isfinite(n)


def cosine(a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray) -> np.ndarray:
    return (a * b).sum(1) / (an * bn)


def tile(q: Side, c: Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, cosine) of every pair that may be among a query's k nearest here."""
    # products of int8 codes stay whole numbers far below 2**24 or 2**53, so floats hold them exactly
    kind = np.float32 if q.x.shape[1] <= 1024 else np.float64
    dot = (q.code.astype(kind) @ c.code.astype(kind).T).astype(np.float64)
    dot *= q.scale[:, None] * c.scale[None, :]
    # |u.v - u'.v'| <= |u - u'| |v| + |u'| |v - v'|, units on the left; a little for rounding
    error = q.left[:, None] + q.size[:, None] * c.left[None, :] + 1e-9
    low = dot - error
    if low.shape[1] > k:
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
    else:
        floor = np.full(len(low), -np.inf)
    i, j = np.nonzero(dot + error >= floor[:, None])
    s = np.empty(len(i))
    for lo in range(0, len(i), 1 << 15):
        p = slice(lo, lo + (1 << 15))
        s[p] = cosine(q.x[i[p]], q.norm[i[p]], c.x[j[p]], c.norm[j[p]])
    return i, j, s


def first_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows that can matter: of equal vectors the k of least id, as ties go to these."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((ids, *x.T[::-1]))
    new = np.concatenate(([True], (x[order[1:]] != x[order[:-1]]).any(1)))
    rank = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.sort(order[rank < k])


def _vectors(batch: pa.RecordBatch, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sound vectors of a batch by width: ids and values."""
    ids = batch.column(batch.schema.get_field_index("vec_id"))
    col = batch.column(batch.schema.get_field_index(name))
    size = np.where(col.is_valid().to_numpy(False) & ids.is_valid().to_numpy(False), pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False), 0)
    out = {}
    for width in np.unique(size[size > 0]).tolist():
        own = pa.array(size == width)
        flat = col.filter(own).flatten()
        x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        i = ids.filter(own).to_numpy(zero_copy_only=False).astype(np.int64)
        ok = sound(x)
        if ok.any():
            out[width] = (i[ok], x[ok])
    return out


class Heaps:
    """The k nearest of every query so far: greatest score, then least id. ``own`` marks rows that
    equal the query's, id and vector."""

    def __init__(self, k: int):
        self.k, self.of = k, defaultdict(list)

    def push(self, query: int, score: float, vec: int, own: bool) -> None:
        h = self.of[query]
        item = (score, -vec, own)
        if len(h) < self.k:
            heapq.heappush(h, item)
        elif item > h[0]:
            heapq.heapreplace(h, item)

    def rows(self) -> pa.RecordBatch:
        flat = [(q, -v, s, o) for q, h in self.of.items() for s, v, o in h]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate(kinds)], names=["query_id", "vec_id", "score", "own"])


FOUND = "query_id bigint, vec_id bigint, score double, own boolean"


class Block:
    """A block of queries and what was found for them."""

    def __init__(self, ids: list[np.ndarray], vectors: list[np.ndarray], k: int):
        """``k``: one more than asked for, as one row may be the query's own."""
        by: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for i, x in zip(ids, vectors, strict=True):
            by[x.shape[1]][0].append(i)
            by[x.shape[1]][1].append(x)
        self.sides = {w: [Side(i[at : at + 512], x[at : at + 512]) for at in range(0, len(i), 512)] for w, (i, x) in ((w, (np.concatenate(i), np.concatenate(x))) for w, (i, x) in by.items())}
        self.k, self.heaps = k, Heaps(k)

    def meet(self, batch: pa.RecordBatch, name: str) -> None:
        for width, (ids, x) in _vectors(batch, name).items():
            if width not in self.sides:
                continue
            keep = first_copies(ids, x, self.k)
            ids, x = ids[keep], x[keep]
            for lo in range(0, len(ids), TILE_ROWS):
                c = Side(ids[lo : lo + TILE_ROWS], x[lo : lo + TILE_ROWS])
                for q in self.sides[width]:
                    i, j, s = tile(q, c, self.k)
                    own = q.ids[i] == c.ids[j]
                    own[own] = (q.x[i[own]] == c.x[j[own]]).all(1)
                    for row in zip(q.ids[i].tolist(), s.tolist(), c.ids[j].tolist(), own.tolist(), strict=True):
                        self.heaps.push(*row)


def _against(queries, k: int, name: str):
    """Candidates against one broadcast block of (id, vector) queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block([np.array([i], np.int64) for i, _ in queries.value], [np.frombuffer(v, np.float64)[None, :] for _, v in queries.value], k)
        for b in batches:
            block.meet(b, name)
        yield block.heaps.rows()

    return run


def _meetings(k: int):
    """Rows come sorted by meeting (a block of either side), queries first: these are held, the
    candidates pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, block = None, [], [], None
        for b in batches:
            key = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("qb", "cb", "side")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                part, here = b.slice(lo, hi - lo), tuple(key[:2, lo].tolist())
                if here != at:
                    if block is not None:
                        yield block.heaps.rows()
                    at, ids, vectors, block = here, [], [], None
                if key[2, lo] == 0:
                    for i, x in _vectors(part, "v").values():
                        ids.append(i)
                        vectors.append(x)
                elif ids:
                    block = block or Block(ids, vectors, k)
                    block.meet(part, "v")
        if block is not None:
            yield block.heaps.rows()

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(k + 1)
        for b in batches:
            for row in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("query_id", "score", "vec_id", "own")), strict=True):
                heaps.push(*row)
        out = []
        for q, h in heaps.of.items():
            best = sorted(h, reverse=True)
            own = next((x for x in best if x[2]), None)
            if own is not None:
                best.remove(own)
            out += [(q, r + 1, -v, s) for r, (s, v, _) in enumerate(best[:k])]
        kinds = (("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return run


def _sound(column: str):
    """Rows with an id and a vector that :func:`sound` takes."""
    v = F.transform(column, lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return F.col("vec_id").isNotNull() & F.coalesce(whole & (square > 0) & (square < float("inf")), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, column: str = "embedding", block_bytes: int = QUERY_BLOCK_BYTES, candidate_bytes: int = CANDIDATE_BLOCK_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of ``vectors`` for every id of
    ``queries`` by cosine in double precision, ties to the smaller id; the query's own row is left
    out. Exact: a bound, not a sample, decides what is recomputed.

    Queries that fill one block of ``block_bytes`` are broadcast and the candidates stay where they
    are. More are dealt to blocks, as are the candidates (of ``candidate_bytes``), and every two
    blocks meet in a task: nothing but numbers of bytes reaches the driver, and the plan is the same
    for any number of queries. A task holds one block of queries, candidates pass by.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    id, take no part; vectors meet those of their own width only. Of several queries of one id the
    one of least vector counts; other rows of its id, and further rows equal to it, are candidates.
    """
    spark = vectors.sparkSession
    ensure_workers(spark)
    values = F.transform(column, lambda x: x.cast("double"))
    asked = queries.where(_sound(column)).groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min(values).alias("v"))
    bytes_of = lambda df: df.agg(F.coalesce(F.sum(F.greatest(F.size(column), F.lit(0)).cast("bigint") * 8), F.lit(0))).first()[0]
    size = bytes_of(queries.where(_sound(column)))
    if size <= block_bytes:
        block = spark.sparkContext.broadcast([(r.vec_id, np.array(r.v, np.float64).tobytes()) for r in asked.collect()])
        found = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), column).mapInArrow(tk.lean(_against(block, k + 1, column)), FOUND)
    else:
        qbs, cbs = -(-size // block_bytes), max(1, -(-bytes_of(vectors) // candidate_bytes))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        ours = asked.select(F.lit(0).alias("side"), F.pmod(F.xxhash64("vec_id"), F.lit(qbs)).cast("int").alias("qb"), every(cbs).alias("cb"), "vec_id", "v")
        dealt = vectors.where(_sound(column)).select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cbs)).cast("int").alias("cb"), F.col("vec_id").cast("bigint").alias("vec_id"), values.alias("v"))
        theirs = dealt.select(F.lit(1).alias("side"), every(qbs).alias("qb"), "cb", "vec_id", "v")
        met = ours.unionByName(theirs).repartition("qb", "cb").sortWithinPartitions("qb", "cb", "side")
        found = met.mapInArrow(tk.lean(_meetings(k + 1)), FOUND)
    return found.repartition("query_id").mapInArrow(tk.lean(_merge(k)), "query_id bigint, rank int, vec_id bigint, score double")


def report(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
