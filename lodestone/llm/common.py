"""Shared plumbing: durable intermediate tables, connected components, clashing names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_workers, shared_dir, table

__all__ = ["components", "discard", "discard_since", "ensure_workers", "in_few_files", "looked_up", "materialise", "may_have", "new_path", "packed", "shared_dir", "sieved", "table", "unclashing", "unpacked", "written"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_WRITTEN: list[str] = []


def written() -> int:
    """A mark for :func:`discard_since`."""
    return len(_WRITTEN)


def discard_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Delete all tables that :func:`materialise` made after the mark, but for ``keep``."""
    kept = getattr(keep, "_lodestone_path", None)
    for path in [p for p in _WRITTEN[mark:] if p != kept]:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    _WRITTEN.append(path)
    return out


#: Bytes of the input to a file of a table made from it, about.
FILE_BYTES = 128 << 20
#: The same for tables that are about as large as what they are made from.
PAIR_BYTES = 8 << 20


def in_few_files(rows: DataFrame, source: DataFrame, file_bytes: int | None = None) -> DataFrame:
    """``rows``, made from the ``source``, dealt evenly to a partition for each ``file_bytes`` of it
    (``FILE_BYTES``, for rows that are small beside it), if these are fewer than those of a shuffle.

    For each file that it writes to a local disk Hadoop starts three programs (chmod), and until it
    runs each of them shares all the memory of the executor, and may be counted as if it had as much."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = max(1, -(-size // (file_bytes or FILE_BYTES)))
    return rows.repartition(files) if files < int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that nothing will read again."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        _remove(df.sparkSession, path)


#: A key is hot if it has more than this many rows and more than one in ``HOT_KEYS`` of all rows; so
#: there are fewer than ``HOT_KEYS`` of them, and a table of them may be broadcast.
HOT_ROWS, HOT_KEYS = 256, 1000


def looked_up(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, total: int, most: int) -> DataFrame:
    """The inner join of ``rows`` with ``lookup`` (unique ``keys``) in which no key is hot.

    ``weight``: a column of ``lookup``, the number of rows with its key, and ``most`` the greatest;
    ``total``: of all rows, or a stated fraction of them. Rows of hot keys meet their partners by
    broadcast and stay where they are, all others by a shuffle. ``rows`` and ``lookup`` are then read
    twice, so they should be written tables."""
    least = max(HOT_ROWS, total // HOT_KEYS)
    if most <= least:
        return rows.join(lookup, keys)
    hot = F.broadcast(lookup.where(F.col(weight) > least))
    rest = lookup.where(F.col(weight) <= least)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys))


#: Bits of a sieve at most, 8 MB in all, whatever the input; and bytes in one of its rows.
SIEVE_BITS, SIEVE_BYTES = 1 << 26, 256


def sieved(rows: DataFrame, wanted: DataFrame, key: str, n: int, flag: str = "__may") -> DataFrame:
    """``rows`` with a ``flag``: whether a row of ``wanted`` may have its ``key`` (a 64-bit hash, not
    null); where it is false none has. A bitmap of fixed size is broadcast, so that few rows without
    a partner go into a shuffle. ``n``: number of wanted keys; beyond a sixteenth of ``SIEVE_BITS``
    more and more others are flagged, and a join must follow in any case."""
    bits = min(SIEVE_BITS, 1 << max(15, (16 * n).bit_length()))
    place = lambda: F.pmod(F.col(key), F.lit(bits))
    at = F.bitmap_bit_position(place() + 1)
    maps = wanted.select(place().alias("p")).groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("map"))
    chunks = F.explode(F.sequence(F.lit(0), F.lit(4096 // SIEVE_BYTES - 1)))
    maps = maps.select("bucket", "map", chunks.alias("chunk")).select(F.col("bucket").alias("__bucket"), F.col("chunk").alias("__chunk"), F.substring("map", F.col("chunk") * SIEVE_BYTES + 1, F.lit(SIEVE_BYTES)).alias("__map"))
    width = 8 * SIEVE_BYTES
    asked = rows.withColumns({"__bucket": F.bitmap_bucket_number(place() + 1), "__chunk": F.floor(at / width).cast("int"), "__bit": F.pmod(at, F.lit(width)).cast("int")})
    byte = F.conv(F.hex(F.substring("__map", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(__byte, pmod(__bit, 8)) & 1 = 1"), F.lit(False))
    found = asked.join(F.broadcast(maps), ["__bucket", "__chunk"], "left").withColumn("__byte", byte)
    return found.select(*rows.columns, hit.alias(flag))


def may_have(rows: DataFrame, wanted: DataFrame, key: str, n: int) -> DataFrame:
    """The rows that :func:`sieved` flags."""
    return sieved(rows, wanted, key, n).where("__may").drop("__may")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``.

    Returns ``node, component`` where component is the least node of its component; nodes without
    an edge do not appear. Alternates large-star and small-star steps (Kiveris et al. 2014) until
    the edge set is a forest of stars; each round is one written table, so nothing is gathered on
    the driver, and the hub of a large star is looked up by broadcast.
    """
    put = lambda e, name: materialise(in_few_files(e, edges, PAIR_BYTES), name)  # noqa: E731  of no more rows than edges and nodes
    cur = put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = state(cur)
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is hung on the least of its neighbourhood
        near = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        most = near.groupBy("a").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        large = looked_up(near.where("b > a"), least, ["a"], "n", seen[0], most).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = put(large.where("a <> b").distinct(), "stars")
        # small star: every smaller neighbour of a node, and the node, is hung on the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        # a node has no more rows here than neighbours before
        small = looked_up(large, least, ["a"], "n", seen[0], most).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        nxt = put(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(cur)
        discard(large)
        cur, before, seen = nxt, seen, state(nxt)
        if before == seen:
            break
    else:
        raise RuntimeError("connected components did not settle")
    hubs = cur.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(hubs)


def unclashing(columns: list[str], *added: str) -> list[str]:
    """``columns`` without those that bear the name of an added one, in either case: these give way."""
    taken = {a.lower() for a in added}
    return [c for c in columns if c.lower() not in taken]


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` as its ``needed`` columns and one struct of all the rest, so that no other column's
    name can clash with one that an operator adds."""
    rest = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__rest") if rest else F.lit(0).alias("__rest"))


def unpacked(out: DataFrame, columns: list[str], *needed: str, **new) -> DataFrame:
    """The columns of before, in their order, from a frame that :func:`packed` began; ``new``
    replaces some of them."""
    own = lambda c: F.col(c) if c in needed else F.col("__rest").getField(c)
    return out.select(*[new.get(c, own(c)).alias(c) for c in columns])
