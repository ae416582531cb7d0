"""A stated set of queries against all rows, block by block.

Queries that fill one block are broadcast and the rows stay where they are. More are dealt to blocks
by a hash, as are the rows, and every two blocks meet in a task. Neither the driver's memory nor the
plan grows with the number of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_workers


class Block(Protocol):
    """A block of queries that rows pass by."""

    def meet(self, rows: pa.RecordBatch) -> None: ...

    def found(self) -> pa.RecordBatch: ...


Make = Callable[[pa.Table], Block]


def _broadcast(queries, make: Make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = make(queries.value)
        for b in batches:
            block.meet(b)
        yield block.found()

    return run


def _meetings(make: Make, ours: list[str], theirs: list[str]):
    """Rows come sorted by meeting, queries first: these are held, the others pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for b in batches:
            key = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("__qb", "__rb", "__side")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                here = tuple(key[:2, lo].tolist())
                if here != at:
                    if block is not None:
                        yield block.found()
                    at, held, block = here, [], None
                names = theirs if key[2, lo] else ours
                part = pa.RecordBatch.from_arrays([b.slice(lo, hi - lo).column(b.schema.get_field_index(f"__{'r' if key[2, lo] else 'q'}_{n}")) for n in names], names=names)
                if not key[2, lo]:
                    held.append(part)
                elif held:
                    block = block or make(pa.Table.from_batches(held))
                    block.meet(part)
        if block is not None:
            yield block.found()

    return run


def met(queries: DataFrame, rows: DataFrame, make: Make, schema: str, blocks: int, row_weight: Column, row_block: int) -> DataFrame:
    """What ``make(queries of a block)`` finds among ``rows``, block by block; ``schema`` of its rows.

    ``blocks``: of queries; ``row_weight`` of a row, ``row_block`` of a block of them (about)."""
    spark = rows.sparkSession
    ensure_workers(spark)
    if blocks <= 1:
        held = spark.sparkContext.broadcast(queries.toArrow())  # one block: its size is bounded
        return rows.mapInArrow(_broadcast(held, make), schema)
    row_blocks = max(1, -(-int(rows.agg(F.coalesce(F.sum(row_weight), F.lit(0))).first()[0]) // row_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ours = queries.select(F.lit(0).alias("__side"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("__qb"), every(row_blocks).alias("__rb"), *[F.col(c).alias(f"__q_{c}") for c in queries.columns])
    theirs = rows.select("*", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(row_blocks)).cast("int").alias("__rb")).select(F.lit(1).alias("__side"), every(blocks).alias("__qb"), "__rb", *[F.col(c).alias(f"__r_{c}") for c in rows.columns])
    both = ours.unionByName(theirs, allowMissingColumns=True).repartition("__qb", "__rb").sortWithinPartitions("__qb", "__rb", "__side")
    return both.mapInArrow(_meetings(make, queries.columns, rows.columns), schema)
