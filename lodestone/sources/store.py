"""Sinks: the corpus as partitioned tables, reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..session import materialise


def write_corpus(documents: DataFrame, chunks: DataFrame, root: str) -> None:
    """Replace the partitions of the sources that come; other sources stay. Chunks go first: a
    document whose write failed leaves chunks that no reader joins, never a document without any."""
    bound = chunks.join(documents.select("id", "source"), chunks.document_id == documents.id, "inner").drop("id")
    for rows, name in ((bound, "chunks"), (schema.checked(documents), "documents")):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{root}/{name}")


def upsert_corpus(documents: DataFrame, chunks: DataFrame, root: str) -> None:
    """Documents that come take the place of those of equal id, with all their chunks; others of
    their sources stay, and so do other sources. Where nothing is stored, all is new.

    The next state of the sources is written aside before it replaces them: a failure in between
    loses nothing. Columns that only the store has go, those that only come are null before.
    """
    spark = documents.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/documents")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        # schemas are given, so that a source named 01 is not read as a number
        had = spark.read.schema(documents.schema).parquet(f"{root}/documents")
        had_chunks = spark.read.schema(T.StructType([*chunks.schema.fields, T.StructField("source", T.StringType())])).parquet(f"{root}/chunks")
        sources, ids = documents.select(F.col("source").alias("__source")).distinct(), documents.select(F.col("id").alias("__id")).distinct()

        def stay(rows: DataFrame, key: str) -> DataFrame:
            theirs = rows.join(sources, F.col("source").eqNullSafe(F.col("__source")), "left_semi")
            return theirs.join(ids, F.col(key) == F.col("__id"), "left_anti")

        documents = materialise(documents.unionByName(stay(had, "id")), "documents")
        chunks = materialise(chunks.unionByName(stay(had_chunks, "document_id").select(*chunks.columns)), "chunks")
    write_corpus(documents, chunks, root)


def read_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/documents"), spark.read.parquet(f"{root}/chunks")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
