"""Synchronisation as a stream: listings arrive as files, each batch is classified as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import sync


def run_available(spark: SparkSession, listings: DataFrame, stored: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Classify all that ``listings`` (a streaming frame) has now and return what lies in ``out``.

    Each batch is written under its own number, so a batch that is run again replaces its rows."""

    def batch(df: DataFrame, number: int) -> None:
        sync.actions(df, stored).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = listings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("file_id string, action string").parquet(out).select("file_id", "action")
