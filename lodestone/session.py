"""Worker set-up, the shared folder, and tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of a batch sent to a Python worker, so that long texts do not pile up in one.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: What Spark has where nobody chose.
DEFAULTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": "67108864b"}


def _chosen(spark: SparkSession) -> set[str]:
    """Settings of ARROW that the session's owner made: they stand."""
    own = {k for k in ARROW if spark.sparkContext.getConf().get(k) is not None}
    return own | {k for k in ARROW if spark.conf.get(k) not in (ARROW[k], DEFAULTS[k], None)}


def ensure_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when it runs from a source tree, and bound what they get."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    for key, value in ARROW.items():
        if key not in _chosen(spark):
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the setting is absent, one of our own, gone at exit, if
    driver and workers are one machine's; else an error, as other machines couldn't see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = "file://" + own
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, whoever reads it and
    whatever is lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
