"""Taking files in: classify, chunk, embed; documents and chunks as one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import DEFAULTS, Settings
from ..functions import classify as cl
from ..operators import chunk, models
from ..sources import files as src


def plan(files: DataFrame, source: str, folder: str = "/", embedder: Callable[[], models.Embedder] = models.hashing_embedder, settings: Settings = DEFAULTS, parsers: Mapping[str, src.Parser] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of ``files(path, content)``, bytes or text; a file that gives no chunk is not stored."""
    meta = files.withColumns({"source": F.lit(source), "folder_path": F.lit(folder)})
    known = src.classified(meta, "source", "folder_path")
    key = schema.document_key(F.lit(source), F.col("path"))
    parts = chunk.chunk_files(known, settings, parsers)
    chunks = models.embedded(parts, "content", embedder).select(
        key.alias("document_id"), "chunk_index", "content", "embedding",
        F.create_map(F.lit("section"), "section", F.lit("ast_kind"), "kind", F.lit("ast_name"), "name", F.lit("element_types"), "element_type", F.lit("fallback_reason"), "fallback_reason", F.lit("total_chunks"), F.col("total").cast("string")).alias("metadata"),
    )
    counts = parts.groupBy("path").agg(F.count("*").alias("n"))
    documents = known.drop("content").join(counts, "path").select(
        key.alias("id"), F.lit(source).alias("source"), cl.file_name(F.col("path")).alias("title"), F.lit("corpus").alias("source_type"), F.lit(None).cast("string").alias("conversation_id"),
        F.create_map(F.lit("filetype"), cl.mime_of(F.col("format")), F.lit("original_filename"), cl.file_name(F.col("path")), F.lit("num_elements"), F.col("n").cast("string"), F.lit("format"), F.col("format"), F.lit("doc_type"), F.col("doc_type")).alias("metadata"),
    )
    return documents, chunks


def directory(spark: SparkSession, root: str, source: str, settings: Settings = DEFAULTS, parsers: Mapping[str, src.Parser] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, refused) of a directory; ``refused(path, reason)`` is the side output,
    with the prose files that have no parser, fail in theirs or give no text.

    Hidden and empty files are left out by Spark's own scan."""
    raw = src.read_files(spark, root)
    status = cl.upload_status(cl.file_name(F.col("path")), F.col("size_bytes"), settings=settings)
    judged = raw.withColumn("reason", F.when(F.lower("path").endswith(".tf.json") & (F.col("size_bytes") > 0), F.lit("ok")).otherwise(status))
    good = src.supported(judged.where("reason = 'ok'")).select("path", "content")
    documents, chunks = plan(good, source, settings=settings, parsers=parsers)
    prose = good.where(cl.format_of(F.col("path")) == "prose")
    return documents, chunks, judged.where("reason <> 'ok'").select("path", "reason").unionByName(src.unparsed(prose, parsers))
