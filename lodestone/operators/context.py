"""Context blocks for batches of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.context import JOIN


def label() -> F.Column:
    """The line above a chunk: its section, else its place, else nothing in particular."""
    place = F.concat(F.lit("  [Part "), F.col("position").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit("]"))
    known = (F.coalesce("position", F.lit(0)) != 0) & (F.coalesce("total", F.lit(0)) != 0)
    return F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit("  ["), F.col("section"), F.lit("]"))).when(known, place).otherwise(F.lit("  [Chunk]"))


def context_blocks(hits: DataFrame, inline: DataFrame | None = None, settings: Settings = DEFAULTS, strict_cap: bool = False) -> DataFrame:
    """``query_id, context``. ``hits(query_id, document_id, title, section, position, total, content)``
    are the few chunks that retrieval left for a question; ``inline(query_id, filename, text)`` go
    first and are exempt from the limit.

    Running totals of a document's texts are a window's; the texts within the limit are a filter on
    these, and what a question has spent is carried from document to document. By default the texts
    of a question's first document count twice, and its heading once, while no file stands before
    it; ``strict_cap`` counts every text once. A question without chunks and files has no row; a
    null title is an unknown document's, null contents are empty.
    """
    limit = F.lit(settings.max_context_chars).cast("bigint")
    order = [F.col(c).asc_nulls_first() for c in ("position", "title", "section", "total", "content")]
    own = Window.partitionBy("query_id", "document_id").orderBy(*order)
    text = F.concat(label(), F.lit("\n  "), F.coalesce("content", F.lit("")), F.lit("\n"))
    title = F.first("title").over(own)
    heading = F.concat(F.lit('From "'), F.coalesce(title, F.lit("Unknown Document")), F.lit('":\n'))
    rows = hits.select("query_id", "document_id", F.row_number().over(own).alias("at"), heading.alias("heading"), text.alias("text"), F.sum(F.length(text)).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
    each = F.struct("at", "text", "end", F.length("text").cast("bigint").alias("n"))
    documents = rows.groupBy("query_id", "document_id").agg(F.min("heading").alias("heading"), F.sort_array(F.collect_list(each)).alias("texts"))
    asked = documents.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("document_id", "heading", "texts"))).alias("d"))
    if inline is not None:
        file = F.concat(F.lit('From user-attached file "'), F.coalesce("filename", F.lit("")), F.lit('":\n'), F.coalesce("text", F.lit("")))
        files = inline.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("filename", "text", file.alias("shown")))), lambda x: x["shown"]).alias("files"))
        asked = asked.join(files, "query_id", "full")
    else:
        asked = asked.withColumn("files", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    asked = asked.select("query_id", F.coalesce("files", none).alias("files"), "d")

    def show(so_far, d):
        doubled = (F.size("files") == 0) & (F.size(so_far["shown"]) == 0) & F.lit(not strict_cap)
        kept = F.filter(d["texts"], lambda x: F.when(doubled, 2 * x["end"] - x["n"] + F.length(d["heading"])).otherwise(so_far["spent"] + x["end"]) <= limit)
        spent = so_far["spent"] + F.coalesce(F.array_max(F.transform(kept, lambda x: x["end"])), F.lit(0).cast("bigint"))
        block = F.concat(d["heading"], F.array_join(F.transform(kept, lambda x: x["text"]), ""))
        full = (F.size(so_far["shown"]) > 0) & (so_far["spent"] >= limit)
        return F.when(full, so_far).otherwise(F.struct(spent.alias("spent"), F.concat(so_far["shown"], F.array(block)).alias("shown")))

    start = F.struct(F.lit(0).cast("bigint").alias("spent"), none.alias("shown"))
    shown = F.coalesce(F.aggregate("d", start, show)["shown"], none)
    return asked.select("query_id", F.array_join(F.concat("files", shown), JOIN).alias("context"))
