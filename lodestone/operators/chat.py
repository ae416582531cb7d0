"""Conversations, messages and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings

DEFAULT_TITLE = "New Chat"
TITLE_CHARS = 100


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """``conv_id, title, updated_at, n_messages``: every conversation, those without messages too, the
    one last changed first."""
    count = messages.groupBy("conv_id").agg(F.count("*").alias("n"))
    listed = conversations.join(count, "conv_id", "left").select("conv_id", "title", "updated_at", F.coalesce("n", F.lit(0)).alias("n_messages"))
    return listed.orderBy(F.col("updated_at").desc(), "conv_id")


def conversation_detail(messages: DataFrame) -> DataFrame:
    """Messages numbered in order of time."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages.select("conv_id", F.row_number().over(w).alias("pos"), "role", "text")


def auto_titles(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Titles after the first question: its beginning replaces the default title only."""
    first = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    new = F.substring("q", 1, TITLE_CHARS)
    return conversations.join(first, "conv_id", "left").withColumn("title", F.when((F.col("title") == DEFAULT_TITLE) & F.col("q").isNotNull(), new).otherwise(F.col("title"))).drop("q")


def renamed(conversations: DataFrame, names: DataFrame) -> DataFrame:
    """Conversations with the titles of ``names(conv_id, new_title, at)`` and their time of change."""
    return conversations.join(names, "conv_id", "left").withColumns({"title": F.coalesce("new_title", "title"), "updated_at": F.greatest("updated_at", "at")}).drop("new_title", "at")


def message_line() -> Column:
    return F.concat(F.when(F.col("role") == "user", F.lit("User: ")).otherwise(F.lit("Assistant: ")), F.coalesce("text", F.lit("")))


def history_blocks(messages: DataFrame) -> DataFrame:
    """``conv_id, history``: a conversation's messages as one text, ready for a prompt."""
    turns = F.sort_array(F.collect_list(F.struct("turn", message_line().alias("line"))))
    return messages.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.concat(F.lit("Previous conversation:\n"), F.array_join("t.line", "\n\n")).alias("history"))


def attachment_mode(text: Column, settings: Settings = DEFAULTS) -> Column:
    """``inline`` for texts of few bytes, else ``chunked``."""
    return F.when(F.octet_length(F.coalesce(text, F.lit(""))) <= settings.inline_limit_kib * 1024, F.lit("inline")).otherwise(F.lit("chunked"))


def attachments(docs: DataFrame) -> DataFrame:
    """``conversation_id, section, pos, doc_id, mode, size_bytes``: inline ones, then chunked ones,
    each in order. ``docs(doc_id, conversation_id, source_type, text)``."""
    mine = docs.where("source_type = 'attachment'").select("conversation_id", "doc_id", attachment_mode(F.col("text")).alias("mode"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size_bytes"))
    mine = mine.withColumn("section", F.when(F.col("mode") == "inline", 0).otherwise(1))
    w = Window.partitionBy("conversation_id", "section").orderBy("doc_id")
    return mine.select("conversation_id", "section", F.row_number().over(w).alias("pos"), "doc_id", "mode", "size_bytes")


def inline_sizes(attached: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Bytes of inline attachments by conversation and whether they are worth a warning."""
    total = attached.where("mode = 'inline'").groupBy("conversation_id").agg(F.sum("size_bytes").alias("inline_bytes"))
    return total.withColumn("warn", F.col("inline_bytes") > settings.inline_warning_kib * 1024)


def without(rows: DataFrame, gone: DataFrame, key: str, gone_key: str = "conv_id") -> DataFrame:
    """``rows`` but those whose key is gone."""
    names = gone.select(F.col(gone_key).alias("__gone")).distinct()
    return rows.join(names, rows[key] == names["__gone"], "left_anti")


def deleted(gone: DataFrame, conversations: DataFrame, messages: DataFrame, docs: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """What is left of each relation after ``gone(conv_id)`` are deleted. Chunks have no key that
    cascades: those of deleted attachments stay as ``orphans``."""
    left_docs = without(docs, gone, "conversation_id")
    return {
        "conversations": without(conversations, gone, "conv_id"),
        "messages": without(messages, gone, "conv_id"),
        "documents": left_docs,
        "chunks": chunks,
        "orphans": chunks.join(left_docs.select("doc_id"), "doc_id", "left_anti"),
    }
