"""Relations of the platform and checks that files cannot enforce themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCUMENTS = "id string, source string, title string, source_type string, conversation_id string, created_at timestamp, metadata map<string,string>"
CHUNKS = "document_id string, chunk_index int, content string, embedding array<float>, metadata map<string,string>, created_at timestamp"
CONVERSATIONS = "id string, title string, created_at timestamp, updated_at timestamp, metadata map<string,string>"
SOURCE = "chunk_id string, document_id string, content_preview string, chunk_index int"
MESSAGES = f"id string, conversation_id string, role string, content string, model_used string, sources array<struct<{', '.join(c.replace(' ', ': ', 1) for c in SOURCE.split(', '))}>>, created_at timestamp, metadata map<string,string>"
INLINE_ATTACHMENTS = "id string, conversation_id string, filename string, mime_type string, text_content string, size_bytes bigint, created_at timestamp"
LISTING = "file_id string, name string, mime_type string, parents array<string>, owner_email string, last_modified string, size_bytes bigint"


def scope_violations(documents: DataFrame) -> DataFrame:
    """Rows that break the rule: corpus documents have no conversation, attachments have one."""
    corpus = (F.col("source_type") == "corpus") & F.col("conversation_id").isNull()
    attached = (F.col("source_type") == "attachment") & F.col("conversation_id").isNotNull()
    return documents.where(~F.coalesce(corpus | attached, F.lit(False)))


def width_violations(chunks: DataFrame, width: int) -> DataFrame:
    """Chunks whose embedding is present and not of the given width."""
    return chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") != width))


def checked(documents: DataFrame) -> DataFrame:
    """``documents``, or an error that names how many rows break the scope rule."""
    bad = scope_violations(documents).count()
    if bad:
        raise ValueError(f"{bad} documents have a source type that does not fit their conversation")
    return documents


def document_key(source, source_id):
    """A key that is the same on every ingest."""
    return F.sha2(F.concat_ws("\x1f", source, source_id), 256)
