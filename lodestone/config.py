"""Settings that bear on results, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 3000
    chunk_overlap: int = 200
    max_upload_mb: int = 200
    max_chat_upload_mb: int = 5
    inline_limit_kib: int = 20
    inline_warning_kib: int = 40
    top_k: int = 5
    vector_candidates: int = 25
    keyword_candidates: int = 75
    neighbor_window: int = 0
    max_context_chars: int = 40_000
    rerank_batch: int = 32
    diagnostic_depth: int = 50
    prompt_warning_tokens: int = 14_000
    embedding_dim: int = 768


DEFAULTS = Settings()
