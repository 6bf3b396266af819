"""The queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import bpe, conversations, html_text, language_id, matroska, mixing, packing, quality, quality_model, simhash, suffix_dedup, token_counts, whitening

MODULES = (language_id, quality, token_counts, quality_model, matroska, packing, html_text, bpe, simhash, suffix_dedup, mixing, whitening, conversations)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
