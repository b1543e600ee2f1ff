"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ["repetition", "packing", "decontaminate", "toxicity", "quality", "html_text", "warc", "ngram_join", "line_dedup", "quotation"]


def _loaded():
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _loaded() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in _loaded() for k, f in getattr(m, "ORACLES", {}).items()}
