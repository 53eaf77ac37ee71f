"""The subpackage's queries and SQL, by name."""

from __future__ import annotations

from importlib import import_module

#: query -> module that holds it; a module's SQL, where it has any, is the oracle of its query
_HOMES = {
    "op1_suffix_dedup": "suffix_dedup",
    "op2_chat_format": "chat",
    "op3_top_k": "topk",
    "op4_bpe": "bpe",
    "op5_near_dedup": "near_dedup",
    "op6_language_id": "langid",
    "op7_quality": "quality",
    "op8_exact_dedup": "exact_dedup",
    "op9_best_fit_packing": "packing",
    "op10_html_main_text": "html_main",
    "op11_pii": "pii",
    "op12_centroid_clusters": "centroids",
    "op13_spelling_variants": "variants",
}


def _modules():
    return {q: import_module(f"tidewater.llm.{m}") for q, m in _HOMES.items()}


def queries() -> dict:
    return {q: getattr(m, q) for q, m in _modules().items()}


def oracle_sql() -> dict[str, str]:
    return {q: m.SQL for q, m in _modules().items() if getattr(m, "SQL", None)}
