"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from eddystream.llm import cap_filters, chat, link_graph, mixing, ngram_join, packing, quality, stable_knn, suffix_dedup, warc

#: query, module, name of its SQL there.
_ALL = (
    ("op1_link_graph", link_graph, "OP1_SQL"),
    ("op2_best_fit_packing", packing, None),
    ("op3_warc_archive", warc, None),
    ("op4_chat_perspectives", chat, "OP4_SQL"),
    ("op5_quality_classifier", quality, None),
    ("op6_mix_sources", mixing, "OP6_SQL"),
    ("op7_suffix_dedup", suffix_dedup, None),
    ("op8_stable_projections", stable_knn, None),
    ("op9_cap_filters", cap_filters, None),
    ("op10_ngram_join", ngram_join, None),
)


def queries() -> dict[str, Callable]:
    return {q: getattr(m, q) for q, m, _ in _ALL}


def oracle_sql() -> dict[str, str]:
    return {q: getattr(m, s) for q, m, s in _ALL if s}
