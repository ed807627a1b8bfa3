"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from quillon.llm import ann, exact_dedup, html_extract, line_dedup, lm_scoring, mixing, near_dedup, packing, quality, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.best_fit_packing,
    "op2_line_dedup": line_dedup.line_dedup,
    "op3_lm_scoring": lm_scoring.lm_scoring,
    "op4_quality_classifier": quality.quality_classifier,
    "op5_html_extraction": html_extract.html_extraction,
    "op6_exact_dedup": exact_dedup.exact_dedup,
    "op7_ann": ann.ann,
    "op8_toxicity": toxicity.toxicity,
    "op9_near_dedup": near_dedup.near_dedup,
    "op10_mixing": mixing.mixing,
}

ORACLES = {
    "op2_line_dedup": line_dedup.SQL,
    "op3_lm_scoring": lm_scoring.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op10_mixing": mixing.SQL,
}
