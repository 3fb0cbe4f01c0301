"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ans_output, bpe, decontaminate, html_extract, ngram_join, substring_dedup, token_counts, topk, toxicity, url_rules

QUERIES = {
    "op1_ngram_join": ngram_join.query,
    "op2_url_filters": url_rules.query,
    "op3_token_output": ans_output.query,
    "op4_toxicity": toxicity.query,
    "op5_html_extraction": html_extract.query,
    "op6_bpe": bpe.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_token_counts": token_counts.query,
    "op9_decontaminate": decontaminate.query,
    "op10_topk": topk.query,
}

SQL = {
    "op2_url_filters": url_rules.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op10_topk": topk.SQL,
}
