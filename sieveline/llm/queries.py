"""Driver queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from . import html, leaks, mixing, pii, quality, repeats, simhash, tokens, toxicity, urls

QUERIES = {
    "op1_token_counts": tokens.query,
    "op2_repeats": repeats.query,
    "op3_pii": pii.query,
    "op4_quality_rules": quality.query,
    "op5_url_filters": urls.query,
    "op6_simhash": simhash.query,
    "op7_html_text": html.query,
    "op8_mixing": mixing.query,
    "op9_leaks": leaks.query,
    "op10_toxicity": toxicity.query,
}

SQL = {
    "op2_repeats": repeats.sql(),
    "op4_quality_rules": quality.sql(),
    "op5_url_filters": urls.sql(),
    "op8_mixing": mixing.sql(),
}
