"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import (
    op1_shards,
    op2_jaccard,
    op3_leaks,
    op4_languages,
    op5_urls,
    op6_pieces,
    op7_substrings,
    op8_html,
    op9_warc,
    op10_quality,
)

QUERIES = {
    "op1_shards": op1_shards.query,
    "op2_jaccard": op2_jaccard.query,
    "op3_leaks": op3_leaks.query,
    "op4_languages": op4_languages.query,
    "op5_urls": op5_urls.query,
    "op6_pieces": op6_pieces.query,
    "op7_substrings": op7_substrings.query,
    "op8_html": op8_html.query,
    "op9_warc": op9_warc.query,
    "op10_quality": op10_quality.query,
}

ORACLES = {
    "op2_jaccard": op2_jaccard.ORACLE,
    "op5_urls": op5_urls.ORACLE,
    "op7_substrings": op7_substrings.ORACLE,
    "op9_warc": op9_warc.ORACLE,
}
