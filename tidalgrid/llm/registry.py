"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tidalgrid.llm import decontaminate, fingerprints, jaccard, licenses, lines, pieces, repeats, search, sketches, token_store, toxicity, url_filter, whitening

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_pieces": pieces.op2_pieces,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_licenses": licenses.op4_licenses,
    "op5_token_files": token_store.op5_token_files,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_repeats": repeats.op9_repeats,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_search": search.op11_search,
    "op12_whitening": whitening.op12_whitening,
    "op13_sketches": sketches.op13_sketches,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op3_line_dedup": lines.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op11_search": search.ORACLE,
    "op13_sketches": sketches.ORACLE,
}
