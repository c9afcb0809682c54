"""The queries of the training-data operators and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from loomtext.llm import bpe_automaton, html_extract, iblt, language, lexical, licenses, packing, quality, simhash, substring, url_lists, vector_codes, warc

QUERIES: dict[str, Callable] = {
    "op1_warc_transactions": warc.op1_warc_transactions,
    "op2_html_tree_scoring": html_extract.op2_html_tree_scoring,
    "op3_simhash_golay": simhash.op3_simhash_golay,
    "op4_packing": packing.op4_packing,
    "op5_url_temporal_lists": url_lists.op5_url_temporal_lists,
    "op6_quality_ngram_lr": quality.op6_quality_ngram_lr,
    "op7_bpe_automaton": bpe_automaton.op7_bpe_automaton,
    "op8_language_mixture": language.op8_language_mixture,
    "op9_iblt_fingerprints": iblt.op9_iblt_fingerprints,
    "op10_substring_countmin": substring.op10_substring_countmin,
    "op11_license_automaton": licenses.op11_license_automaton,
    "op12_ranked_search": lexical.op12_ranked_search,
    "op13_annular_codes": vector_codes.op13_annular_codes,
}
ORACLE_SQL: dict[str, str] = {
    "op1_warc_transactions": warc.OP1_SQL,
    "op5_url_temporal_lists": url_lists.OP5_SQL,
    "op12_ranked_search": lexical.OP12_SQL,
    "op13_annular_codes": vector_codes.OP13_SQL,
}
