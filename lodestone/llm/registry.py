"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import apportionment, chat_grammar, chebyshev_whitening, compression_rules, context_mixing, html_crf, language_tree, line_spread, multi_index_negatives, qgram_decontam, simhash_ball, substring_buckets, wavelet_tokens

QUERIES = {
    "op1_wavelet": wavelet_tokens.op1_wavelet,
    "op2_context_mixing": context_mixing.op2_context_mixing,
    "op3_compression_bands": compression_rules.op3_compression_bands,
    "op4_language_tree": language_tree.op4_language_tree,
    "op5_chat_grammar": chat_grammar.op5_chat_grammar,
    "op6_apportionment": apportionment.op6_apportionment,
    "op7_qgram_lemma": qgram_decontam.op7_qgram_lemma,
    "op8_bucket_pointer": substring_buckets.op8_bucket_pointer,
    "op9_simhash": simhash_ball.op9_simhash,
    "op10_line_spread": line_spread.op10_line_spread,
    "op11_chebyshev_whitening": chebyshev_whitening.op11_chebyshev_whitening,
    "op12_multi_index": multi_index_negatives.op12_multi_index,
    "op13_html_crf": html_crf.op13_html_crf,
}
ORACLES = {"op5_chat_grammar": chat_grammar.ORACLE_SQL, "op10_line_spread": line_spread.ORACLE_SQL, "op12_multi_index": multi_index_negatives.ORACLE_SQL}
