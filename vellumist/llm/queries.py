"""Queries of this subpackage by name, and their SQL where there is any."""

from . import language, maxent, private, quality, search, similar, tokens, warc

QUERIES = {
    "op1_bm25_top_k": search.op1_bm25_top_k,
    "op2_kneser_ney_quality": quality.op2_kneser_ney_quality,
    "op3_parity_sketch_join": similar.op3_parity_sketch_join,
    "op4_anchor_expansion": private.op4_anchor_expansion,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_warc_normaliser": warc.op6_warc_normaliser,
    "op7_bpe_round_trip": tokens.op7_bpe_round_trip,
    "op8_recurrent_language_id": language.op8_recurrent_language_id,
    "op9_cost_balanced_packing": tokens.op9_cost_balanced_packing,
    "op10_maxent_scores": maxent.op10_maxent_scores,
}
SQL: dict[str, str] = {"op1_bm25_top_k": search.SQL_OP1, "op3_parity_sketch_join": similar.SQL_OP3, "op6_warc_normaliser": warc.SQL_OP6}
