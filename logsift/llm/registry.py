"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import ann, chat_format, fertility, line_dedup, packing, piece_table, sentencepiece_lattice, simhash, substring_dedup, suffix_tree_lm, toxicity, warc, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_fertility": fertility.op2_quality_fertility,
    "op3_sentencepiece": sentencepiece_lattice.op3_sentencepiece,
    "op6_chat_formatting": chat_format.op6_chat_formatting,
    "op8_nearest_neighbours": ann.op8_nearest_neighbours,
    "op9_warc_revisits": warc.op9_warc_revisits,
    "op7_toxicity": toxicity.op7_toxicity,
    "op4_packing": packing.op4_packing,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_suffix_tree_lm": suffix_tree_lm.op12_suffix_tree_lm,
    "op13_fill_in_middle": piece_table.op13_fill_in_middle,
}

ORACLES = {
    "op6_chat_formatting": chat_format.OP6_SQL,
    "op9_warc_revisits": warc.OP9_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op13_fill_in_middle": piece_table.OP13_SQL,
}
