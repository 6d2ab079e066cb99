"""The queries of this folder and their SQL twins."""

from __future__ import annotations

from ledgerloom.llm import (
    ann,
    attention,
    chat_format,
    line_dedup,
    mixing,
    packing,
    quality_rules,
    resampling,
    simhash,
    structure,
    tokens,
    toxicity,
    warc,
)

QUERIES = {
    "op1_learned_partitions": ann.nearest_vectors,
    "op2_token_blocks": tokens.token_files,
    "op3_best_fit_packing": packing.packing,
    "op4_simhash_components": simhash.simhash_components,
    "op5_quality_rules": quality_rules.quality_rules,
    "op6_toxicity": toxicity.toxicity,
    "op7_fuzzy_lines": line_dedup.fuzzy_lines,
    "op8_source_mixing": mixing.mixing,
    "op9_warc_fixity": warc.fixity,
    "op10_attention_quality": attention.quality,
    "op11_grammar_round_trip": chat_format.chat_formatting,
    "op12_importance_resampling": resampling.importance_resampling,
    "op13_structure_repair": structure.structure_repair,
}

ORACLE_SQL = {
    "op8_source_mixing": mixing.MIXING_SQL,
    "op9_warc_fixity": warc.FIXITY_SQL,
    "op11_grammar_round_trip": chat_format.CHAT_SQL,
    "op12_importance_resampling": resampling.RESAMPLING_SQL,
    "op13_structure_repair": structure.STRUCTURE_SQL,
}
