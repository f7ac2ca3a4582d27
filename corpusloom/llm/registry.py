"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from corpusloom.llm import decontaminate, jaccard_join, language_id, near_groups, quality, sentencepiece_lattice, sharding, substring_dedup, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_ngram_jaccard_join": jaccard_join.op3_ngram_jaccard_join,
    "op4_warc": warc.op4_warc,
    "op5_sentencepiece": sentencepiece_lattice.op5_sentencepiece,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_sharding": sharding.op7_sharding,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_language_id": language_id.op10_language_id,
    "near_duplicate_members": near_groups.near_duplicate_members,
}
SQL = {
    "op1_suffix_array_dedup": suffix_dedup.SQL,
    "op2_quality_rules": quality.SQL,
    "op3_ngram_jaccard_join": jaccard_join.SQL,
    "op4_warc": warc.SQL,
    "op6_decontamination": decontaminate.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
}
