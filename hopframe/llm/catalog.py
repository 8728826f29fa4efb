"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from hopframe.llm import fim, fingerprints, hard_negatives, html_extract, mixing, ngram_join, packing, pii, quality_rules, sharding, suffix_dedup, token_files, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1,
    "op2_packing": packing.op2,
    "op3_html_extraction": html_extract.op3,
    "op4_sharding": sharding.op4,
    "op5_suffix_dedup": suffix_dedup.op5,
    "op6_mixing": mixing.op6,
    "op7_token_files": token_files.op7,
    "op8_toxicity": toxicity.op8,
    "op9_quality_rules": quality_rules.op9,
    "op10_fingerprints": fingerprints.op10,
    "op11_fill_in_middle": fim.op11,
    "op12_hard_negatives": hard_negatives.op12,
    "op13_pii": pii.op13,
}
ORACLES = {
    "op6_mixing": mixing.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
    "op11_fill_in_middle": fim.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
}
