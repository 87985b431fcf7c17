"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from notes_engine.llm import exact_dedup, license_scan, mixing, ngram_join, packing, quality_rules, secret_scan, target_resampling, token_counts, token_files, toxicity, vector_codes, weighted_fingerprints

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_mixing": mixing.op4_mixing,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_packing": packing.op6_packing,
    "op7_token_files": token_files.op7_token_files,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_weighted_fingerprints": weighted_fingerprints.op11_weighted_fingerprints,
    "op12_target_resampling": target_resampling.op12_target_resampling,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLES = {
    "op2_license_scan": license_scan.ORACLE_SQL,
    "op5_ngram_join": ngram_join.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
    "op12_target_resampling": target_resampling.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
