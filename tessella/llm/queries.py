"""The numbered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from tessella.llm import compression, decontaminate, katz, licenses, mixing, near_dedup, phrases, quality_rules, secret_scan, shuffle, suffixes, toxicity, whitening

QUERIES = {
    "op1_katz_scores": katz.op1_katz_scores,
    "op2_compression_quality": compression.op2_compression_quality,
    "op3_deep_shallow_repeats": suffixes.op3_deep_shallow_repeats,
    "op4_risk_controlled_rules": quality_rules.op4_risk_controlled_rules,
    "op5_feistel_shards": shuffle.op5_feistel_shards,
    "op6_deobfuscated_toxicity": toxicity.op6_deobfuscated_toxicity,
    "op7_latent_leaks": decontaminate.op7_latent_leaks,
    "op8_hash_threshold_mix": mixing.op8_hash_threshold_mix,
    "op9_dice_licenses": licenses.op9_dice_licenses,
    "op10_sketch_near_duplicates": near_dedup.op10_sketch_near_duplicates,
    "op11_refined_whitening": whitening.op11_refined_whitening,
    "op12_network_secrets": secret_scan.op12_network_secrets,
    "op13_rabin_karp_phrases": phrases.op13_rabin_karp_phrases,
}
SQL = {
    "op5_feistel_shards": shuffle.op5_sql(),
    "op8_hash_threshold_mix": mixing.OP8_SQL,
    "op9_dice_licenses": licenses.op9_sql(),
    "op13_rabin_karp_phrases": phrases.OP13_SQL,
}
