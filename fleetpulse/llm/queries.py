"""The registered queries of these operators, and the SQL of those that SQL can express."""

from fleetpulse.llm import (
    byte_bpe, decontamination, divergence, manifest, packing, private_data, quality, rules, secrets, simhash, substrings,
    token_counts, toxicity,
)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_secrets": secrets.op2_secrets,
    "op3_quality_rules": rules.op3_quality_rules,
    "op4_substrings": substrings.op4_substrings,
    "op5_packing": packing.op5_packing,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_simhash": simhash.op7_simhash,
    "op8_quality": quality.op8_quality,
    "op9_private_data": private_data.op9_private_data,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_divergence": divergence.op11_divergence,
    "op12_manifest": manifest.op12_manifest,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}
ORACLES = {
    "op6_decontamination": decontamination.SQL,
    "op11_divergence": divergence.SQL,
    "op12_manifest": manifest.SQL,
}
