"""The registered queries of this package and their SQL."""

from __future__ import annotations

from . import binary, decontaminate, jaccard_join, language, licenses, merkle, packing, quality, shards, spelling, suffix_dedup, toxicity, urls

Q = {
    "op1_url_filters": urls.op1_url_filters,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_sharding": shards.op7_sharding,
    "op8_token_binary": binary.op8_token_binary,
    "op9_license_scans": licenses.op9_license_scans,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_language_id": language.op13_language_id,
}

SQL = {"op2_jaccard_join": jaccard_join.SQL, "op5_quality_rules": quality.SQL, "op6_decontamination": decontaminate.SQL,
       "op11_merkle_manifest": merkle.SQL, "op12_spelling_variants": spelling.SQL}
