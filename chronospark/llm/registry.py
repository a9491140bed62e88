"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import bpe, exact_dedup, jaccard, licenses, lm, merkle, packing, quality, sharding, substring_dedup, tiff, toxicity, vector_codes

QUERIES = {
    "op4_licenses": licenses.op4_licenses,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op5_jaccard": jaccard.op5_jaccard,
    "op10_lm": lm.op10_lm,
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_bpe": bpe.op2_bpe,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_tiff": tiff.op7_tiff,
    "op8_packing": packing.op8_packing,
    "op9_quality": quality.op9_quality,
    "op11_merkle": merkle.op11_merkle,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_sharding": sharding.op13_sharding,
}

ORACLE_SQL = {**exact_dedup.ORACLE, **jaccard.ORACLE, **vector_codes.ORACLE}
