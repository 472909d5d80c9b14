"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bit_slices, bpe, packing, quality_classifier, quality_rules, secrets, sharding, simhash, suffix_dedup, toxicity

QUERIES = {f.__name__: f for f in (
    secrets.op1_secret_scans, suffix_dedup.op2_suffix_dedup, packing.op3_best_fit_packing, sharding.op4_sharding,
    bpe.op5_byte_bpe, bit_slices.op6_bit_sliced_top_k, toxicity.op7_toxicity,
    simhash.op8_simhash, quality_rules.op9_quality_rules, quality_classifier.op10_quality_classifier,
)}
#: The others cannot be stated in SQL: they fit models, repack bins, or need hashes that SQL engines lack.
ORACLES: dict[str, str] = {"op6_bit_sliced_top_k": bit_slices.ORACLE_SQL}
