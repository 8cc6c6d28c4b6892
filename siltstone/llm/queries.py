"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from siltstone.llm import flac, licenses, mixing, neardup, packing, pii, quality, sampling, secrets, suffixes

QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_mix_sources,
        neardup.op2_minhash_near_dedup,
        quality.op3_quality_resampling,
        secrets.op4_secret_ledger,
        pii.op5_pii_surrogates,
        flac.op6_flac_columns,
        packing.op7_best_fit_packing,
        suffixes.op8_suffix_dedup,
        sampling.op9_weighted_fingerprints,
        licenses.op10_license_digests,
    )
}
ORACLES = {"op1_mix_sources": mixing.ORACLE, "op2_minhash_near_dedup": neardup.ORACLE, "op4_secret_ledger": secrets.ORACLE, "op8_suffix_dedup": suffixes.ORACLE, "op10_license_digests": licenses.ORACLE}
