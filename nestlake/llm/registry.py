"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, bwt_dedup, exact_dedup, license_scan, mixing, near_dedup, sharding, toxicity, url_rules

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = (
        url_rules.op1_url_rules,
        audio.op2_audio_features,
        toxicity.op3_toxicity_grammar,
        mixing.op4_pfair_mix,
        bpe.op5_byte_bpe,
        sharding.op6_hilbert_shards,
        exact_dedup.op7_exact_dedup,
        bwt_dedup.op8_column_bwt,
        license_scan.op9_license_scan,
        near_dedup.op10_tensored_minhash,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_pfair_mix": mixing.ORACLE,
        "op6_hilbert_shards": sharding.ORACLE,
        "op7_exact_dedup": exact_dedup.ORACLE,
        "op8_column_bwt": bwt_dedup.ORACLE,
        "op9_license_scan": license_scan.oracle(),
        "op10_tensored_minhash": near_dedup.ORACLE,
    }
