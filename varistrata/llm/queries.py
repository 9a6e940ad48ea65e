"""One query for each training-data operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from varistrata.llm import decontam, langid, media, merkle, mixing, neardup, oracles, quality, rules, secrets, sharding, tokens, toxicity, whitening
from varistrata.llm.common import bounded_batches


def _bounded(fn: Callable) -> Callable:
    @wraps(fn)
    def query(spark, sf_dir: str):
        bounded_batches(spark)
        return fn(spark, sf_dir)

    return query


QUERIES: dict[str, Callable] = {
    "op1_language_id": _bounded(langid.query),
    "op2_quality": _bounded(quality.query),
    "op3_toxicity": _bounded(toxicity.query),
    "op4_mixing": _bounded(mixing.query),
    "op5_token_counts": _bounded(tokens.query),
    "op6_secret_scan": _bounded(secrets.query),
    "op7_near_duplicates": _bounded(neardup.query),
    "op8_decontamination": _bounded(decontam.query),
    "op9_media": _bounded(media.query),
    "op10_sharding": _bounded(sharding.query),
    "op11_merkle_manifest": _bounded(merkle.query),
    "op12_whitening": _bounded(whitening.query),
    "op13_quality_rules": _bounded(rules.query),
}
#: Checksums, hashing and trained models have no SQL of DuckDB's; those operators are tested against brute force.
ORACLES: dict[str, str] = {"op7_near_duplicates": oracles.NEAR_DUPLICATES, "op8_decontamination": decontam.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op13_quality_rules": rules.ORACLE}
