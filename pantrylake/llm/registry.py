"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, digest, itq, langid, mixing, packing, pii, secret_scan, simhash, store
from .common import table


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_itq_near_dedup": _over("embeddings", itq.op1),
        "op2_mixture_packing": _over("documents", packing.op2),
        "op3_temperature_mixing": _over("documents", mixing.op3),
        "op4_secret_scan": _over("documents", secret_scan.op4),
        "op5_feistel_pseudonyms": _over("documents", pii.op5),
        "op6_chat_windows": _over("conversations", chat.op6),
        "op7_ppm_language_id": _over("documents", langid.op7),
        "op8_content_store": _over("documents", store.op8),
        "op9_simhash_near_dedup": _over("documents", simhash.op9),
        "op10_canonical_digest": _over("documents", digest.op10),
    }


def oracle_sql() -> dict[str, str]:
    return {}
