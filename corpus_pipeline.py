"""A corpus pipeline: language ID, near-duplicates, pseudonyms, mixing and packing, each over what the one before kept.

STAGES holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents; the last returns the packed pieces (doc_id, start, length, ids_crc32, doc_tokens,
sequence_id, offset). Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pantrylake.llm import langid, mixing, packing, pii, simhash
from pantrylake.llm.common import drop_path, staged_at, table

#: SQL has no counterpart of context trees, SimHash or a vocabulary's ids; tests hold run() against plain Python.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return langid.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format."""
    return pii.pseudonymised(docs, pii.session_key(spark))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources repeated until the token weights meet the repetition limit."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Full windows at the mixture's proportions."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_each),
    ("pseudonyms", without_personal_data),
    ("mixing", to_target_weights),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again, and what it read is dropped then."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = staged_at(stage(spark, docs, sf_dir), name)
        if read is not None:
            drop_path(spark, read)
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)
