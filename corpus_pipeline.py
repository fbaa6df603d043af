"""The corpus pipeline: documents in, tokens out, in stages that each work on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reckon.llm import queries
from reckon.llm.common import read_table, through_store

STAGES = [
    ("language_id", queries.stage_language_id),
    ("simhash_dedup", queries.stage_simhash),
    ("decontamination", queries.stage_decontaminate),
    ("pii", queries.stage_pii),
    ("byte_bpe", queries.stage_bpe),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage's rows are written as Parquet into the
    shared folder and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = through_store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
