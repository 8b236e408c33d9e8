"""The corpus pipeline: each stage works on the documents that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import bpe, common, decontam, langid, minhash, secrets

STAGES = [
    ("language_id", langid.stage),
    ("near_dedup", minhash.stage),
    ("decontamination", decontam.stage),
    ("secret_scan", secrets.stage),
    ("bpe", bpe.stage),
]

#: SQL cannot express the models, sketches and tokens of the stages; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
