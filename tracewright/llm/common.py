"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import scratch, shared_dir, written  # noqa: F401

BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def parts(df: DataFrame) -> int:
    """Shuffle partitions set for this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Rows that pass to Python together, set to ``BATCH_ROWS`` where the session has Spark's own 10,000, which whole documents make too much for small executors."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) == 10_000:
        spark.conf.set(name, str(BATCH_ROWS))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written within passes to Python in batches of so many rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterator[pd.DataFrame], text_col: str = "text", chars: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """The same rows in order, in frames of some ``chars`` characters (or one row), so that what a task makes of them stays small."""
    for b in batches:
        first = size = 0
        for i, text in enumerate(b[text_col]):
            size += len(text) if text else 0
            if size >= chars:
                yield b.iloc[first : i + 1]
                first, size = i + 1, 0
        if first < len(b):
            yield b.iloc[first:]
