"""Integrity checks: each is a table of (check, item, message); a report is their union."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def found(rows: DataFrame, check: str, item: str | Column, message: str | Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), (F.col(item) if isinstance(item, str) else item).cast("string").alias("item"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def missing(rows: DataFrame, others: DataFrame, on: Sequence[str], check: str, item: str, message: str) -> DataFrame:
    """Rows that refer to nothing."""
    return found(rows.join(others.select(*on).distinct(), list(on), "left_anti"), check, item, message)


def wrong_count(owners: DataFrame, members: DataFrame, on: str, stated: Column, check: str) -> DataFrame:
    """Owners whose stated number of members is not the number there is."""
    n = members.groupBy(on).agg(F.count("*").alias("__n"))
    joined = owners.join(n, on, "left").withColumn("__n", F.coalesce("__n", F.lit(0))).where(stated != F.col("__n"))
    return found(joined, check, on, F.concat(F.lit("states "), stated.cast("string"), F.lit(", has "), F.col("__n").cast("string")))


def repeated(rows: DataFrame, key: str, check: str) -> DataFrame:
    """Keys that occur more than once."""
    return found(rows.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1"), check, key, F.concat(F.lit("occurs "), F.col("__n").cast("string"), F.lit(" times")))


def report(checks: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
