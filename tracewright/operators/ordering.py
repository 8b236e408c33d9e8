"""Positions in a total order, without one partition that holds everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import written


def global_rank(rows: DataFrame, order: Sequence[str | Column], into: str = "rank") -> DataFrame:
    """``rows`` with their place, from 1, in ``order`` (which should decide between any two rows).

    Rows are dealt out by ranges of the order; a partition's places follow the sizes of those before it.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = rows.select("*", *(k.alias(f"__k{i}") for i, k in enumerate(keys)))
    names = [f"__k{i}" for i in range(len(keys))]
    dealt = written(keyed.repartitionByRange(*names).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(W.partitionBy("__part").orderBy(*names))
    ranked = dealt.withColumn("__nth", nth).join(sizes.select("__part", before.alias("__before")), "__part")
    return ranked.withColumn(into, F.col("__before") + F.col("__nth")).drop(*names, "__part", "__nth", "__before")


def dense_rank_of(rows: DataFrame, keys: Sequence[str], into: str = "rank") -> DataFrame:
    """Dense rank by ``keys``: the place among the distinct ones, joined back."""
    return rows.join(global_rank(rows.select(*keys).distinct(), keys, into), list(keys))


def chain_positions(links: DataFrame, node: str = "node", after: str = "after") -> DataFrame:
    """(node, position, length) in linked lists: each row points to its predecessor, a head to null.

    Pointer doubling: after k rounds a row knows the row 2**k places before it, so a list of n takes log2(n) joins.
    Rows that have reached their head stay out of the joins, where their nulls would all meet in one task. Rows on a cycle never reach a head; they are given position null.
    """
    now = written(links.select(F.col(node).alias("node"), F.col(after).alias("far"), F.when(F.col(after).isNull(), 0).otherwise(1).cast("long").alias("hops")), "chain")
    limit = max(1, now.count()).bit_length() + 1
    for _ in range(limit):
        ahead = now.where("far is not null")
        if ahead.isEmpty():
            break
        side = now.select(F.col("node").alias("far"), F.col("far").alias("__far"), F.col("hops").alias("__hops"))
        moved = ahead.join(side, "far", "left").select("node", F.col("__far").alias("far"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"))
        now = written(moved.unionByName(now.where("far is null")), "chain")
    return now.select("node", F.when(F.col("far").isNull(), F.col("hops")).alias("position"))
