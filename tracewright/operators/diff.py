"""Differences between two versions of a table of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(before: DataFrame, after: DataFrame, key: Sequence[str], kind: str) -> DataFrame:
    """(kind, added, removed, changed) by a full outer join on the key; kinds without a difference are left out."""
    pack = lambda df, side: df.select(*key, F.struct(*sorted(c for c in df.columns if c not in key)).alias(side), F.col(kind).alias(f"__{side}"))
    both = pack(before, "old").join(pack(after, "new"), list(key), "full_outer")
    what = F.when(F.col("__old").isNull() & F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    marked = both.select(F.coalesce("__new", "__old").alias("kind"), what.alias("what")).where("what is not null")
    count = lambda w: F.count(F.when(F.col("what") == w, 1)).alias(w)
    return marked.groupBy("kind").agg(count("added"), count("removed"), count("changed"))


def multiset(before: DataFrame, after: DataFrame, kind: str) -> DataFrame:
    """(kind, added, removed) by counts of equal records: as many copies as one side has more."""
    cols = before.columns
    counts = before.select(*cols, F.lit(-1).alias("n")).unionByName(after.select(*cols, F.lit(1).alias("n"))).groupBy(*cols).agg(F.sum("n").alias("n")).where("n <> 0")
    return counts.groupBy(F.col(kind).alias("kind")).agg(F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))
