"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import written

#: Edges that are contracted together.
CONTRACT_ROWS = 200_000


def contracted(u: pd.Series, v: pd.Series) -> pd.DataFrame:
    """Stars that join what the edges join: each node (u) with the least that these edges reach from it (v)."""
    codes, nodes = pd.factorize(pd.concat([u, v], ignore_index=True), sort=True)
    a, b = codes[: len(u)], codes[len(u) :]
    label, nodes = np.arange(len(nodes)), np.asarray(nodes)
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while ((up := label[label]) != label).any():
            label = up
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pd.DataFrame({"u": nodes[moved], "v": nodes[label[moved]]})


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows >= CONTRACT_ROWS:
            yield contracted(*(pd.concat([x[c] for x in held], ignore_index=True) for c in ("u", "v")))
            held, rows = [], 0
    if rows:
        yield contracted(*(pd.concat([x[c] for x in held], ignore_index=True) for c in ("u", "v")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node with an edge to a lesser one has just that edge, and none leads to such a node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    return ends.groupBy("node").agg(F.sum("out").alias("n"), F.min("out").alias("least")).where("n > 1 or n > least").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; the root is the least node of the component.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in MapReduce and Beyond"
    (2014), each a group-by with partial minima and a join, until all edges lead to roots. Edges that lie together in a
    task are first contracted there, which leaves few rounds. Edges with a null end are ignored; a node that is only joined
    to itself is its own root.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = ends.where("u = v").select("u").distinct()
    joined = ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if isinstance(kind := joined.schema["u"].dataType, T.IntegralType) or kind == T.StringType():  # pandas has their order
        joined = joined.mapInPandas(_contracted, joined.schema)
    now = written(joined.distinct(), "edges")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "edges")
    rooted = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("root"))
    return rooted.unionByName(roots).unionByName(alone.join(rooted.unionByName(roots), "node", "left_anti"))
