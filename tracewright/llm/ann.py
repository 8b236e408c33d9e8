"""Nearest neighbours by a block matrix join over int8 tiles, exact in the end.

Vectors are packed into tiles of some ``TILE_BYTES``; each query tile meets each candidate tile of its dimension once.
Within a pair, both sides are rounded to int8 by the tile's scale, and one integer matrix product gives all distances up
to the sum of the two rounding errors, which are known for each vector. Candidates whose least possible distance exceeds
the ``k``-th least greatest possible one are ruled out; the others' distances are computed from the original vectors in
double precision. A task reads each of its candidate tiles once for a pass of some ``PASS_BYTES`` of queries and keeps the
``k`` nearest so far of each, which also rule out; what the tasks found is merged by heaps, ``FAN_IN`` tasks at a time.

Defined results: vectors that are null, all zero, or hold null or non-finite components take no part, nor do null ids;
vectors of different dimensions are not compared; a query's candidates are the rows with another id; ties go to the
smaller id; repeated queries each get a result, repeated candidates may each appear; fewer than ``k`` candidates are all
returned; an empty table gives none; columns other than those named are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, table, written

K, TILE_BYTES, QUERY_ROWS, FAN_IN, STRIP = 10, 2 << 20, 1024, 64, 32
#: Bytes of queries that meet all candidates in one pass (they are broadcast), and pairs of tiles that go to Python together.
PASS_BYTES, BATCH_PAIRS = 32 << 20, 8


def usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def tiles(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (id, v, dim) as tiles (dim, tile, ids, vectors), ``n`` for each dimension."""

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        data = np.stack([np.asarray(v, dtype=np.float64) for v in group["v"]])
        return pd.DataFrame({"dim": [key[0]], "tile": [key[1]], "ids": [group["id"].to_numpy(np.int64).tobytes()], "vectors": [data.tobytes()]})

    dealt = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return dealt.groupBy("dim", "tile").applyInPandas(pack, "dim int, tile int, ids binary, vectors binary")


def rounded(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """int8 values, their scale, and each vector's rounding error with room for the arithmetic's own."""
    scale = float(np.abs(x).max()) / 127
    q = np.rint(x / scale).astype(np.int8)
    return q, scale, np.sqrt(((x - q * scale) ** 2).sum(1)) * (1 + 1e-9) + 1e-12 * scale


def nearest(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, bound: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, candidates' places, distances), at most ``k`` for each query, nearest first; none beyond the query's ``bound``."""
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # in which the integer products are exact
    (qi, qs, qe), (ci, cs, ce) = rounded(q), rounded(c)
    cf = ci.astype(kind).T
    q2, c2 = ((x.astype(np.float64) ** 2).sum(1) * s * s for x, s in ((qi, qs), (ci, cs)))
    for start in range(0, len(q), STRIP):
        at = slice(start, start + STRIP)
        dot = (qi[at].astype(kind) @ cf).astype(np.float64)
        about = np.sqrt(np.maximum(q2[at, None] + c2[None] - 2 * qs * cs * dot, 0))
        slack = (qe[at, None] + ce[None]) + 1e-7 * (np.sqrt(q2[at, None]) + np.sqrt(c2)[None])
        own = qid[at, None] == cid[None]
        upper = np.where(own, np.inf, about + slack)
        limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(upper), np.inf)
        alive = (about - slack <= np.minimum(limit, bound[at])[:, None]) & ~own
        for i in np.flatnonzero(alive.any(axis=1)).tolist():
            left = np.flatnonzero(alive[i])
            d = np.zeros(len(left))
            for part in ((c[left] - q[start + i]) ** 2).T:  # component after component, as any engine would add them
                d += part
            d = np.sqrt(d)
            best = np.lexsort((cid[left], d))[:k]
            yield start + i, left[best], d[best]


def search(candidates: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` nearest candidates of each query."""
    pick = lambda df: df.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("dim"))
    sides = candidates.agg(F.count("*").alias("n"), F.max(F.size(vector_col)).alias("dim")).first()
    rows = max(FAN_IN, TILE_BYTES // (8 * max(1, sides["dim"] or 1)))
    n_tiles, n_queries = max(1, -(-sides["n"] // rows)), max(1, -(-queries.count() // QUERY_ROWS))
    spark = candidates.sparkSession
    right = written(tiles(pick(candidates), n_tiles), "tiles")
    left = tiles(pick(queries), n_queries).select("dim", F.col("tile").alias("q_tile"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    left = written(left, "queries")
    out = "dim int, q_tile int, q int, query_id long, tile int, id long, score double"

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], tuple] = {}
        for b in batches:
            for r in b.itertuples():
                qid, cid = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                q, c = (np.frombuffer(x, np.float64).reshape(-1, r.dim) for x in (r.q_vectors, r.vectors))
                if (r.dim, r.q_tile) not in best:
                    best[r.dim, r.q_tile] = qid.copy(), np.zeros((len(q), k), np.int64), np.full((len(q), k), np.inf), np.zeros(len(q), np.int64)
                _, ids, scores, n = best[r.dim, r.q_tile]
                for i, at, d in nearest(qid, q, cid, c, k, np.where(n == k, scores[:, -1], np.inf)):
                    both_id, both_d = np.concatenate([ids[i, : n[i]], cid[at]]), np.concatenate([scores[i, : n[i]], d])
                    order = np.lexsort((both_id, both_d))[:k]
                    n[i] = len(order)
                    ids[i, : n[i]], scores[i, : n[i]] = both_id[order], both_d[order]
        task = TaskContext.get().partitionId()
        for (dim, q_tile), (qid, ids, scores, n) in best.items():
            place, filled = np.repeat(np.arange(len(n)), n), np.arange(k) < n[:, None]
            yield pd.DataFrame({"dim": dim, "q_tile": q_tile, "q": place, "query_id": qid[place], "tile": task, "id": ids[filled], "score": scores[filled]})

    found, step = None, max(1, PASS_BYTES // (8 * QUERY_ROWS * max(1, sides["dim"] or 1)))
    for start in range(0, n_queries, step):
        some = left.where(F.col("q_tile").between(start, start + step - 1))
        with batches_of(spark, BATCH_PAIRS):  # a pair of tiles is some megabytes
            one = written(right.join(F.broadcast(some), "dim").mapInPandas(matched, out), "matched")
        found = one if found is None else found.unionByName(one)
    n_tiles = (found.agg(F.max("tile").alias("n")).first()["n"] or 0) + 1

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        heaps: dict[int, list] = {}
        rows = zip(group["q"], group["query_id"], group["score"], group["id"])
        for q, query_id, score, i in rows:
            heap = heaps.setdefault(q, [])
            item = (-score, -i, query_id)
            if len(heap) < k:
                heapq.heappush(heap, item)
            else:
                heapq.heappushpop(heap, item)
        flat = [(q, query_id, rank, -i, -score) for q, heap in heaps.items() for rank, (score, i, query_id) in enumerate(sorted(heap, reverse=True), 1)]
        head = group.iloc[0]
        return pd.DataFrame(flat, columns=["q", "query_id", "rank", "id", "score"]).assign(dim=head["dim"], q_tile=head["q_tile"], tile=head["tile"] // FAN_IN)

    while True:
        found = found.groupBy("dim", "q_tile", F.floor(F.col("tile") / FAN_IN).alias("group")).applyInPandas(merged, out + ", rank int")
        n_tiles = -(-n_tiles // FAN_IN)
        if n_tiles == 1:
            return found.select("query_id", "rank", F.col("id").alias(id_col), "score")
        found = found.drop("rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
