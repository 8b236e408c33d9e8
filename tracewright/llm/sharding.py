"""Sharding by balanced label propagation, with DataFrame operations only.

Rows that share a link (here: equal texts) should land in one shard, and all shards get the same number of rows, give or
take one (law ``rows``). Rows start in the shard of a hash. In each round the links' counts by shard are aggregated and
joined back to their rows; each row wishes to move to the shard where most of its neighbours are, or, if that did not
admit them, to another. Quotas, from the flows that the wishes would make between shards, admit a share of a shard's wishes; whether a link
belongs to it is decided by a hash, so that neighbours move together. Rounds end when nothing improves, or after
``ROUNDS``. Rows beyond a shard's size, and those of links larger than a shard, then fill up the shards in the order of
their links, and rows without links fill the rest.

No window or group holds more than a bounded share: a link's rows are counted with partial sums, and ranks come from
counts by bucket plus a window within each bucket; large links have many buckets.

Defined results: a null text has size 1, crc32 0 and no link; empty texts are equal texts; repeated rows are rows of
their own; fewer rows than shards leave the last shards empty; an empty table gives none; columns other than those named
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

SHARDS, ROUNDS, BUCKET_ROWS, LEAST_BUCKETS = 8, 8, 20_000, 64
#: Buckets of a link with many rows.
WIDE = 1024


def ranked(rows: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` from 0 within ``within``, in the order of ``bucket`` and then ``order``."""
    counts = rows.groupBy(*within, "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(*within, F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(*within, "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy(*within, "bucket").orderBy(*order))
    return rows.withColumn("nth", nth).join(counts, [*within, "bucket"]).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("nth", "before")


def admitted(flow: dict[tuple[int, int], int], load: dict[int, int], room: int, shards: int) -> list[float]:
    """The share of each shard's wishes that it admits, so that none exceeds ``room`` after what leaves it."""
    share_of = [1.0] * shards
    for _ in range(100):
        for t in range(shards):
            into = sum(n for (_, u), n in flow.items() if u == t)
            out = sum(n * share_of[u] for (s, u), n in flow.items() if s == t)
            if into:
                share_of[t] = max(0.0, min(share_of[t], (room - load.get(t, 0) + out) / into))
    return share_of


def propagate(members: DataFrame, room: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(row, link, shard): ``members`` (row, link) with the shards found by label propagation, about ``room`` rows in each at most."""
    now = written(members.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "labels")
    for k in range(rounds):
        load = {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        counts = now.groupBy("link", "shard").agg(F.count("*").alias("c"))
        # The best shard of a link: where most of its rows are; ties by a hash. At most an entry for each shard.
        best = F.max(F.struct("c", F.xxhash64("link", "shard").alias("tie"), "shard"))
        wish = counts.groupBy("link").agg(best.alias("best"), F.sum("c").alias("n"))
        # A link that was not admitted last time tries another shard.
        waits = F.lit(k > 0) & (F.col("best.c") < F.col("n"))
        turn = F.when(waits, F.pmod(F.xxhash64("link", F.lit(k)), F.lit(shards)).cast("int")).otherwise(F.col("best.shard"))
        wish = wish.select("link", turn.alias("to"))
        moves = written(now.join(wish, "link").select("row", "link", "shard", "to"), "moves")
        flow = {(r["shard"], r["to"]): r["n"] for r in moves.where("shard <> `to`").groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}
        if not flow:
            break
        quota = F.lit(0.0)
        for t, q in enumerate(admitted(flow, load, room, shards)):
            quota = F.when(F.col("to") == t, F.lit(q)).otherwise(quota)
        dice = F.pmod(F.xxhash64("link", F.lit(k)), F.lit(1_000_003)) / 1_000_003
        now = written(moves.withColumn("shard", F.when(dice < quota, F.col("to")).otherwise(F.col("shard"))).drop("to"), "labels")
    return now


def place(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(row, shard, slot) for ``rows`` (row unique, link or null): counts at most one apart, slots gapless from 0."""
    total = rows.count()
    each, more = divmod(total, shards)
    sizes = F.lit(each) + F.when(F.col("shard") < more, 1).otherwise(0)
    buckets = max(LEAST_BUCKETS, total // BUCKET_ROWS)
    links = rows.where("link is not null").groupBy("link").agg(F.count("*").alias("n")).where("n > 1")
    members = written(rows.join(links, "link").select("row", "link", "n"), "members")
    labels = propagate(members.where(F.col("n") <= each).select("row", "link"), each, shards, rounds)
    bucket = F.pmod(F.xxhash64("link"), F.lit(buckets)) * WIDE + F.when(F.col("n") > BUCKET_ROWS // 10, F.pmod(F.xxhash64("row"), F.lit(WIDE))).otherwise(0)
    members = members.withColumn("bucket", bucket)
    labelled = labels.select("row", "shard").join(members, "row")
    linked = written(ranked(labelled, ["shard"], ["link", "row"]).withColumn("fits", F.col("rank") < sizes).select("row", "shard", "rank", "fits"), "linked")
    kept = {r["shard"]: r["n"] for r in linked.where("fits").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    fitting = linked.where("fits").select("row", "shard", F.col("rank").alias("slot"))
    # The others: first by link, then those without.
    free = rows.select("row").join(fitting.select("row"), "row", "left_anti").join(members.select("row", "link", "bucket"), "row", "left")
    free = free.withColumn("bucket", F.coalesce("bucket", F.lit(buckets * WIDE) + F.pmod(F.xxhash64("row"), F.lit(buckets))))
    free = ranked(free, [], ["link", "row"])
    start = [0]
    for s in range(shards):
        start.append(start[-1] + each + (s < more) - kept.get(s, 0))
    shard, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in reversed(range(shards)):
        shard = F.when(F.col("rank") < start[s + 1], F.lit(s)).otherwise(shard)
        slot = F.when(F.col("rank") < start[s + 1], F.col("rank") - start[s] + kept.get(s, 0)).otherwise(slot)
    return fitting.unionByName(free.select("row", shard.cast("int").alias("shard"), slot.cast("long").alias("slot")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(
        table(spark, sf_dir, "documents").select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.unhex(F.md5("text")).alias("link"),
        ),
        "rows",
    )
    placed = place(rows.select("row", "link"))
    return rows.join(placed, "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
