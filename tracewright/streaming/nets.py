"""Netlists kept up to date while pads arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import netlist


def net_sizes(pads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Distinct endpoints of each net in a stream of pads (ts, net, designator, pad); repeats within ``delay`` count once."""
    fresh = netlist.endpoints(pads).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["net", "designator", "pad"])
    return fresh.groupBy("net").agg(F.count("*").alias("n_conn"))


def changed_sheets(records: DataFrame, handle, checkpoint: str) -> StreamingQuery:
    """Runs ``handle`` (a function of a DataFrame and the batch's number) on the records of the sheets in each batch."""
    return records.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
