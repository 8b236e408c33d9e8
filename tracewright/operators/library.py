"""Integrity of footprint libraries, as a union of checks over their tables.

``listed``: (library, name, stated_count); ``stored``: (library, name, has_data, pattern); ``records``: (library, name,
ord, kind, size); ``ids``: (library, name, record_index, type_code); ``unique_ids``: (library, name, ord, record_index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import lint

#: The usual body length of a record by its kind, and the type codes that kinds must have.
BODY_SIZES = {1: 60, 2: 202, 4: 49, 5: 252, 6: 50}
TYPE_CODES = {11: 89, 12: 90}


def _case(values: dict[int, int], of: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in values.items():
        out = F.when(of == k, v).otherwise(out)
    return out


def checks(listed: DataFrame, stored: DataFrame, records: DataFrame, ids: DataFrame, unique_ids: DataFrame) -> DataFrame:
    """(check, item, message), an item being ``library/name``."""
    key = ["library", "name"]
    item = F.concat_ws("/", *key)
    counts = records.groupBy(*key).agg(F.count("*").alias("n"))
    short = records.where(_case(BODY_SIZES, F.col("kind")) != F.col("size"))
    id_counts = ids.groupBy(*key).agg(F.count("*").alias("n_ids"))
    at = records.select(*key, F.col("ord").alias("record_index"), "kind")
    placed = ids.join(at, [*key, "record_index"], "left")
    first = lambda df: df.groupBy(*key).agg(F.min("record_index").alias("record_index"))  # noqa: E731  only the first is reported
    outside = first(placed.where("kind is null"))
    coded = first(placed.where(_case(TYPE_CODES, F.col("kind")) != F.col("type_code")))
    before = F.lag("record_index").over(W.partitionBy(*key).orderBy("ord"))
    unordered = unique_ids.withColumn("before", before).where("before >= record_index")
    no_pad = unique_ids.join(at, [*key, "record_index"]).where("kind <> 2")
    number = lambda c: F.col(c).cast("string")
    return lint.report([
        lint.found(listed.join(stored.select(*key).distinct(), key, "left_anti"), "listed", item, "has no storage"),
        lint.found(stored.join(listed.select(*key).distinct(), key, "left_anti"), "stored", item, "is not listed"),
        lint.found(stored.where("not has_data"), "data", item, "has no data stream"),
        lint.found(stored.where("pattern is not null and pattern <> name"), "pattern", item, F.concat(F.lit("pattern is "), F.col("pattern"))),
        lint.found(listed.join(counts, key, "left").where("stated_count <> coalesce(n, 0)"), "count", item, F.concat(F.lit("states "), number("stated_count"), F.lit(", has "), F.coalesce(number("n"), F.lit("0")))),
        lint.found(short, "body", item, F.concat(F.lit("record "), number("ord"), F.lit(" has "), number("size"), F.lit(" bytes"))),
        lint.found(counts.join(id_counts, key).where("n <> n_ids"), "guids", item, F.concat(number("n_ids"), F.lit(" rows for "), number("n"), F.lit(" records"))),
        lint.found(outside, "guids", item, F.concat(F.lit("no record "), number("record_index"))),
        lint.found(coded, "guids", item, F.concat(F.lit("wrong type of record "), number("record_index"))),
        lint.found(unordered, "unique ids", item, F.concat(F.lit("out of order at record "), number("record_index"))),
        lint.found(no_pad, "unique ids", item, F.concat(F.lit("record "), number("record_index"), F.lit(" is no pad"))),
    ])
