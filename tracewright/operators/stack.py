"""Layer stacks and outlines from board parameters (doc_id, ord, key, value): keys may repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import units


def _fields(board: DataFrame, pattern: str, pick) -> DataFrame:
    """(doc_id, n, fields map) of the keys that match ``pattern`` (number, field); ``pick`` chooses among repeated keys."""
    rows = board.select("doc_id", "ord", F.regexp_extract("key", pattern, 1).try_cast("int").alias("n"), F.regexp_extract("key", pattern, 2).alias("field"), "value").where("n is not null").repartition("doc_id")  # dealt before it is sorted, so that no task sorts a whole file
    once = rows.groupBy("doc_id", "n", "field").agg(pick("value", "ord").alias("value"))
    return once.groupBy("doc_id", "n").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))


def _layer(get) -> list[Column]:
    return [
        get("NAME").alias("name"),
        units.parse_length(get("COPTHICK")).alias("copper_thickness"),
        units.parse_length(get("DIELHEIGHT")).alias("dielectric_height"),
        F.trim(get("DIELTYPE")).try_cast("int").alias("dielectric_type"),
        units.thousandths(get("DIELCONST")).alias("dielectric_constant"),
        F.coalesce(get("DIELMATERIAL"), F.lit("")).alias("dielectric_material"),
    ]


def numbered_stack(board: DataFrame) -> DataFrame:
    """Layers of the newer form, top first: numbers from 0 up while there is a name; the first value of a key counts."""
    found = _fields(board, r"^V9_STACK_LAYER(\d+)_([A-Z]+)$", F.min_by)
    get = lambda k: F.try_element_at("fields", F.lit(k))
    named = found.where(get("NAME").isNotNull()).withColumn("__k", F.row_number().over(W.partitionBy("doc_id").orderBy("n")))
    return named.where(F.col("__k") == F.col("n") + 1).select("doc_id", F.col("n").alias("place"), F.col("n").alias("layer"), *_layer(get))


def linked_stack(board: DataFrame) -> DataFrame:
    """Layers of the older form, by their links: from the first without a valid predecessor along the successors, each
    once; then those that were not reached, by number. The last value of a key counts; numbers run from 1 to 100."""
    found = _fields(board, r"^V7_LAYER(\d+)([A-Z]+)$", F.max_by).where("n between 1 and 100")
    get = lambda k: F.try_element_at("fields", F.lit(k))
    layers = found.where(get("NAME").isNotNull())
    link = lambda k: F.coalesce(get(k).try_cast("int"), F.lit(0)).alias(k.lower())
    lists = layers.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", link("PREV"), link("NEXT")))).alias("all"))
    numbers = F.transform("all", lambda e: e["n"])
    first = F.get(F.filter("all", lambda e: (e["prev"] == 0) | ~F.array_contains(numbers, e["prev"])), F.lit(0))["n"]

    def follow(walk: Column, _: Column) -> Column:
        last = F.get(walk, F.size(walk) - 1)
        after = F.get(F.filter("all", lambda e: e["n"] == last), F.lit(0))["next"]
        more = F.array_contains(numbers, after) & ~F.array_contains(walk, after)
        return F.when(F.coalesce(more, F.lit(False)), F.concat(walk, F.array(after))).otherwise(walk)

    walk = F.aggregate("all", F.array(first), follow)
    order = lists.where(first.isNotNull()).select("doc_id", F.posexplode(F.concat(walk, F.array_except(numbers, walk))).alias("place", "n"))
    return order.join(layers, ["doc_id", "n"]).select("doc_id", "place", F.col("n").alias("layer"), *_layer(get))


def outline(board: DataFrame) -> DataFrame:
    """(doc_id, vertices, error): corners from 0 up while there is an x; a last corner on the first is dropped.

    A corner whose numbers are missing or unreadable makes the outline null and is named in ``error``.
    """
    rows = board.select("doc_id", "ord", F.regexp_extract("key", r"^(VX|VY|KIND|CX|CY|SA|EA|R)(\d+)$", 1).alias("field"), F.regexp_extract("key", r"^(VX|VY|KIND|CX|CY|SA|EA|R)(\d+)$", 2).try_cast("int").alias("n"), "value").where("n is not null").repartition("doc_id")  # dealt before it is sorted, so that no task sorts a whole file
    once = rows.groupBy("doc_id", "n", "field").agg(F.min_by("value", "ord").alias("value"))
    corners = once.groupBy("doc_id", "n").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    corners = corners.where(get("VX").isNotNull()).withColumn("__k", F.row_number().over(W.partitionBy("doc_id").orderBy("n"))).where(F.col("__k") == F.col("n") + 1)
    length, number = lambda k: units.parse_length(get(k)), lambda k: F.trim(get(k)).try_cast("double")
    kind = number("KIND")
    straight = kind.isin(0.0) & length("VX").isNotNull() & length("VY").isNotNull()
    arc = kind.isin(1.0) & length("VX").isNotNull() & length("VY").isNotNull() & length("CX").isNotNull() & length("CY").isNotNull() & number("SA").isNotNull() & number("EA").isNotNull() & length("R").isNotNull()
    only = lambda c: F.when(kind == 1.0, c)
    corner = F.struct("n", length("VX").alias("x"), length("VY").alias("y"), (kind == 1.0).alias("is_arc"), only(length("CX")).alias("cx"), only(length("CY")).alias("cy"), only(number("SA")).alias("start_angle"), only(number("EA")).alias("end_angle"), only(length("R")).alias("radius"))
    good = F.coalesce(straight | arc, F.lit(False))
    lists = corners.groupBy("doc_id").agg(F.array_sort(F.collect_list(corner)).alias("v"), F.min(F.when(~good, F.col("n"))).alias("bad"))
    first, last = F.get("v", F.lit(0)), F.get("v", F.size("v") - 1)
    closed = (F.size("v") > 1) & (first["x"] == last["x"]) & (first["y"] == last["y"])
    return lists.select("doc_id", F.when(F.col("bad").isNull(), F.when(closed, F.slice("v", F.lit(1), F.size("v") - 1)).otherwise(F.col("v"))).alias("vertices"), F.when(F.col("bad").isNotNull(), F.concat(F.lit("corner "), F.col("bad").cast("string"))).alias("error"))
