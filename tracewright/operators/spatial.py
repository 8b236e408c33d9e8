"""Bounds, incidence, nearest neighbours within a radius, pairing by region, polygons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bits import let
from ..functions.units import clamp_int


def bounds(rows: DataFrame, keys: Sequence[str], x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """Union of boxes by key: minima and maxima, held in the range of INT; null where there is no box."""
    agg = [F.min(clamp_int(x0)).alias("x_min"), F.min(clamp_int(y0)).alias("y_min"), F.max(clamp_int(x1)).alias("x_max"), F.max(clamp_int(y1)).alias("y_max")]
    return rows.groupBy(*keys).agg(*agg) if keys else rows.agg(*agg)


def near_join(left: DataFrame, right: DataFrame, keys: Sequence[str], x: Column, y: Column, tolerance: int) -> DataFrame:
    """Pairs with equal ``keys`` and |x - y| of at most ``tolerance``: an equi-join on cells of that width, then the test.

    ``x`` is over the left columns, ``y`` over the right ones; each right row goes to three cells.
    """
    cell = lambda v: F.floor(v / tolerance)
    a = left.withColumn("__x", x).withColumn("__cell", cell(F.col("__x")))
    b = right.withColumn("__y", y).withColumn("__cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cell(F.col("__y")) + d)))
    return a.join(b, [*keys, "__cell"]).where(F.abs(F.col("__x") - F.col("__y")) <= tolerance).drop("__cell", "__x", "__y")


def nearest_node(points: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    """``points`` (id, doc_id, x, y) with the nearest node (doc_id, x, y) within ``radius`` on each axis.

    Cells of the radius' width, nine for each node; the least squared distance wins, ties go to the least (x, y).
    """
    cell = lambda v: F.floor(F.col(v) / radius)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = points.withColumn("__cx", cell("x")).withColumn("__cy", cell("y"))
    b = nodes.select("doc_id", F.col("x").alias("nx"), F.col("y").alias("ny")).distinct()
    b = b.withColumn("__cx", F.explode(F.transform(around, lambda d: cell("nx") + d))).withColumn("__cy", F.explode(F.transform(around, lambda d: cell("ny") + d)))
    wide = lambda c: F.col(c).cast("bigint")
    dx, dy = wide("x") - wide("nx"), wide("y") - wide("ny")
    hits = a.join(b, ["doc_id", "__cx", "__cy"]).where((F.abs(dx) <= radius) & (F.abs(dy) <= radius))
    best = hits.groupBy("id").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "nx", "ny")).alias("__best"))
    return points.join(best, "id", "left").select(*points.columns, F.col("__best.nx").alias("node_x"), F.col("__best.ny").alias("node_y"))


def on_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column, tolerance: int) -> Column:
    """Whether a point lies on a segment's inside, within the tolerance: exact, in wide decimals.

    The box test comes first; ends and segments of no length do not count.
    """
    d = lambda c: c.cast("decimal(19,0)")
    dx, dy = d(x1) - d(x0), d(y1) - d(y0)
    cross = dx * (d(py) - d(y0)) - dy * (d(px) - d(x0))
    inside = px.between(F.least(x0, x1) - tolerance, F.greatest(x0, x1) + tolerance) & py.between(F.least(y0, y1) - tolerance, F.greatest(y0, y1) + tolerance)
    at_end = ((px == x0) & (py == y0)) | ((px == x1) & (py == y1))
    c = F.try_multiply(cross.cast("decimal(38,0)"), cross.cast("decimal(38,0)"))
    limit = (dx * dx + dy * dy).cast("decimal(38,0)") * F.lit(tolerance).cast("decimal(10,0)") * F.lit(tolerance).cast("decimal(10,0)")
    return inside & ~at_end & ((x0 != x1) | (y0 != y1)) & (c <= limit)


def pair_once(pairs: DataFrame, region: str, pad: str, keys: Sequence[str] = ()) -> DataFrame:
    """Of candidate pairs, each region's first pad, and of regions that share it the first: one to one within the keys."""
    first = pairs.groupBy(*keys, region).agg(F.min(pad).alias(pad))
    return first.groupBy(*keys, pad).agg(F.min(region).alias(region)).select(*keys, region, pad)


def doubled_area(points: Column) -> Column:
    """Twice the signed area of a polygon given as array<struct<x,y>>."""
    wide = lambda c: c.cast("bigint")
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, after, lambda p, q: wide(p["x"]) * wide(q["y"]) - wide(q["x"]) * wide(p["y"]))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, t: a + t)


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Between two points, in raw units."""
    dx, dy = x1.cast("double") - x0.cast("double"), y1.cast("double") - y0.cast("double")
    return F.sqrt(dx * dx + dy * dy)


def ccw_sweep(start: Column, end: Column) -> Column:
    """Degrees from ``start`` to ``end`` against the clock, from 0 up to 360: an arc that ends where it starts has none."""
    return F.pmod(end - start, F.lit(360.0))


def offset_polygon(points: Column, offset: Column) -> Column:
    """A polygon (array<struct<x,y>>) grown by ``offset`` raw units, or shrunk if it is negative, with mitred corners.

    Null for fewer than three corners, for no area, and where shrinking turns an edge round. Each corner moves along the
    sum of its edges' outward normals, divided by one plus their product, which meets both moved edges.
    """
    n = F.size(points)
    number = lambda c: c.cast("double")
    at = lambda a, i: F.get(a, F.pmod(i, n))
    places = F.sequence(F.lit(0), n - 1)

    def edge(a: Column, i: Column) -> tuple[Column, Column]:
        return number(at(a, i + 1)["x"]) - number(at(a, i)["x"]), number(at(a, i + 1)["y"]) - number(at(a, i)["y"])

    def moved(area: Column) -> Column:
        out = F.when(area > 0, 1.0).otherwise(-1.0)

        def normal(i: Column) -> Column:
            dx, dy = edge(points, i)
            size = F.sqrt(dx * dx + dy * dy)
            return F.when(size < 1e-6, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))).otherwise(F.struct((out * dy / size).alias("x"), (-out * dx / size).alias("y")))

        def corner(a: Column, b: Column, p: Column) -> Column:
            product = a["x"] * b["x"] + a["y"] * b["y"]
            scale = offset.cast("double") / F.when(product > -1 + 1e-12, 1 + product).otherwise(2.0)
            return F.struct(*(clamp_int(F.round(number(p[c]) + scale * (a[c] + b[c]))).alias(c) for c in "xy"))

        def checked(new: Column) -> Column:
            ahead = lambda i: sum(u * v for u, v in zip(edge(points, i), edge(new, i)))
            return F.when((n >= 3) & (area != 0) & ~((offset < 0) & F.exists(places, lambda i: ahead(i) < 0)), new)

        return let(F.transform(places, normal), lambda normals: let(F.transform(places, lambda i: corner(at(normals, i - 1), at(normals, i), at(points, i))), checked))

    return let(doubled_area(points), moved)


def fit(box: DataFrame, width: float, height: float, margin: float) -> DataFrame:
    """Scale and shifts (scale, dx, dy) that place each box (x_min, y_min, x_max, y_max) in the middle of a canvas, y upwards."""
    w, h = F.greatest(F.col("x_max").cast("bigint") - F.col("x_min"), F.lit(1)), F.greatest(F.col("y_max").cast("bigint") - F.col("y_min"), F.lit(1))
    scaled = box.withColumn("scale", F.least((width - 2 * margin) / w, (height - 2 * margin) / h))
    middle = lambda a, b: (F.col(a).cast("double") + F.col(b)) / 2
    return scaled.withColumn("dx", width / 2 - F.col("scale") * middle("x_min", "x_max")).withColumn("dy", height / 2 + F.col("scale") * middle("y_min", "y_max"))
