"""Boards placed in boards: instances with composed affine maps, to a bounded depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import written
from ..functions.units import clamp_int

DEPTH = 8
#: Fixed value: degrees from which an arc counts as a full circle.
FULL = 359.995
IDENTITY = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 1.0, "tx": 0.0, "ty": 0.0}


def quarter_exact(angle: Column, f) -> Column:
    """Sine or cosine in degrees, exact at multiples of 90."""
    turn = F.pmod(angle, F.lit(360.0))
    values = {"cos": (1.0, 0.0, -1.0, 0.0), "sin": (0.0, 1.0, 0.0, -1.0)}[f]
    exact = F.when(turn == 0, values[0]).when(turn == 90, values[1]).when(turn == 180, values[2]).when(turn == 270, values[3])
    return F.coalesce(exact, (F.cos if f == "cos" else F.sin)(F.radians(turn)))


def placement(x: Column, y: Column, angle: Column, mirror: Column, ox: Column, oy: Column) -> dict[str, Column]:
    """The map p -> R M (p - origin) + (x, y); M mirrors x."""
    cos, sin, m = quarter_exact(angle, "cos"), quarter_exact(angle, "sin"), F.when(mirror, -1.0).otherwise(1.0)
    a, b, c, d = cos * m, -sin, sin * m, cos
    return {"a": a, "b": b, "c": c, "d": d, "tx": x - (a * ox + b * oy), "ty": y - (c * ox + d * oy)}


def composed(outer: dict[str, Column], inner: dict[str, Column]) -> dict[str, Column]:
    """outer after inner."""
    o, i = outer, inner
    return {
        "a": o["a"] * i["a"] + o["b"] * i["c"], "b": o["a"] * i["b"] + o["b"] * i["d"], "c": o["c"] * i["a"] + o["d"] * i["c"], "d": o["c"] * i["b"] + o["d"] * i["d"],
        "tx": o["a"] * i["tx"] + o["b"] * i["ty"] + o["tx"], "ty": o["c"] * i["tx"] + o["d"] * i["ty"] + o["ty"],
    }


def instances(placements: DataFrame, roots: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """All instances of boards under ``roots`` (doc), and the placements that stay unresolved.

    ``placements``: (parent, child, ord, x, y, rotation, mirror, cols, rows, dx, dy, origin_x, origin_y); child is null
    where it was not found. An instance has its board, its map (a b c d tx ty) and ``visit``, the path of its placements,
    columns before rows, in which arrays sort as the boards are visited. Each level is one join; a level's result is
    written, so neither depth nor fan-out makes the plan grow.
    """
    names = list(IDENTITY)
    level = written(roots.select(F.col("doc").alias("root"), "doc", F.array().cast("array<int>").alias("visit"), *(F.lit(v).alias(k) for k, v in IDENTITY.items())), "instances")
    found, lost = level, None
    for k in range(depth + 1):
        p = placements.select(F.col("parent").alias("doc"), *[c for c in placements.columns if c != "parent"])
        step = level.join(p, "doc")
        kept = step.where(F.col("child").isNull() | F.lit(k == depth)).select("root", "doc", "visit", "ord", "child")
        lost = kept if lost is None else lost.unionByName(kept)
        if k == depth:
            break
        step = step.where("child is not null").withColumn("col", F.explode(F.sequence(F.lit(0), F.greatest(F.col("cols"), F.lit(1)) - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), F.greatest(F.col("rows"), F.lit(1)) - 1)))
        inner = placement(F.col("x") + F.col("col") * F.col("dx"), F.col("y") + F.col("row") * F.col("dy"), F.col("rotation").cast("double"), F.col("mirror"), F.col("origin_x"), F.col("origin_y"))
        outer = {n: F.col(n) for n in names}
        level = step.select("root", F.col("child").alias("doc"), F.concat("visit", F.array("ord", "col", "row").cast("array<int>")).alias("visit"), *(v.alias(n) for n, v in composed(outer, inner).items()))
        level = written(level, "instances")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found, lost


def applied(x: Column, y: Column) -> tuple[Column, Column]:
    """A point under the map in columns a b c d tx ty, rounded half away from zero, held in the range of INT."""
    at = lambda p, q, t: clamp_int(F.round(F.col(p) * x + F.col(q) * y + F.col(t)))
    return at("a", "b", "tx"), at("c", "d", "ty")


def turned(angle: Column) -> Column:
    """A stored rotation under the map: turned by it, and reflected first where the map flips."""
    m = F.when(flipped(), -1.0).otherwise(1.0)
    turn = F.degrees(F.atan2(m * F.col("c"), m * F.col("a")))
    return F.pmod(turn + m * angle, F.lit(360.0))


def direction(angle: Column) -> Column:
    """The angle to which a direction is mapped."""
    s, c = F.sin(F.radians(angle)), F.cos(F.radians(angle))
    return F.pmod(F.degrees(F.atan2(F.col("c") * c + F.col("d") * s, F.col("a") * c + F.col("b") * s)), F.lit(360.0))


def swept(start: Column, end: Column) -> tuple[Column, Column]:
    """Both ends of an arc under the map; they change places where it flips, and a full circle stays one."""
    a, b = direction(F.when(flipped(), end).otherwise(start)), direction(F.when(flipped(), start).otherwise(end))
    return a, F.when(F.abs(end - start) >= FULL, a + 360.0).otherwise(b)


def flipped() -> Column:
    return F.col("a") * F.col("d") - F.col("b") * F.col("c") < 0


def moved(prims: DataFrame, kind: str, found: DataFrame) -> DataFrame:
    """The primitives of each instance's board, in the root's frame: a row for each instance, with ``root`` and ``visit``.

    ``prims``: (doc, ...) with the columns of ``sources.board`` for tracks, arcs, pads, vias, texts, fills, regions and
    bodies (``outline``, ``holes``), polygons (``x``, ``y``, ``vertices``), components and embedded boards. Sizes and
    shapes are the primitive's own and stay.
    """
    point = lambda x, y: dict(zip((x, y), applied(F.col(x), F.col(y))))
    flip = lambda c: {c: F.col(c) != flipped()}

    def corner(v: Column) -> Column:
        return F.struct(*(c.alias(n) for c, n in zip(applied(v["x"], v["y"]), "xy")))

    def vertex(v: Column) -> Column:
        start, end = swept(v["start_angle"], v["end_angle"])
        x, y = applied(v["x"], v["y"])
        cx, cy = applied(v["cx"], v["cy"])
        only = lambda new, c: F.when(v["is_arc"], new).otherwise(v[c]).alias(c)
        return F.struct(x.alias("x"), y.alias("y"), v["is_arc"].alias("is_arc"), only(cx, "cx"), only(cy, "cy"), only(start, "start_angle"), only(end, "end_angle"))

    ends = {**point("x0", "y0"), **point("x1", "y1")} if kind in ("track", "fill") else {}
    place = point("x", "y") if kind in ("arc", "pad", "via", "text", "polygon", "component", "embedded") else {}
    rotation = {"rotation": turned(F.col("rotation"))} if kind in ("pad", "text", "fill", "component", "embedded") else {}
    outline = {"outline": F.transform("outline", corner)} if kind in ("region", "body") else {}
    more: dict[str, Column] = {}
    if kind == "arc":
        more = dict(zip(("start_angle", "end_angle"), swept(F.col("start_angle"), F.col("end_angle"))))
    elif kind == "text":
        more = flip("is_mirrored")
    elif kind == "region":
        more = {"holes": F.transform("holes", lambda h: F.transform(h, corner))}
    elif kind == "body":
        more = {**point("model_x", "model_y"), "model_rotation": turned(F.col("model_rotation"))}
    elif kind == "polygon":
        more = {"vertices": F.transform("vertices", vertex)}
    elif kind == "component":
        more = flip("flipped")
    elif kind == "embedded":  # the cached box stays upright, spacings are along the board's own axes
        (ax, ay), (bx, by) = applied(F.col("box_x0"), F.col("box_y0")), applied(F.col("box_x1"), F.col("box_y1"))
        more = {"box_x0": F.least(ax, bx), "box_y0": F.least(ay, by), "box_x1": F.greatest(ax, bx), "box_y1": F.greatest(ay, by), **flip("mirror")}
    new = {**ends, **place, **rotation, **outline, **more}
    joined = prims.join(found, "doc")
    return joined.select("root", "visit", "doc", *(new.get(c, F.col(c)).alias(c) for c in prims.columns if c != "doc"))


def component_bases(found: DataFrame, components: DataFrame) -> DataFrame:
    """(root, visit, base): how many components come before those of each instance, in the order of visits."""
    n = components.groupBy("doc").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("root").orderBy("visit").rowsBetween(W.unboundedPreceding, -1))  # a row for each instance
    return found.join(n, "doc", "left").withColumn("n", F.coalesce("n", F.lit(0))).select("root", "visit", F.coalesce(before, F.lit(0)).cast("int").alias("base"))


def merged_nets(found: DataFrame, nets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, net_index, name) of the flat boards, nets of one name being one in the place of the first; and the map
    (root, visit, net_index, new_index). ``nets``: (doc, ord, name), numbered from 0; indices are from 1."""
    rows = nets.join(found.select("root", "visit", "doc"), "doc").select("root", "visit", "ord", "name")
    once = rows.groupBy("root", "name").agg(F.min(F.struct("visit", "ord")).alias("first"))
    place = F.row_number().over(W.partitionBy("root").orderBy("first"))  # a row for each name
    flat = written(once.select("root", "name", place.alias("net_index")), "nets")
    return flat, rows.join(flat, ["root", "name"]).select("root", "visit", (F.col("ord") + 1).alias("net_index"), F.col("net_index").alias("new_index"))


def remapped(prims: DataFrame, bases: DataFrame, net_map: DataFrame | None = None) -> DataFrame:
    """``moved`` primitives with indices of the flat board: components shift by their instance's base, nets go by name; a net that is not there becomes 0."""
    out = prims.join(bases, ["root", "visit"]).withColumn("component_index", F.when(F.col("component_index") >= 0, F.col("component_index") + F.col("base")).otherwise(F.col("component_index"))).drop("base")
    if net_map is None:
        return out
    return out.join(net_map, ["root", "visit", "net_index"], "left").withColumn("net_index", F.coalesce("new_index", F.lit(0))).drop("new_index")


def copied(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rules, classes, differential pairs and rooms: those of each instance's board, once for each instance."""
    return rows.join(found.select("root", "visit", "doc"), "doc")


def kept_models(found: DataFrame, models: DataFrame) -> DataFrame:
    """(root, id, visit, ord): of the models (doc, ord, id) of all instances, the first of each id in any case."""
    rows = models.join(found.select("root", "visit", "doc"), "doc")
    return rows.groupBy("root", F.upper("id").alias("id")).agg(F.min(F.struct("visit", "ord")).alias("f")).select("root", "id", "f.visit", "f.ord")
