"""Netlists of schematic sheets: what touches is one net, and a net takes its best label's name.

Every table has ``doc_id`` and ``ord`` (position in the sheet); coordinates are raw units, INT or BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import written
from .graph import components
from .spatial import nearest_node, on_segment

#: How far a node may lie off a wire, and a port's end off the node it joins.
NODE_SNAP, PORT_SNAP = 10_000, 100_000
#: Width of the cells by which nodes meet segments.
CELL = 2_000_000


def visible(part: Column, current_part: Column, mode: Column, current_mode: Column, modes: Column) -> Column:
    """Whether a pin belongs to the placed part and display mode."""
    other_part = (part > 0) & (current_part > 0) & (part != current_part)
    other_mode = (modes > 1) & (mode >= 0) & (mode != current_mode)
    return ~F.coalesce(other_part, F.lit(False)) & ~F.coalesce(other_mode, F.lit(False))


def drawn(part: Column, current_part: Column, mode: Column, current_mode: Column, modes: Column) -> Column:
    """Whether a primitive is drawn: a part that is not set is the first, and without a choice of modes all are drawn."""
    current = F.when(current_part > 0, current_part).otherwise(1)
    return ((part <= 0) | (part == current)) & ((modes <= 1) | (mode == current_mode))


def pin_end(pins: DataFrame) -> DataFrame:
    """``pins`` with x and y moved to the wire's end: orientation 0 right, 1 up, 2 left, 3 down."""
    o, n = F.col("orientation"), F.col("length")
    dx = F.when(o == 0, n).when(o == 2, -n).otherwise(0)
    dy = F.when(o == 1, n).when(o == 3, -n).otherwise(0)
    return pins.withColumn("x", F.col("x") + dx).withColumn("y", F.col("y") + dy)


def fan_out(pins: DataFrame, maps: DataFrame) -> DataFrame:
    """A pin's pad becomes the pads that its component's map gives it; the last map of a pad with any pads counts.

    ``maps``: (doc_id, component_ord, ord, pad, pads array<string>).
    """
    last = maps.where(F.size("pads") > 0).groupBy("doc_id", "component_ord", "pad").agg(F.max_by("pads", "ord").alias("__pads"))
    joined = pins.join(last, ["doc_id", "component_ord", "pad"], "left")
    return joined.withColumn("pad", F.explode(F.coalesce("__pads", F.array("pad")))).drop("__pads")


def port_ends(ports: DataFrame) -> DataFrame:
    """Both ends of each port: styles of 4 and more are vertical."""
    tall = F.col("style") >= 4
    far = F.struct((F.col("x") + F.when(tall, 0).otherwise(F.col("width"))).alias("x"), (F.col("y") + F.when(tall, F.col("width")).otherwise(0)).alias("y"))
    return ports.withColumn("__e", F.explode(F.array(F.struct("x", "y"), far))).withColumn("x", F.col("__e.x")).withColumn("y", F.col("__e.y")).drop("__e")


def segments(wires: DataFrame) -> DataFrame:
    """(doc_id, x0, y0, x1, y1) between neighbouring vertices (array<struct<x,y>>)."""
    n = F.size("vertices")
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at("vertices", i).alias("a"), F.element_at("vertices", i + 1).alias("b")))
    rows = wires.where(n > 1).select("doc_id", F.explode(pairs).alias("s"))
    return rows.select("doc_id", *(F.col(f"s.{p}.{c}").alias(f"{c}{k}") for k, p in enumerate("ab") for c in "xy"))


def touching(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, x, y, x0, y0): nodes within the tolerance of a segment's inside; they meet by cells of x."""
    cell = lambda c: F.floor(c / CELL)
    low, high = F.least("x0", "x1") - NODE_SNAP, F.greatest("x0", "x1") + NODE_SNAP
    spread = lines.withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    hits = nodes.withColumn("__cell", cell(F.col("x"))).join(spread, ["doc_id", "__cell"])
    return hits.where(on_segment(*(F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")), NODE_SNAP)).select("doc_id", "x", "y", "x0", "y0")


def edge_point(x: Column, y: Column, x_size: Column, y_size: Column, side: Column, distance: Column) -> tuple[Column, Column]:
    """A point on the edge of a box given by its upper left corner: on the left (0) and right (1) down from the top, on the top (2) and bottom (3) from the left."""
    level = side.isin(2, 3)
    px = F.when(level, x + distance).when(side == 1, x + x_size).otherwise(x)
    return px, F.when(side == 3, y - y_size).when(side == 2, y).otherwise(y - distance)


def _point(x: str = "x", y: str = "y") -> Column:
    return F.struct(F.col("doc_id").alias("doc_id"), F.col(x).cast("bigint").alias("x"), F.col(y).cast("bigint").alias("y"))


def _places(*tables: DataFrame) -> DataFrame:
    """The distinct points of the tables."""
    out = None
    for df in tables:
        one = df.select("doc_id", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _snapped(ports: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both ends of each port, moved to the nearest node in reach."""
    ends = port_ends(ports).withColumn("id", F.struct("doc_id", "ord", "x", "y"))
    ends = nearest_node(ends, nodes, PORT_SNAP).withColumn("x", F.coalesce("node_x", "x")).withColumn("y", F.coalesce("node_y", "y"))
    return written(ends.drop("id", "node_x", "node_y"), "ends")


def _roots(nodes: DataFrame, lines: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(node, root): what lines, the nodes on them and further edges (a, b) join."""
    edges = (
        nodes.select(_point().alias("a"), _point().alias("b"))
        .unionByName(lines.select(_point("x0", "y0").alias("a"), _point("x1", "y1").alias("b")))
        .unionByName(touching(nodes, lines).select(_point().alias("a"), _point("x0", "y0").alias("b")))
    )
    return written(components(edges if more is None else edges.unionByName(more)), "roots")


def _filled(c: str) -> Column:
    """The trimmed text, null if there is none."""
    return F.when(F.trim(c) != "", F.trim(c))


ENTRY = "struct<sheet_symbol:string,file_name:string,entry:string,io_type:int>"


def bundles(connectors: DataFrame, labels: DataFrame, ports: DataFrame, entries: DataFrame, junctions: DataFrame, wires: DataFrame) -> DataFrame:
    """(doc_id, connector, bundle, io_type, carriers) of harness connectors (doc_id, ord, harness_type, x, y), by their primary points.

    A bundle's name is that of the label, else the harness port, else the harness sheet entry that lines join to the
    connector, the first by name of each; else the connector's type, else HARNESS and its number. Labels of one text are
    one point. The direction is that of the first carrier that has one. ``carriers`` are the sheet entries among them.
    """
    vertices = wires.select("doc_id", F.explode("vertices").alias("v")).select("doc_id", F.col("v.x").alias("x"), F.col("v.y").alias("y"))
    hard = written(_places(connectors, labels, entries, junctions, vertices), "nodes")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    anchor = lambda df, priority, text, io, entry: df.select("doc_id", F.lit(priority).alias("priority"), F.coalesce(_filled(text), F.lit("")).alias("name"), "x", "y", io, entry)
    ends = _snapped(ports, hard)
    own = F.struct("sheet_symbol", "file_name", F.trim("name").alias("entry"), F.col("io_type").cast("int").alias("io_type")).alias("carrier")
    io = F.col("io_type").cast("int").alias("io_type")
    anchors = anchor(labels.where(F.trim("text") != ""), 0, "text", none("int", "io_type"), none(ENTRY, "carrier")).unionByName(anchor(ends, 1, "name", io, none(ENTRY, "carrier"))).unionByName(anchor(entries, 2, "name", io, own))
    texts = labels.where(F.trim("text") != "").select("doc_id", F.trim("text").alias("t"), "ord", _point().alias("a"))
    first = texts.groupBy("doc_id", "t").agg(F.min_by("a", "ord").alias("b"))
    label = _roots(_places(hard, anchors), segments(wires), texts.join(first, ["doc_id", "t"]).select("a", "b"))
    groups = anchors.where("name <> ''").withColumn("node", _point()).join(label, "node").groupBy("root").agg(
        F.min_by("name", F.struct("priority", "name")).alias("best"), F.min_by("io_type", F.when(F.col("io_type").isNotNull(), F.struct("priority", "name"))).alias("io_type"), F.array_sort(F.collect_set("carrier")).alias("carriers")
    )
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("ord")).cast("string")
    found = connectors.withColumn("n", number).withColumn("node", _point()).join(label, "node").join(groups, "root", "left")
    return found.select("doc_id", F.col("ord").alias("connector"), F.coalesce("best", _filled("harness_type"), F.concat(F.lit("HARNESS"), "n")).alias("bundle"), F.coalesce("io_type", F.lit(0)).alias("io_type"), F.coalesce("carriers", F.array().cast(f"array<{ENTRY}>")).alias("carriers"))


def nets(
    pins: DataFrame, wires: DataFrame, labels: DataFrame, power: DataFrame, ports: DataFrame, junctions: DataFrame, bus_entries: DataFrame | None = None,
    sheet_entries: DataFrame | None = None, signal_harnesses: DataFrame | None = None, connectors: DataFrame | None = None, harness_entries: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, net, auto, members, ports, entries): sorted, distinct pins (designator, pad), port names and sheet entries of each net.

    ``pins``: (doc_id, designator, pad, x, y) with ends and pads resolved; ``labels``, ``power``: (…, text, x, y);
    ``ports``: (…, name, x, y, width, style[, io_type, harness_type]); ``wires`` and ``signal_harnesses``: (…, vertices);
    ``bus_entries``: (…, x, y, corner_x, corner_y); ``sheet_entries``: (…, sheet_symbol, file_name, name, io_type,
    harness_type, x, y); ``connectors``: as ``bundles`` has them; ``harness_entries``: (…, connector, name, x, y). The
    points of entries and connectors are those of ``edge_point``. A label outranks a power object, which outranks a port,
    which outranks a harness signal (``bundle.entry``); nets without a name are numbered by their least point among those
    that have a pin, a port or a sheet entry. Nets of one name on a sheet are one net. Automatic nets with fewer than two
    members go, and nets with neither pins nor sheet entries and fewer than two ports. As numbers are given before that,
    they may have gaps. Ports of a harness carry bundles and belong to no net.
    """
    if signal_harnesses is not None:
        wires = wires.select("doc_id", "vertices").unionByName(signal_harnesses.select("doc_id", "vertices"))
    bundled = F.coalesce(F.trim("harness_type"), F.lit("")) != "" if "harness_type" in ports.columns else F.lit(False)
    if "io_type" not in ports.columns:
        ports = ports.withColumn("io_type", F.lit(0))
    plain = ports.where(~bundled)
    points = [pins, junctions, labels, power, wires.select("doc_id", F.explode("vertices").alias("v")).select("doc_id", F.col("v.x").alias("x"), F.col("v.y").alias("y"))]
    more = None
    if bus_entries is not None:  # a bus entry joins its two ends
        points += [bus_entries, bus_entries.select("doc_id", F.col("corner_x").alias("x"), F.col("corner_y").alias("y"))]
        more = bus_entries.select(_point().alias("a"), _point("corner_x", "corner_y").alias("b"))
    if sheet_entries is not None:
        points.append(sheet_entries.where(F.trim("name") != ""))
    if harness_entries is not None:
        points.append(harness_entries)
    hard = _places(*points)
    ends = _snapped(plain, hard)
    nodes = written(_places(hard, ends), "nodes")
    label = _roots(nodes, segments(wires), more)
    rooted = lambda df: df.withColumn("node", _point()).join(label, "node").drop("node")
    pin_rows = rooted(pins).select("root", F.struct("designator", "pad").alias("pin"))
    port_rows = rooted(ends.where(F.trim("name") != "")).select("root", "ord", F.trim("name").alias("name"))
    named = lambda df, k: rooted(df).select("root", F.lit(k).alias("priority"), "ord", _filled("text").alias("name"))
    order = ["root", "priority", "ord", "name"]
    candidates = named(labels, 0).unionByName(named(power, 1)).unionByName(port_rows.withColumn("priority", F.lit(2)).select(*order)).withColumn("second", F.lit(0))
    port_rows = port_rows.select("root", "name")
    entry_rows = None
    if sheet_entries is not None:
        entry_rows = rooted(sheet_entries.where(F.trim("name") != "")).select("root", F.struct("sheet_symbol", "file_name", F.trim("name").alias("entry"), F.col("io_type").cast("int").alias("io_type")).cast(ENTRY).alias("entry"))
    if connectors is not None and harness_entries is not None:
        carried = lambda df: df.where(F.coalesce(F.trim("harness_type"), F.lit("")) != "")
        none = labels.limit(0).select("doc_id", "x", "y", F.lit("").alias("name"), F.lit("").alias("sheet_symbol"), F.lit("").alias("file_name"), F.lit(0).alias("io_type"))
        groups = bundles(connectors, labels, ports.where(bundled), none if sheet_entries is None else carried(sheet_entries), junctions, wires)
        signals = rooted(harness_entries.where(F.trim("name") != "").join(groups, ["doc_id", "connector"]))
        full = F.concat_ws(".", "bundle", F.trim("name"))
        candidates = candidates.unionByName(signals.select("root", F.lit(3).alias("priority"), F.col("connector").alias("ord"), full.alias("name"), F.col("ord").alias("second")))
        port_rows = port_rows.unionByName(signals.select("root", full.alias("name")))
        fanned = signals.select("root", F.trim("name").alias("name"), F.explode("carriers").alias("c"))
        fanned = fanned.select("root", F.struct(F.col("c.sheet_symbol"), F.col("c.file_name"), F.concat_ws(".", "c.entry", "name").alias("entry"), F.col("c.io_type")).cast(ENTRY).alias("entry"))
        entry_rows = fanned if entry_rows is None else entry_rows.unionByName(fanned)
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    pin_kind = "struct<designator:string,pad:string>"
    members = pin_rows.select("root", "pin", no("string", "port"), no(ENTRY, "entry")).unionByName(port_rows.select("root", no(pin_kind, "pin"), F.col("name").alias("port"), no(ENTRY, "entry")))
    if entry_rows is not None:
        members = members.unionByName(entry_rows.select("root", no(pin_kind, "pin"), no("string", "port"), "entry"))
    members = written(members, "members")
    carrying = members.select("root").distinct()
    names = named_by_sheet(candidates.join(carrying, "root", "left_semi"), carrying)
    found = members.join(names, "root").groupBy(F.col("root.doc_id").alias("doc_id"), F.col("name").alias("net")).agg(F.bool_or("auto").alias("auto"), *(F.array_sort(F.collect_set(c)).alias(n) for c, n in (("pin", "members"), ("port", "ports"), ("entry", "entries"))))
    n_pins, n_ports, n_entries = F.size("members"), F.size("ports"), F.size("entries")
    return found.where(~(F.col("auto") & (n_pins + n_ports + n_entries < 2)) & ~((n_pins + n_entries == 0) & (n_ports < 2)))


def folded(found: DataFrame, with_entries: bool = False, with_ports: bool = False) -> DataFrame:
    """``nets`` with sheet entries and ports among the members, as pads of their sheet symbol and of PORT."""
    lists = [F.col("members")]
    pad = lambda d, p: F.struct(d.alias("designator"), p.alias("pad"))
    if with_entries:
        lists.append(F.transform("entries", lambda e: pad(e["sheet_symbol"], e["entry"])))
    if with_ports:
        lists.append(F.transform("ports", lambda p: pad(F.lit("PORT"), p)))
    return found.withColumn("members", F.array_sort(F.array_distinct(F.concat(*lists))))


def named_by_sheet(candidates: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, name, auto); automatic numbers start at 1 on each sheet."""
    named = candidates.where("name is not null").groupBy("root").agg(F.min_by("name", F.struct("priority", "ord", "second")).alias("name"))
    unnamed = roots.join(named, "root", "left_anti")
    number = F.row_number().over(W.partitionBy("root.doc_id").orderBy("root.x", "root.y")).cast("string")  # a sheet's nets
    auto = unnamed.withColumn("__n", number).select("root", F.concat(F.lit("N"), F.when(F.length("__n") < 5, F.lpad("__n", 5, "0")).otherwise(F.col("__n"))).alias("name"), F.lit(True).alias("auto"))
    return named.withColumn("auto", F.lit(False)).unionByName(auto)
