"""Schematic sheets: typed tables from the parameter records of a sheet's stream, and the netlist over them.

``records``: (doc_id, pos, params), ``pos`` being the record's place in the stream. A file header without a RECORD key
at place 0 is not counted by the owner references of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import params, schema
from ..functions.bits import let
from ..functions.shared import written
from ..operators import schematic

UNIT = 100_000
#: Record numbers.
COMPONENT, PIN, SHEET_SYMBOL, SHEET_ENTRY, POWER, PORT, LABEL, WIRE, JUNCTION, BUS_ENTRY, PARAMETER, IMPLEMENTATION_LIST, IMPLEMENTATION, MAP_LIST, MAP = 1, 2, 15, 16, 17, 18, 25, 27, 29, 37, 41, 44, 45, 46, 47
SHEET_NAME, FILE_NAME = 32, 33
CONNECTOR, HARNESS_ENTRY, HARNESS_TYPE, SIGNAL_HARNESS = 215, 216, 217, 218
#: Fixed value: grid units of a step in which entries' distances are given.
SLOT = 10
#: Keys of sheet records, as {column: (key, how to read it)}.
SHEET_RECORDS: dict[int, dict[str, tuple[str, str]]] = {
    COMPONENT: {
        "lib_reference": ("LIBREFERENCE", "text"), "description": ("COMPONENTDESCRIPTION", "text"), "display_mode_count": ("DISPLAYMODECOUNT", "int"), "display_mode": ("DISPLAYMODE", "int"),
        "current_part_id": ("CURRENTPARTID", "int"), "designator_prefix": ("DESIGNATORPREFIX", "text"),
    },
    PIN: {"name": ("NAME", "text"), "designator": ("DESIGNATOR", "text"), "conglomerate": ("PINCONGLOMERATE", "int"), "electrical": ("ELECTRICAL", "int"), "part": ("OWNERPARTID", "int"), "mode": ("OWNERPARTDISPLAYMODE", "int")},
    SHEET_SYMBOL: {"file_name": ("FILENAME", "text"), "sheet_name": ("SHEETNAME", "text")},
    SHEET_ENTRY: {"side": ("SIDE", "int"), "name": ("NAME", "text"), "io_type": ("IOTYPE", "int"), "harness_type": ("HARNESSTYPE", "text")},
    POWER: {"text": ("TEXT", "text"), "style": ("STYLE", "int")},
    PORT: {"name": ("NAME", "text"), "style": ("STYLE", "int"), "io_type": ("IOTYPE", "int"), "harness_type": ("HARNESSTYPE", "text")},
    LABEL: {"text": ("TEXT", "text")},
    JUNCTION: {},
    BUS_ENTRY: {},
    PARAMETER: {"name": ("NAME", "text"), "value": ("TEXT", "text")},
    IMPLEMENTATION: {"model_name": ("MODELNAME", "text"), "model_type": ("MODELTYPE", "text"), "is_current": ("ISCURRENT", "bool")},
    MAP: {"pad": ("DESINTF", "text")},
    CONNECTOR: {"side": ("HARNESSCONNECTORSIDE", "int")},
    HARNESS_ENTRY: {"side": ("SIDE", "int"), "name": ("NAME", "text")},
    HARNESS_TYPE: {"text": ("TEXT", "text")},
}


def length(p: Column, key: str) -> Column:
    """Whole units and their fraction, as raw."""
    part = lambda k: F.coalesce(params.as_int(params.first(p, k)), F.lit(0)).cast("bigint")
    return (part(key) * UNIT + part(f"{key}_FRAC")).cast("int")


def placed(records: DataFrame) -> DataFrame:
    """``records`` with ``kind``, ``ord`` as owners count, and ``owner``."""
    p = F.col("params")
    kind = params.as_int(params.first(p, "RECORD"))
    headless = records.where((F.col("pos") == 0) & kind.isNull()).select("doc_id", F.lit(1).alias("__h")).distinct()
    found = records.join(headless, "doc_id", "left").withColumn("ord", F.col("pos") - F.coalesce("__h", F.lit(0))).drop("__h")
    return found.withColumn("kind", kind).withColumn("owner", params.as_int(params.first(p, "OWNERINDEX"))).where("kind is not null")


def of(rows: DataFrame, kind: int, **more: Column) -> DataFrame:
    """(doc_id, ord, owner, x, y, ...) of one kind of record."""
    p = F.col("params")
    spec = SHEET_RECORDS[kind]
    return rows.where(F.col("kind") == kind).select("doc_id", "ord", "owner", length(p, "LOCATION.X").alias("x"), length(p, "LOCATION.Y").alias("y"), *(schema.column(p, k, how).alias(n) for n, (k, how) in spec.items()), *(c.alias(n) for n, c in more.items()))


def with_component(rows: DataFrame) -> DataFrame:
    """``rows`` with the component that each record names as its owner, or else, for pins, the last one before it."""
    is_component = F.col("kind") == COMPONENT
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    owners = rows.where(is_component).select("doc_id", F.col("ord").alias("owner"), F.col("ord").alias("__owner"))
    before = F.when(F.col("kind") == PIN, F.last(F.when(is_component, F.col("ord")), ignorenulls=True).over(w))
    return rows.withColumn("__before", before).join(owners, ["doc_id", "owner"], "left").withColumn("component_ord", F.coalesce("__owner", "__before")).drop("__owner", "__before")


def components(rows: DataFrame) -> DataFrame:
    """Components with ``designator``: the first non-empty parameter of that name in any case, else the prefix and '?', else the library reference."""
    found = of(rows, COMPONENT)
    named = of(rows, PARAMETER).where((F.lower("name") == "designator") & (F.col("value") != "")).groupBy("doc_id", F.col("owner").alias("ord")).agg(F.min_by("value", F.col("ord")).alias("__d"))
    prefix = F.when(F.col("designator_prefix") != "", F.concat(F.col("designator_prefix"), F.lit("?")))
    return found.join(named, ["doc_id", "ord"], "left").withColumn("designator", F.coalesce("__d", prefix, "lib_reference")).drop("__d")


def footprints(rows: DataFrame) -> DataFrame:
    """(doc_id, ord, footprint) of components: the Footprint parameter, else the current, the first PCBLIB, or the first model."""
    named = of(rows, PARAMETER).where((F.lower("name") == "footprint") & (F.col("value") != "")).groupBy("doc_id", F.col("owner").alias("ord")).agg(F.min_by("value", F.col("ord")).alias("named"))
    rank = F.when(F.upper("model_type") != "PCBLIB", 2).when(F.col("is_current"), 0).otherwise(1)
    lists = rows.where(F.col("kind") == IMPLEMENTATION_LIST).select("doc_id", F.col("ord").alias("owner"), F.col("owner").alias("component_ord"))
    models = of(rows, IMPLEMENTATION).join(lists, ["doc_id", "owner"]).groupBy("doc_id", F.col("component_ord").alias("ord")).agg(F.min_by("model_name", F.struct(F.coalesce(rank, F.lit(2)).alias("r"), "ord")).alias("model"))
    return rows.where(F.col("kind") == COMPONENT).select("doc_id", "ord").join(named, ["doc_id", "ord"], "left").join(models, ["doc_id", "ord"], "left").select("doc_id", "ord", F.coalesce("named", "model").alias("footprint"))


def pad_maps(rows: DataFrame) -> DataFrame:
    """(doc_id, component_ord, ord, pad, pads) of the current PCBLIB implementation's map definers."""
    p = F.col("params")
    lists = rows.where(F.col("kind") == IMPLEMENTATION_LIST).select("doc_id", F.col("ord").alias("owner"), F.col("owner").alias("component_ord"))
    current = of(rows, IMPLEMENTATION).where((F.upper("model_type") == "PCBLIB") & F.col("is_current")).join(lists, ["doc_id", "owner"]).select("doc_id", F.col("ord").alias("implementation"), "component_ord")
    map_lists = rows.where(F.col("kind") == MAP_LIST).select("doc_id", F.col("ord").alias("owner"), F.col("owner").alias("implementation"))
    found = of(rows, MAP, pads=params.indexed(p, "DESIMP")).join(map_lists, ["doc_id", "owner"]).join(current, ["doc_id", "implementation"])
    return found.where("pad is not null").select("doc_id", "component_ord", "ord", "pad", "pads")


def _distance(p: Column) -> Column:
    """Of an entry from the start of its edge: whole slots of ten units, and a fraction."""
    part = lambda k: F.coalesce(params.as_int(params.first(p, k)), F.lit(0)).cast("bigint")
    return (part("DISTANCEFROMTOP") * (SLOT * UNIT) + part("DISTANCEFROMTOP_FRAC")).cast("int")


def _on_edge(entries: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """``entries`` (doc_id, ``key``, side, distance) with x and y on the edge of their box (doc_id, ``key``, bx, by, x_size, y_size)."""
    x, y = schematic.edge_point(*(F.col(c) for c in ("bx", "by", "x_size", "y_size", "side", "distance")))
    return entries.drop("x", "y").join(boxes, ["doc_id", key]).withColumn("x", x).withColumn("y", y).drop("bx", "by", "x_size", "y_size")


def _under(rows: DataFrame, kind: int, name: str) -> DataFrame:
    """``rows`` with the last record of ``kind`` at or before each, as entries follow what they belong to."""
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(name, F.last(F.when(F.col("kind") == kind, F.col("ord")), ignorenulls=True).over(w))


def sheet_entries(rows: DataFrame) -> DataFrame:
    """(doc_id, ord, sheet_symbol, file_name, name, io_type, harness_type, x, y) of the entries of sheet symbols."""
    p = F.col("params")
    box = of(rows, SHEET_SYMBOL, x_size=length(p, "XSIZE"), y_size=length(p, "YSIZE")).select("doc_id", F.col("ord").alias("symbol"), F.col("x").alias("bx"), F.col("y").alias("by"), "x_size", "y_size")
    owner = _under(rows, SHEET_SYMBOL, "symbol").where(F.col("kind") == SHEET_ENTRY).select("doc_id", "ord", "symbol")
    found = _on_edge(of(rows, SHEET_ENTRY, distance=_distance(p)).join(owner, ["doc_id", "ord"]), box, "symbol")
    names = symbol_identity(rows).select("doc_id", F.col("ord").alias("symbol"), F.col("name").alias("sheet_symbol"), "file_name")
    return found.join(names, ["doc_id", "symbol"]).select("doc_id", "ord", "sheet_symbol", "file_name", F.coalesce("name", F.lit("")).alias("name"), "io_type", "harness_type", "x", "y")


def harnesses(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Connectors (doc_id, ord, harness_type, x, y) by their primary points, and their entries (doc_id, connector, ord, name, x, y)."""
    p = F.col("params")
    under = _under(rows, CONNECTOR, "connector")
    kinds = under.where(F.col("kind") == HARNESS_TYPE).select("doc_id", "connector", "pos", params.first(p, "TEXT").alias("text"))
    kinds = kinds.groupBy("doc_id", "connector").agg(F.max_by("text", "pos").alias("harness_type"))
    found = of(rows, CONNECTOR, x_size=length(p, "XSIZE"), y_size=length(p, "YSIZE"), distance=length(p, "PRIMARYCONNECTIONPOSITION")).withColumn("connector", F.col("ord"))
    box = found.select("doc_id", "connector", F.col("x").alias("bx"), F.col("y").alias("by"), "x_size", "y_size")
    owner = under.where(F.col("kind") == HARNESS_ENTRY).select("doc_id", "ord", "connector")
    entries = _on_edge(of(rows, HARNESS_ENTRY, distance=_distance(p)).join(owner, ["doc_id", "ord"]), box, "connector")
    connectors = _on_edge(found.drop("x_size", "y_size"), box, "connector").join(kinds, ["doc_id", "connector"], "left")
    return connectors.select("doc_id", "ord", "harness_type", "x", "y"), entries.select("doc_id", "connector", "ord", F.coalesce("name", F.lit("")).alias("name"), "x", "y")


def netlist(records: DataFrame) -> DataFrame:
    """The nets of each sheet, as ``schematic.nets`` gives them."""
    rows = written(placed(records), "records")
    p = F.col("params")
    owned = with_component(rows)
    parts = components(rows).select("doc_id", F.col("ord").alias("component_ord"), F.col("designator").alias("refdes"), "current_part_id", "display_mode", "display_mode_count")
    extra = owned.where(F.col("kind") == PIN).select("doc_id", "ord", "component_ord", length(p, "PINLENGTH").alias("length"))
    pins = of(rows, PIN).join(extra, ["doc_id", "ord"]).join(parts, ["doc_id", "component_ord"])
    pins = pins.where(schematic.visible(F.col("part"), F.col("current_part_id"), F.col("mode"), F.col("display_mode"), F.col("display_mode_count")))
    pins = pins.withColumn("pad", F.coalesce("designator", "name")).where("pad <> ''").withColumn("orientation", F.col("conglomerate").bitwiseAND(F.lit(3)))
    pins = schematic.fan_out(schematic.pin_end(pins), pad_maps(rows)).select("doc_id", F.col("refdes").alias("designator"), "pad", "x", "y")
    lines = lambda kind: rows.where(F.col("kind") == kind).select("doc_id", "ord", params.vertices(p, F.coalesce(params.as_int(params.first(p, "LOCATIONCOUNT")), F.lit(0))).alias("vertices"))
    ports = of(rows, PORT, width=length(p, "WIDTH"))
    bus = of(rows, BUS_ENTRY, corner_x=length(p, "CORNER.X"), corner_y=length(p, "CORNER.Y"))
    pins, wires = written(pins, "pins"), written(lines(WIRE), "wires")
    connectors, harness_entries = harnesses(rows)
    entries = written(sheet_entries(rows), "entries")
    return schematic.nets(pins, wires, of(rows, LABEL), of(rows, POWER), ports, of(rows, JUNCTION), bus, entries, lines(SIGNAL_HARNESS), written(connectors, "connectors"), written(harness_entries, "harness_entries"))


def symbol_identity(rows: DataFrame) -> DataFrame:
    """(doc_id, ord, name, file_name) of sheet symbols.

    The annotation that names the owner of the symbol's entries; else, within two grid steps of ten units, the nearest
    one (for names, to a point a step above the corner; ties to the first); else the record's own text; else SHEETn.
    """
    p = F.col("params")
    text = F.trim(params.first(p, "TEXT"))
    notes = rows.where(F.col("kind").isin(SHEET_NAME, FILE_NAME) & (text != "")).select("doc_id", "kind", "owner", F.col("ord").alias("note"), text.alias("text"), (params.as_int(params.first(p, "LOCATION.X")).cast("bigint") * UNIT).alias("nx"), (params.as_int(params.first(p, "LOCATION.Y")).cast("bigint") * UNIT).alias("ny"))
    symbols = of(rows, SHEET_SYMBOL).drop("owner").withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("ord")))
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    within = rows.withColumn("symbol", F.last(F.when(F.col("kind") == SHEET_SYMBOL, F.col("ord")), ignorenulls=True).over(w))
    owners = within.where((F.col("kind") == SHEET_ENTRY) & (F.col("owner") > 0)).groupBy("doc_id", F.col("symbol").alias("ord")).agg(F.min_by("owner", "ord").alias("owner"))
    owned = lambda kind, out: owners.join(notes.where(F.col("kind") == kind), ["doc_id", "owner"]).groupBy("doc_id", "ord").agg(F.min_by("text", "note").alias(out))
    step = 10 * UNIT

    def near(kind: int, out: str, above: int) -> DataFrame:
        """They meet by cells as wide as the reach: a note goes to the nine around it."""
        cell = lambda c: F.floor(c / (2 * step))
        around = lambda c: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: cell(F.col(c)) + i))
        spread = notes.where(F.col("kind") == kind).select("doc_id", "note", "text", "nx", "ny").withColumn("cx", around("nx")).withColumn("cy", around("ny"))
        places = symbols.select("doc_id", "ord", "x", (F.col("y").cast("bigint") + above).alias("y")).withColumn("cx", cell(F.col("x"))).withColumn("cy", cell(F.col("y")))
        d = F.abs(F.col("nx") - F.col("x")) + F.abs(F.col("ny") - F.col("y"))
        return places.join(spread, ["doc_id", "cx", "cy"]).withColumn("d", d).where(F.col("d") <= 2 * step).groupBy("doc_id", "ord").agg(F.min_by("text", F.struct("d", "note")).alias(out))

    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    out = symbols
    for side in (owned(SHEET_NAME, "a"), near(SHEET_NAME, "b", step), owned(FILE_NAME, "c"), near(FILE_NAME, "e", 0)):
        out = out.join(side, ["doc_id", "ord"], "left")
    name = F.coalesce("a", "b", filled("sheet_name"), filled("file_name"), F.concat(F.lit("SHEET"), F.col("n").cast("string")))
    return out.select("doc_id", "ord", name.alias("name"), F.coalesce("c", "e", filled("file_name")).alias("file_name"))


#: Fields of a binary pin in their order, as (parameter, size in bytes; 0 for a string after its length; negative if signed).
PIN_FIELDS = (
    ("RECORD", -4), (None, 1), ("OWNERPARTID", -2), ("OWNERPARTDISPLAYMODE", 1), ("SYMBOL_INNEREDGE", 1), ("SYMBOL_OUTEREDGE", 1), ("SYMBOL_INSIDE", 1), ("SYMBOL_OUTSIDE", 1),
    ("DESCRIPTION", 0), ("FORMALTYPE", 1), ("ELECTRICAL", 1), ("PINCONGLOMERATE", 1), ("PINLENGTH", -2), ("LOCATION.X", -2), ("LOCATION.Y", -2), ("COLOR", -4),
    ("NAME", 0), ("DESIGNATOR", 0), ("SWAPIDGROUP", 0), (None, 0), ("DEFAULTVALUE", 0),
)


def binary_pins(rows: DataFrame, body: str = "body") -> DataFrame:
    """``rows`` with ``params``, a binary pin's fields as parameters like those of a text record; null where it is no pin or too short.

    The places of the fields follow from the lengths of the strings before them: a struct that walks over the body.
    """
    from ..functions import binary
    from .text import decoded

    data, at = F.col(body), F.lit(0)
    out = rows
    pairs = []
    for k, (name, size) in enumerate(PIN_FIELDS):
        start = f"__at{k}"
        out = out.withColumn(start, at)
        here = F.col(start)
        if size:
            value = (binary.signed if size < 0 else binary.unsigned)(data, here, abs(size)).cast("string")
            at = here + abs(size)
        else:
            n = binary.unsigned(data, here, 1).cast("int")
            value = F.when(F.octet_length(data) >= here + 1 + n, decoded(F.substring(data, here + 2, n)))
            at = here + 1 + n
        if name:
            pairs.append(F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(False).alias("is_utf8")))
    is_pin = binary.signed(data, 0, 4) == PIN
    whole = let(F.array(*pairs), lambda found: F.when(F.forall(found, lambda p: p["value"].isNotNull()), found))
    return out.withColumn("params", F.when(is_pin, whole)).drop(*(f"__at{k}" for k in range(len(PIN_FIELDS))))
