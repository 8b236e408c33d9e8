"""Layers by number and by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of a stack's layers by ranges of their ids in the newer form.
KINDS = (
    (0x01000000, 0x0101FFFF, "copper"), (0x01040000, 0x0104FFFF, "dielectric"), (0x0103000A, 0x0103000B, "solder mask"),
    (0x01030008, 0x01030009, "paste"), (0x01030006, 0x01030007, "overlay"),
)
#: Drawing priorities by ranges of layer numbers, the least drawn first; other layers have 50.
PRIORITIES = (
    (1, 1, 6), (2, 31, 6), (32, 32, 0), (33, 33, 2), (34, 34, 3), (35, 35, 7), (36, 36, 2), (37, 37, 9), (38, 38, 1), (39, 54, 11),
    (55, 55, 12), (56, 56, 13), (57, 72, 14), (73, 73, 15), (74, 74, 1), (81, 82, 1),
)
#: A text's place within its box by the byte that stores it, from 1; 0 is by hand.
JUSTIFICATIONS = ("TopLeft", "MiddleLeft", "BottomLeft", "TopCenter", "MiddleCenter", "BottomCenter", "TopRight", "MiddleRight", "BottomRight")


def _ranged(value: Column, ranges: tuple, other) -> Column:
    out = F.lit(other)
    for low, high, found in ranges:
        out = F.when(value.between(low, high), found).otherwise(out)
    return out


def kind_of(layer_id: Column) -> Column:
    return _ranged(layer_id, KINDS, "other")


def draw_priority(layer: Column) -> Column:
    return _ranged(layer, PRIORITIES, 50)


def justification(byte: Column) -> Column:
    """The name of a text's place; null by hand and for bytes that are none."""
    return F.when(byte >= 1, F.get(F.array(*map(F.lit, JUSTIFICATIONS)), byte.cast("int") - 1))


def justification_byte(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, JUSTIFICATIONS)), name).cast("int")


def normal_name(name: Column) -> Column:
    """A layer's name without spaces and hyphens, in capitals, as names are compared."""
    return F.upper(F.translate(name, " -", ""))


#: Numbers of layers by their normal names, numbered series as (prefix, how many, number of the first less one).
NUMBERS = {
    "TOPLAYER": 1, "TOP": 1, "BOTTOMLAYER": 32, "BOTTOM": 32, "TOPOVERLAY": 33, "BOTTOMOVERLAY": 34, "TOPPASTE": 35, "BOTTOMPASTE": 36, "TOPSOLDER": 37, "BOTTOMSOLDER": 38,
    "DRILLGUIDE": 55, "KEEPOUTLAYER": 56, "KEEPOUT": 56, "DRILLDRAWING": 73, "MULTILAYER": 74,
}
SERIES = (("MECHANICAL", 16, 56), ("MIDLAYER", 30, 1), ("MID", 30, 1), ("INTERNALPLANE", 16, 38), ("PLANE", 16, 38))
#: Names that records have for layers with several, and for numbers that are none.
WRITTEN, NAMELESS = {1: "TOPLAYER", 32: "BOTTOMLAYER", 56: "KEEPOUTLAYER"}, "MECHANICAL1"
WRITTEN_SERIES = (("MECHANICAL", 16, 56), ("MID", 30, 1), ("INTERNALPLANE", 16, 38))


def number_of(name: Column) -> Column:
    """A layer's number by its name, in any case and spacing; 0 for no known name."""
    normal = normal_name(name)
    out = F.lit(0)
    for known, number in NUMBERS.items():
        out = F.when(normal == known, number).otherwise(out)
    for prefix, count, before in SERIES:
        n = F.regexp_extract(normal, f"^{prefix}([+]?[0-9]+)$", 1).try_cast("int")
        out = F.when(n.between(1, count), n + before).otherwise(out)
    return F.coalesce(out, F.lit(0)).cast("int")


def name_of(number: Column) -> Column:
    """The name that records have for a layer's number."""
    out = F.lit(NAMELESS)
    for known, n in NUMBERS.items():
        out = F.when(number == n, WRITTEN.get(n, known)).otherwise(out)
    for prefix, count, before in WRITTEN_SERIES:
        out = F.when(number.between(before + 1, before + count), F.concat(F.lit(prefix), (number - before).cast("int").cast("string"))).otherwise(out)
    return out


#: IPC-4761 names of via structures by their number.
VIA_STRUCTURES = ("none", "I-a", "I-b", "II-a", "II-b", "III-a", "III-b", "IV-a", "IV-b", "V", "VI-a", "VI-b", "VII")


def via_structure(number: Column) -> Column:
    known = F.get(F.array(*map(F.lit, VIA_STRUCTURES)), number.cast("int"))
    return F.coalesce(known, F.concat(F.lit("unknown ("), number.cast("string"), F.lit(")")))
