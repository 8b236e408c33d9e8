"""Primitives of board files: records cut from the primitive streams, their fields read by SQL expressions."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binary, params, units
from ..functions.bits import has_bit
from ..functions.text import code_points

#: Object kinds by their byte, and how many blocks follow it (others: one).
KINDS = {1: "arc", 2: "pad", 3: "via", 4: "track", 5: "text", 6: "fill", 11: "region", 12: "body"}
BLOCKS = {2: 6, 5: 2}
#: Flag bits; the first is set on what is not locked.
FLAGS = {"is_polygon_outline": 0x02, "is_teardrop": 0x10, "is_tenting_top": 0x20, "is_tenting_bottom": 0x40, "is_testpoint_top": 0x80, "is_testpoint_bottom": 0x100, "is_keepout": 0x200}
UNLOCKED, ABSENT, PREFIX = 0x04, 0xFFFF, 13
#: Records, and bytes of their blocks, that go back from Python together: streams are of any length, from a record up.
FRAME_ROWS, FRAME_BYTES = 10_000, 8 << 20


def cut(data: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(kind, blocks) of each record; ends where the data does, or where no known kind stands."""
    at = 0
    while at < len(data) and data[at] in KINDS:
        kind, parts = data[at], []
        at += 1
        for _ in range(BLOCKS.get(kind, 1)):
            if at + 4 > len(data):
                return
            size = struct.unpack_from("<I", data, at)[0] & 0xFFFFFF
            if at + 4 + size > len(data):
                return
            parts.append(data[at + 4 : at + 4 + size])
            at += 4 + size
        yield kind, parts


def raw_records(streams: DataFrame) -> DataFrame:
    """(path, storage, ord, kind, blocks array<binary>) of the primitive streams among ``streams``."""

    columns = {"path": pa.string(), "storage": pa.string(), "ord": pa.int32(), "kind": pa.int32(), "blocks": pa.list_(pa.binary())}

    def framed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, of) for values, of in zip(zip(*rows), columns.values())], list(columns))

    def slice_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for path, storage, data in zip(*(b.column(k).to_pylist() for k in ("path", "storage", "data"))):
                for place, (kind, parts) in enumerate(cut(data or b"")):  # a filter before would work out data that is put together once more
                    rows.append((path, storage, place, kind, parts))
                    size += sum(map(len, parts))
                    if len(rows) >= FRAME_ROWS or size >= FRAME_BYTES:
                        yield framed(rows)
                        rows, size = [], 0
        if rows:
            yield framed(rows)

    return streams.select("path", "storage", "data").mapInArrow(slice_, "path string, storage string, ord int, kind int, blocks array<binary>")


def main_block(blocks: Column = None, kind: Column = None) -> Column:
    """A pad's fifth block, of the others the first."""
    blocks, kind = F.col("blocks") if blocks is None else blocks, F.col("kind") if kind is None else kind
    return F.when(kind == 2, F.get(blocks, F.lit(4))).otherwise(F.get(blocks, F.lit(0)))


def prefix(b: Column) -> list[Column]:
    """Layer, net (from 1; 0 is none), component (from 0; -1 is none) and flags, as all primitives begin."""
    net, component, flags = binary.unsigned(b, 3, 2), binary.unsigned(b, 7, 2), binary.unsigned(b, 1, 2)
    return [
        binary.unsigned(b, 0, 1).cast("int").alias("layer"),
        F.when(net == ABSENT, 0).otherwise(net + 1).cast("int").alias("net_index"),
        F.when(component == ABSENT, -1).otherwise(component).cast("int").alias("component_index"),
        (~has_bit(flags, UNLOCKED)).alias("is_locked"),
        *(has_bit(flags, bit).alias(name) for name, bit in FLAGS.items()),
    ]


def _of(records: DataFrame, kind: int) -> tuple[DataFrame, Column]:
    rows = records.where(F.col("kind") == kind).withColumn("__b", F.explode(F.array(main_block()))).where(F.octet_length("__b") >= PREFIX)  # a generator, so that the block is not worked out again for each field
    return rows, F.col("__b")


def _ints(b: Column, offset: int, *names: str) -> list[Column]:
    return [binary.int32(b, offset + 4 * i).alias(n) for i, n in enumerate(names)]


def arcs(records: DataFrame) -> DataFrame:
    rows, b = _of(records, 1)
    return rows.select("path", "storage", "ord", *prefix(b), *_ints(b, 13, "x", "y", "radius"), binary.double(b, 25).alias("start_angle"), binary.double(b, 33).alias("end_angle"), binary.int32(b, 41).alias("width"))


def pads(records: DataFrame) -> DataFrame:
    rows, b = _of(records, 2)
    name = binary.pascal(F.get("blocks", F.lit(0))).cast("string")
    sizes = _ints(b, 13, "x", "y", "x_size_top", "y_size_top", "x_size_middle", "y_size_middle", "x_size_bottom", "y_size_bottom", "hole_size")
    shapes = [binary.unsigned(b, 49 + i, 1).cast("int").alias(f"shape_{n}") for i, n in enumerate(("top", "middle", "bottom"))]
    return rows.select("path", "storage", "ord", name.alias("designator"), *prefix(b), *sizes, *shapes, binary.double(b, 52).alias("rotation"), (binary.unsigned(b, 60, 1) != 0).alias("is_plated"))


def vias(records: DataFrame) -> DataFrame:
    rows, b = _of(records, 3)
    return rows.select("path", "storage", "ord", *prefix(b), *_ints(b, 13, "x", "y", "diameter", "hole_size"), *(binary.unsigned(b, 29 + i, 1).cast("int").alias(n) for i, n in enumerate(("start_layer", "end_layer"))))


def tracks(records: DataFrame) -> DataFrame:
    """The sub-net index behind the fields, where there is one, comes before the prefix's net."""
    rows, b = _of(records, 4)
    sub = F.when(F.octet_length(b) >= 36, binary.unsigned(b, 33, 2))
    found = rows.select("path", "storage", "ord", *prefix(b), *_ints(b, 13, "x0", "y0", "x1", "y1", "width"), sub.cast("int").alias("__sub"))
    return found.withColumn("net_index", F.when((F.col("__sub") != 0) & (F.col("__sub") != ABSENT), F.col("__sub")).otherwise(F.col("net_index"))).drop("__sub")


def fills(records: DataFrame) -> DataFrame:
    rows, b = _of(records, 6)
    return rows.select("path", "storage", "ord", *prefix(b), *_ints(b, 13, "x0", "y0", "x1", "y1"), binary.double(b, 29).alias("rotation"))


def texts(records: DataFrame) -> DataFrame:
    rows, b = _of(records, 5)
    return rows.select("path", "storage", "ord", *prefix(b), *_ints(b, 13, "x", "y", "height"), binary.pascal(F.get("blocks", F.lit(1))).cast("string").alias("text"))


def param_records(blocks: DataFrame) -> DataFrame:
    """(path, storage, ord, params) of streams whose blocks are parameter records, ended by a zero byte."""
    from .text import decoded

    body = F.regexp_replace(decoded(F.col("payload")), "\x00.*$", "")
    return blocks.select("path", "storage", "ord", params.parse(body).alias("params"))


def with_names(prims: DataFrame, nets: DataFrame) -> DataFrame:
    """Primitives with the name of their net, by its position (path, ord, name); null where there is none."""
    side = nets.select("path", (F.col("ord") + 1).alias("net_index"), F.col("name").alias("net"))
    return prims.join(side, ["path", "net_index"], "left")


def utf16(data: Column) -> Column:
    return F.decode(data, "UTF-16LE")


def wide_strings(streams: DataFrame) -> DataFrame:
    """(path, index, text) of side tables (path, data): parameters ENCODEDTEXT0, 1, ... of decimal code points up to the first that is missing, where the fifth byte is ``|``; else entries of index, size and UTF-16 with its end, the last of an index counting."""
    streams = streams.select("path", F.explode(F.array("data")).alias("data"))  # a generator, so that data that is put together is not worked out again for the filters
    tagged = F.substring(F.col("data"), F.lit(5), F.lit(1)) == F.lit(b"|")
    listed = params.indexed(params.parse(F.regexp_replace(F.decode(F.substring(F.col("data"), F.lit(5), F.octet_length("data")), "ISO-8859-1"), "\x00.*$", "")), "ENCODEDTEXT")
    older = streams.where(tagged).select("path", F.posexplode(listed).alias("index", "encoded")).select("path", "index", code_points(F.col("encoded")).alias("text"))

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, index, text) for path, data in zip(b["path"], b["data"]) for index, text in {e["index"]: e["text"] for e in wide_entries(data)}.items()]
            yield pd.DataFrame(rows, columns=("path", "index", "text"))

    newer = streams.where(~tagged).mapInPandas(entries, "path string, index int, text string")
    return older.unionByName(newer)


def wide_entries(data: bytes) -> Iterator[dict]:
    at = 0
    while at + 8 <= len(data):
        index, size = struct.unpack_from("<II", data, at)
        at += 8
        text = ""
        if size > 2:
            if at + size > len(data):
                return
            text = data[at : at + size - 2].decode("utf-16-le", "replace")
            at += size
        yield {"index": index, "text": text}


def parameter_blocks(data: bytes) -> list[bytes] | None:
    """The blocks behind a first byte, each after its size, without a zero at its end; null if one overruns the data."""
    at, out = 1, []
    while at + 4 <= len(data):
        size = struct.unpack_from("<I", data, at)[0]
        at += 4
        if at + size > len(data):
            return None
        out.append(data[at : at + size].removesuffix(b"\0"))
        at += size
    return out


def component_parameters(streams: DataFrame) -> DataFrame:
    """(path, ord, params) of the parameter blocks of an integrated library's component streams (path, data); a broken stream has one row, its params null."""
    from .text import decoded

    def blocks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([parameter_blocks(bytes(d)) for d in b], dtype=object)

    udf = F.pandas_udf(blocks, "array<binary>")
    rows = streams.where("data is not null").select("path", F.posexplode_outer(F.coalesce(udf("data"), F.array(F.lit(None).cast("binary")))).alias("ord", "block"))
    return rows.where("ord is not null").select("path", "ord", F.when(F.col("block").isNotNull(), params.parse(decoded(F.col("block")))).alias("params"))


# -- regions and bodies: their corners are of varying number, so Python cuts them in Arrow batches

_POINTS = "array<struct<x:int,y:int>>"
_EXACT = "array<struct<x:double,y:double>>"
_VERTEX = "array<struct<is_round:boolean,x:int,y:int,cx:int,cy:int,radius:int,start_angle:double,end_angle:double>>"
#: The same as Arrow has them.
_POINTS_ARROW, _EXACT_ARROW = (pa.list_(pa.struct([("x", number), ("y", number)])) for number in (pa.int32(), pa.float64()))
_VERTEX_ARROW = pa.list_(pa.struct([("is_round", pa.bool_()), *((k, pa.int32()) for k in ("x", "y", "cx", "cy", "radius")), *((k, pa.float64()) for k in ("start_angle", "end_angle"))]))
#: Fixed value: bytes between the prefix and the parameters.
GAP = 5


def _whole(v: float, rounded: bool) -> int:
    """A coordinate, half away from zero or towards zero, held in the range of INT; 0 for what is no number."""
    if v != v:
        return 0
    held = min(max(v, -(2.0**31)), 2.0**31 - 1)
    return int(math.copysign(math.floor(abs(held) + 0.5), held)) if rounded else int(held)


def _framed(data: bytes) -> tuple[bytes, int]:
    """The parameter text behind the prefix, and where what follows begins."""
    at = PREFIX + GAP
    size = struct.unpack_from("<I", data, at)[0] & 0xFFFFFF
    if at + 4 + size > len(data):
        raise struct.error("parameters overrun the record")
    return data[at + 4 : at + 4 + size].split(b"\0", 1)[0], at + 4 + size


def _hole_count(record: bytes) -> int:
    for pair in record.split(b"|"):
        key, _, value = pair.partition(b"=")
        if key.upper() == b"HOLECOUNT":
            return max(int(value), 0) if value.strip().lstrip(b"+-").isdigit() else 0
    return 0


def _doubles(data: bytes, at: int, n: int) -> list[tuple[float, float]]:
    flat = struct.unpack_from(f"<{2 * n}d", data, at)
    return list(zip(flat[::2], flat[1::2]))


def outlined(data: bytes, rounded: bool) -> dict | None:
    """Parameters, outline and holes; holes end where the record does. Null for a record that is empty or too short."""
    try:
        record, at = _framed(data)
        n = struct.unpack_from("<I", data, at)[0]
        if n * 16 > len(data) - at - 4:
            return None
        point = lambda p: {"x": _whole(p[0], rounded), "y": _whole(p[1], rounded)}
        outline, holes = [point(p) for p in _doubles(data, at + 4, n)], []
        at += 4 + 16 * n
        for _ in range(_hole_count(record)):
            if at + 4 > len(data) or (n := struct.unpack_from("<I", data, at)[0]) * 16 > len(data) - at - 4:
                break
            holes.append([point(p) for p in _doubles(data, at + 4, n)])
            at += 4 + 16 * n
        return {"record": record, "outline": outline, "holes": holes}
    except struct.error:
        return None


def shaped(data: bytes) -> dict:
    """Parameters, vertices with the closing one, and holes; or what is wrong."""
    none = {"record": None, "vertices": None, "holes": None}
    try:
        record, at = _framed(data)
        n = struct.unpack_from("<I", data, at)[0] + 1
        at += 4
        if n * 37 > len(data) - at:
            return none | {"error": "more vertices than the record holds"}
        names = ("is_round", "x", "y", "cx", "cy", "radius", "start_angle", "end_angle")
        vertices = [dict(zip(names, struct.unpack_from("<?5i2d", data, at + 37 * i))) for i in range(n)]
        at += 37 * n
        holes = []
        for _ in range(_hole_count(record)):
            n = struct.unpack_from("<I", data, at)[0]
            if n * 16 > len(data) - at - 4:
                return none | {"error": "a hole with more vertices than the record holds"}
            holes.append([{"x": x, "y": y} for x, y in _doubles(data, at + 4, n)])
            at += 4 + 16 * n
        return {"record": record, "vertices": vertices, "holes": holes, "error": None}
    except struct.error:
        return none | {"error": "the record is too short"}


def _cut_by(f, **kind: pa.DataType):
    """``f`` of each record as structs of ``kind``, which Arrow makes at once: by way of frames each corner would be converted by itself."""
    of = pa.struct(list(kind.items()))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([f(d) if d is not None else None for d in b.to_pylist()], of)

    return run


def _outlined(records: DataFrame, kind: int, rounded: bool) -> DataFrame:
    from .text import decoded

    rows, b = _of(records, kind)
    run = _cut_by(lambda d: outlined(d, rounded), record=pa.binary(), outline=_POINTS_ARROW, holes=pa.list_(_POINTS_ARROW))
    udf = F.arrow_udf(run, f"record binary, outline {_POINTS}, holes array<{_POINTS}>")
    # Generators, so that neither the cut nor the parse is done again for the filter and for each parameter.
    found = rows.select("path", "storage", "ord", "__b", F.explode(F.array(udf("__b"))).alias("s")).where("s.record is not null")
    found = found.withColumn("params", F.explode(F.array(params.parse(decoded(F.col("s.record"))))))
    return found.select("path", "storage", "ord", *prefix(b), "params", "s.outline", "s.holes")


def regions(records: DataFrame) -> DataFrame:
    """Regions with their parameters: kind, place among a polygon's parts (-1 for none), name and cavity height beside the rest."""
    found, p = _outlined(records, 11, True), F.col("params")
    number = lambda k, d: F.coalesce(params.as_int(params.first(p, k)), F.lit(d))
    return found.select("*", number("KIND", 0).alias("region_kind"), number("SUBPOLYINDEX", -1).alias("sub_poly_index"), params.first(p, "NAME").alias("name"), params.first(p, "NET").alias("net"), params.as_explicit_bool(params.first(p, "ISSHAPEBASED")).alias("is_shape_based"))


def bodies(records: DataFrame) -> DataFrame:
    """Component bodies; corners are cut towards zero. Lengths are texts with a unit; the model's checksum may be written without a sign."""
    found, p = _outlined(records, 12, False), F.col("params")
    text = lambda k: params.first(p, k)
    length = lambda k: F.coalesce(units.parse_length(text(k)), F.lit(0))
    number = lambda k: F.coalesce(params.as_double(text(k)), F.lit(0.0))
    wide = F.trim(text("MODEL.CHECKSUM")).try_cast("bigint")
    return found.select(
        "*", text("NAME").alias("name"), text("V7_LAYER").alias("layer_name"), length("STANDOFFHEIGHT").alias("standoff_height"), length("OVERALLHEIGHT").alias("overall_height"), text("MODELID").alias("model_id"),
        params.as_explicit_bool(text("MODEL.EMBED")).alias("model_embed"), length("MODEL.2D.X").alias("model_x"), length("MODEL.2D.Y").alias("model_y"), number("MODEL.2D.ROTATION").alias("model_rotation"),
        *(number(f"MODEL.3D.ROT{a}").alias(f"model_rotation_{a.lower()}") for a in "XYZ"), length("MODEL.3D.DZ").alias("model_dz"), F.when(wide >= 2**31, wide - 2**32).otherwise(wide).cast("int").alias("model_checksum"),
    )


def shape_regions(records: DataFrame) -> DataFrame:
    """Regions whose vertices carry their arcs, of a stream of their own; ``error`` says what is wrong with a record."""
    from .text import decoded

    rows, b = _of(records, 11)
    udf = F.arrow_udf(_cut_by(shaped, record=pa.binary(), vertices=_VERTEX_ARROW, holes=pa.list_(_EXACT_ARROW), error=pa.string()), f"record binary, vertices {_VERTEX}, holes array<{_EXACT}>, error string")
    found = rows.select("path", "storage", "ord", *prefix(b), udf("__b").alias("s"))
    return found.withColumn("params", F.when(F.col("s.record").isNotNull(), params.parse(decoded(F.col("s.record"))))).withColumn("vertices", F.col("s.vertices")).withColumn("holes", F.col("s.holes")).withColumn("error", F.col("s.error")).drop("s")
