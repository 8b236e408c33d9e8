"""Further registered queries: readers, reports, netlists and board operators over the driver's tables, each beside its SQL.

Binary readers get records that are put together from a table's columns, so their SQL is a plain selection of those.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, layers, params, text, units
from ..operators import boxes, dedup, flatten, models, netlist, ordering, reports, resolve, schematic, spatial, stack
from ..sources import board, sheet, sinks
from ..sources import text as texts
from .workload import query, t

# -- little-endian bytes


def le(value: Column, size: int) -> Column:
    """A number's lowest bytes."""
    digits = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(size))))


def raw(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def doubles(index: Column, values: tuple[float, ...]) -> Column:
    """The bytes of the ``index``-th of a few doubles."""
    return F.unhex(F.element_at(F.array(*(F.lit(struct.pack("<d", v).hex()) for v in values)), index + 1))


def block(*fields: Column) -> Column:
    data = F.concat(*fields)
    return F.concat(le(F.octet_length(data), 4), data)


def head(layer: Column, flags: Column, net: Column, component: Column) -> Column:
    return F.concat(le(layer, 1), le(flags, 2), le(net, 2), raw(b"\xff\xff"), le(component, 2), raw(b"\xff\xff\xff\xff"))


TURNS = (0.0, 45.0, 90.0, 271.5)
_TURN = "CAST(CASE p_partkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 45.0 WHEN 2 THEN 90.0 ELSE 271.5 END AS DOUBLE)"
_HEAD = """CAST(p_size AS INTEGER) AS layer, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE CAST(p_partkey % 1000 + 1 AS INTEGER) END AS net_index,
CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE CAST(p_partkey % 300 AS INTEGER) END AS component_index, p_size % 2 = 0 AS is_locked, p_size % 3 = 0 AS is_keepout"""
_CENTS = "CAST(round(p_retailprice * 100) AS INTEGER)"
KEPT = ("layer", "net_index", "component_index", "is_locked", "is_keepout")


def _records(spark: SparkSession, sf_dir: str, kind: int, *blocks: Column) -> DataFrame:
    """The records of one primitive for each part, cut from streams of their bytes; a file of few row groups is dealt to all cores first."""
    rows = t(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism, "p_partkey").select(F.col("p_partkey").cast("string").alias("path"), F.lit("Data").alias("storage"), F.concat(le(F.lit(kind), 1), *blocks).alias("data"))
    return board.raw_records(rows)


def _head() -> Column:
    k = F.col("p_partkey")
    flags = F.when(F.col("p_size") % 2 == 0, 0).otherwise(board.UNLOCKED) + F.when(F.col("p_size") % 3 == 0, 0x200).otherwise(0)
    return head(F.col("p_size"), flags, F.when(k % 7 == 0, 0xFFFF).otherwise(k % 1000), F.when(k % 5 == 0, 0xFFFF).otherwise(k % 300))


def _ints(*values: Column) -> Column:
    return F.concat(*(le(v, 4) for v in values))


def _cents() -> Column:
    return F.round(F.col("p_retailprice") * 100).cast("int")


def _part(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.col("path").cast("bigint").alias("p_partkey"), *columns)


@query(f"SELECT p_partkey, {_HEAD}, {_CENTS} AS x, -{_CENTS} AS y, p_size * 1000 AS radius, {_TURN} AS start_angle, {_TURN.replace('p_partkey', '(p_partkey + 1)')} AS end_angle, p_size AS width FROM part")
def board_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = _records(spark, sf_dir, 1, block(_head(), _ints(_cents(), -_cents(), F.col("p_size") * 1000), doubles((k % 4).cast("int"), TURNS), doubles(((k + 1) % 4).cast("int"), TURNS), _ints(F.col("p_size"))))
    return _part(board.arcs(rows), *KEPT, "x", "y", "radius", "start_angle", "end_angle", "width")


@query(f"""SELECT p_partkey, p_brand AS designator, {_HEAD}, {_CENTS} AS x, -{_CENTS} AS y, p_size * 10 AS x_size_top, p_size * 20 AS y_size_top, p_size * 70 AS hole_size,
CAST(p_size % 9 AS INTEGER) AS shape_top, {_TURN} AS rotation, p_size % 2 = 1 AS is_plated FROM part""")
def board_pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    name = block(le(F.octet_length("p_brand"), 1), F.col("p_brand").cast("binary"))
    main = block(_head(), _ints(_cents(), -_cents(), *(n * 10 * k for k in range(1, 8))), le(n % 9, 1), raw(b"\x01\x02"), doubles((F.col("p_partkey") % 4).cast("int"), TURNS), le(n % 2, 1))
    empty = raw(b"\0\0\0\0")
    return _part(board.pads(_records(spark, sf_dir, 2, name, empty, empty, empty, main, empty)), "designator", *KEPT, "x", "y", "x_size_top", "y_size_top", "hole_size", "shape_top", "rotation", "is_plated")


@query(f"SELECT p_partkey, {_HEAD}, {_CENTS} AS x, -{_CENTS} AS y, p_size * 100 AS diameter, p_size * 50 AS hole_size, CAST(1 AS INTEGER) AS start_layer, CAST(p_size % 33 AS INTEGER) AS end_layer FROM part")
def board_vias(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return _part(board.vias(_records(spark, sf_dir, 3, block(_head(), _ints(_cents(), -_cents(), n * 100, n * 50), le(F.lit(1), 1), le(n % 33, 1)))), *KEPT, "x", "y", "diameter", "hole_size", "start_layer", "end_layer")


@query(f"""SELECT p_partkey, layer, CASE WHEN sub BETWEEN 1 AND 65534 THEN CAST(sub AS INTEGER) ELSE net_index END AS net_index, component_index, is_locked, is_keepout, x0, y0, x1, y1, width FROM (
SELECT p_partkey, {_HEAD}, {_CENTS} AS x0, -{_CENTS} AS y0, {_CENTS} + p_size AS x1, p_size AS y1, p_size * 3 AS width, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 65535 ELSE p_size END AS sub FROM part)""")
def board_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size"), F.col("p_partkey")
    sub = F.when(k % 3 == 0, 0).when(k % 3 == 1, 0xFFFF).otherwise(n)
    return _part(board.tracks(_records(spark, sf_dir, 4, block(_head(), _ints(_cents(), -_cents(), _cents() + n, n, n * 3), le(sub, 2), raw(b"\0")))), *KEPT, "x0", "y0", "x1", "y1", "width")


@query(f"SELECT p_partkey, {_HEAD}, {_CENTS} AS x0, -{_CENTS} AS y0, {_CENTS} + p_size AS x1, p_size AS y1, {_TURN} AS rotation FROM part")
def board_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return _part(board.fills(_records(spark, sf_dir, 6, block(_head(), _ints(_cents(), -_cents(), _cents() + n, n), doubles((F.col("p_partkey") % 4).cast("int"), TURNS)))), *KEPT, "x0", "y0", "x1", "y1", "rotation")


@query(f"SELECT p_partkey, {_HEAD}, {_CENTS} AS x, -{_CENTS} AS y, p_size * 5 AS height, p_name AS text FROM part")
def board_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = block(le(F.octet_length("p_name"), 1), F.col("p_name").cast("binary"))
    return _part(board.texts(_records(spark, sf_dir, 5, block(_head(), _ints(_cents(), -_cents(), F.col("p_size") * 5)), words)), *KEPT, "x", "y", "height", "text")


CORNERS = (0.0, 1000.5, -1000.5, 999.4)


def _corners(*index: int) -> Column:
    return F.concat(*(raw(struct.pack("<dd", CORNERS[i], CORNERS[(i + 1) % 4])) for i in index))


def _shape(pairs: str, *rest: Column) -> Column:
    record = F.concat(F.lit(pairs), F.lit("|NAME="), F.col("p_name"))
    return block(_head(), raw(b"\0" * board.GAP), block(record.cast("binary"), raw(b"\0")), *rest)


@query(f"SELECT p_partkey, {_HEAD}, p_name AS name, CAST(p_size % 3 - 1 AS INTEGER) AS sub_poly_index, CAST(1001 AS INTEGER) AS x, CAST(-1001 AS INTEGER) AS y, CAST(2 AS INTEGER) AS hole, CAST(999 AS INTEGER) AS hole_x FROM part")
def board_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = block(_head(), raw(b"\0" * board.GAP), block(F.concat(F.lit("|KIND=0|HOLECOUNT=1|SUBPOLYINDEX="), (F.col("p_size") % 3 - 1).cast("string"), F.lit("|NAME="), F.col("p_name")).cast("binary"), raw(b"\0")), le(F.lit(3), 4), _corners(0, 1, 2), le(F.lit(2), 4), _corners(3, 0))
    found = board.regions(_records(spark, sf_dir, 11, data))
    v, h = F.col("outline"), F.col("holes")
    return _part(found.select("path", *KEPT, "name", "sub_poly_index", v[1]["x"].alias("x"), v[1]["y"].alias("y"), F.size(h[0]).alias("hole"), h[0][0]["x"].alias("hole_x")), *KEPT, "name", "sub_poly_index", "x", "y", "hole", "hole_x")


@query(f"SELECT p_partkey, {_HEAD}, p_name AS name, CAST(1000 AS INTEGER) AS x, CAST(-1000 AS INTEGER) AS y, CAST(150000 AS INTEGER) AS overall_height, CAST(-1 AS INTEGER) AS model_checksum, CAST(12.5 AS DOUBLE) AS model_rotation_z FROM part")
def board_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = board.bodies(_records(spark, sf_dir, 12, _shape("|OVERALLHEIGHT=15mil|MODEL.CHECKSUM=4294967295|MODEL.3D.ROTZ=12.500", le(F.lit(2), 4), _corners(1, 2))))
    return _part(found.select("path", *KEPT, "name", F.col("outline")[0]["x"].alias("x"), F.col("outline")[0]["y"].alias("y"), "overall_height", "model_checksum", "model_rotation_z"), *KEPT, "name", "x", "y", "overall_height", "model_checksum", "model_rotation_z")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_name END AS name, CASE WHEN p_size % 4 <> 0 THEN CAST(2 AS INTEGER) END AS vertices, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS INTEGER) END AS cx, CASE WHEN p_size % 4 <> 0 THEN CAST(90.0 AS DOUBLE) END AS end_angle,
CASE WHEN p_size % 4 = 0 THEN 'more vertices than the record holds' END AS error FROM part""")
def board_shape_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    vertex = F.concat(raw(b"\x01"), _ints(n * 2, n * 3, n, -n, n * 5), raw(struct.pack("<dd", 0.0, 90.0)))
    found = board.shape_regions(_records(spark, sf_dir, 11, _shape("|KIND=0", le(F.when(n % 4 == 0, 7).otherwise(1), 4), vertex, vertex)))
    v = F.col("vertices")
    return _part(found.select("path", params.first(F.col("params"), "NAME").alias("name"), F.when(v.isNotNull(), F.size(v)).alias("vertices"), v[1]["cx"].alias("cx"), v[0]["end_angle"].alias("end_angle"), "error"), "name", "vertices", "cx", "end_angle", "error")


@query("SELECT s_suppkey, n_name AS net, CAST(s_nationkey + 1 AS INTEGER) AS net_index FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20")
def net_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    prims = t(spark, sf_dir, "supplier").select("s_suppkey", F.lit("b").alias("path"), (F.col("s_nationkey") + 1).cast("int").alias("net_index"))
    nets = t(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.lit("b").alias("path"), F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("name"))
    return board.with_names(prims, nets).select("s_suppkey", "net", "net_index")


@query("""SELECT p_partkey, CAST(i AS INTEGER) AS "index", CASE i WHEN 0 THEN p_brand WHEN 1 THEN 'é' || p_size ELSE '' END AS text FROM part, range(0, 3) r(i)""")
def wide_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd parts have the older form, even ones the newer."""
    words = F.array(F.col("p_brand"), F.concat(F.lit("é"), F.col("p_size").cast("string")), F.lit(""))
    codes = lambda w: F.array_join(F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10)), ",")
    older = F.concat(F.lit("|").cast("binary"), F.array_join(F.transform(words, lambda w, i: F.concat(F.lit("ENCODEDTEXT"), i.cast("string"), F.lit("="), codes(w))), "|").cast("binary"), raw(b"\0"))
    entry = lambda i: F.concat(le(F.lit(i), 4), le(F.octet_length(F.encode(words[i], "UTF-16LE")) + 2, 4), F.encode(words[i], "UTF-16LE"), raw(b"\0\0"))
    newer = F.concat(entry(0), entry(1), raw(b"\x02\0\0\0\0\0\0\0"))
    data = F.when(F.col("p_partkey") % 2 == 1, F.concat(le(F.octet_length(older), 4), older)).otherwise(newer)
    rows = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), data.alias("data"))
    return board.wide_strings(rows).select(F.col("path").cast("bigint").alias("p_partkey"), "index", "text")


@query("SELECT p_partkey, p_name AS name, p_type AS kind FROM part")
def parameter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda k, c: block(F.concat(F.lit(f"|{k}="), F.col(c)).cast("binary"), raw(b"\0"))
    rows = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(raw(b"\0"), one("Name", "p_name"), one("Type", "p_type")).alias("data"))
    found = board.component_parameters(rows)
    p = F.col("params")
    return found.groupBy(F.col("path").cast("bigint").alias("p_partkey")).agg(F.max(params.first(p, "NAME")).alias("name"), F.max(params.first(p, "TYPE")).alias("kind"))


@query("SELECT p_partkey, p_name AS name, p_brand AS designator, CAST(p_size - 25 AS INTEGER) AS x, CAST(p_size * 7 AS INTEGER) AS length, CAST(p_size % 5 AS INTEGER) AS part FROM part")
def binary_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    word = lambda c: F.concat(le(F.octet_length(c), 1), c.cast("binary"))
    body = F.concat(le(F.lit(2), 4), raw(b"\0"), le(n % 5, 2), raw(b"\x01\0\0\0\0"), word(F.col("p_type")), raw(b"\x01\x04\x3a"), le(n * 7, 2), le(n - 25, 2), le(n, 2), le(F.lit(128), 4), word(F.col("p_name")), word(F.col("p_brand")), raw(b"\0\0\0"))
    found = sheet.binary_pins(t(spark, sf_dir, "part").select("p_partkey", body.alias("body")))
    p = F.col("params")
    number = lambda k: params.as_int(params.first(p, k))
    return found.select("p_partkey", params.first(p, "NAME").alias("name"), params.first(p, "DESIGNATOR").alias("designator"), number("LOCATION.X").alias("x"), number("PINLENGTH").alias("length"), number("OWNERPARTID").alias("part"))


# -- texts


@query("""
SELECT o_orderkey, 'Document' || l_linenumber AS section, CAST(l_linenumber AS INTEGER) AS n, arg_max(' ' || l_returnflag || '=' || l_suppkey, (l_partkey, l_suppkey)) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, l_linenumber""")
def ini_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each order; sections that repeat count once, their last value of a key that repeats."""
    line = F.col("l_linenumber").cast("string")
    part = F.concat(F.lit("[Document"), line, F.lit("]\r\n\r\nstray\r\nPath=old\r\n  Path= "), F.col("l_returnflag"), F.lit("="), F.col("l_suppkey").cast("string"), F.lit("\r\n"))
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", part.alias("part"))
    entry = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "part")))
    docs = lines.groupBy("l_orderkey").agg(F.concat(F.lit("\ufeff"), F.array_join(F.transform(entry, lambda e: e["part"]), "")).alias("text"))
    docs = docs.join(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(F.col("l_orderkey").cast("string").alias("path"), "text")
    return texts.numbered(texts.ini(docs)).select(F.col("path").cast("bigint").alias("o_orderkey"), "section", F.col("n"), "value")


@query("SELECT 'key a before any section' AS error, count(*) AS n FROM part WHERE p_size % 2 = 0 UNION ALL SELECT NULL, count(*) FROM part WHERE p_size % 2 <> 0")
def ini_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("p_size") % 2 == 0, F.lit("a=1\n[S]\nb=2")).otherwise(F.lit("[S]\na=1\n[S]\nb=2"))
    docs = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), body.alias("text"))
    return texts.ini(docs).groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 'C' || p_size AS comment, p_brand || ', x' AS footprint, p_type AS component_kind FROM part")
def bom_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.concat(F.lit('"Comment=C'), F.col("p_size").cast("string"), F.lit('","Footprint='), F.col("p_brand"), F.lit(', x",component kind='), F.col("p_type"))
    body = F.concat(F.lit("|RECORD=Header\r\n|Record=CatalogItem|COMPONENTPARAMETERS="), inner, F.lit("\r\n"))
    docs = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), body.alias("text"))
    return texts.bom_items(texts.records(docs)).select(F.col("path").cast("bigint").alias("p_partkey"), "comment", "footprint", "component_kind")


@query("""SELECT n_nationkey, md5(string_agg('[' || s || ']' || chr(13) || chr(10) || 'Key=' || s || chr(13) || chr(10), '' ORDER BY k)) AS text
FROM (SELECT s_nationkey AS n_nationkey, s_suppkey AS k, s_name AS s FROM supplier) GROUP BY n_nationkey""")
def ini_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey").cast("int")
    rows = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("path"), F.col("s_name").alias("section"), n.alias("section_ord"), F.lit("Key").alias("key"), n.alias("key_ord"), F.col("s_name").alias("value"))
    return sinks.ini_text(rows).select(F.col("path").alias("n_nationkey"), F.md5(F.substring("text", F.lit(2), F.length("text"))).alias("text"))


@query("SELECT doc_id, upper(replace(replace(source, ' ', ''), '-', '')) AS normal, left(regexp_replace(source || ':' || doc_id || '/' || lang, '[/\\\\:!*?\"<>|]', '_', 'g'), 31) AS storage, replace(left(source || ':' || doc_id || '/' || lang, 31), '/', '_') AS footprint, 'a/UNSAFE/' || source AS safe, '&lt;' || doc_id || '&gt;' AS xml FROM documents")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    name = F.concat("source", F.lit(":"), i, F.lit("/"), "lang")
    return t(spark, sf_dir, "documents").select("doc_id", layers.normal_name(F.col("source")).alias("normal"), text.section_key(name).alias("storage"), text.footprint_key(name).alias("footprint"), text.safe_path(F.concat(F.lit(".\\a/..//"), "source")).alias("safe"), text.quote_xml(F.concat(F.lit("<"), i, F.lit(">"))).alias("xml"))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE 'Brand' END AS resolved, CASE WHEN p_size % 2 = 0 THEN '"' || p_name || '"' ELSE p_brand END AS sexpr FROM part""")
def indirect_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("p_size") > 25, F.array(F.struct(F.lit("BRAND").alias("name"), F.col("p_brand").alias("value")))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    sexpr = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.regexp_replace("p_brand", " ", ""))
    return t(spark, sf_dir, "part").select("p_partkey", text.indirect(F.lit("=Brand"), given).alias("resolved"), text.quote_sexpr(sexpr).alias("sexpr"))


@query("SELECT p_partkey, p_brand AS plain, CAST(p_size AS VARCHAR) AS over FROM part")
def overlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.col("p_brand"), F.array_join(F.transform(F.filter(F.split(F.col("p_size").cast("string"), ""), lambda c: c != ""), lambda c: F.concat(c, F.lit("\\"))), ""))
    runs = t(spark, sf_dir, "part").select("p_partkey", text.overline_runs(marked).alias("r"))
    return runs.select("p_partkey", F.col("r")[0]["text"].alias("plain"), F.col("r")[1]["text"].alias("over"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS INTEGER) AS n_lines FROM (SELECT doc_id, lang || ' ' || source || ' x' AS text FROM documents)")
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So narrow that each word is a line."""
    return t(spark, sf_dir, "documents").select("doc_id", F.size(text.wrapped(F.concat_ws(" ", "lang", "source", F.lit("x")), F.lit(10.0), F.lit(1.0))).alias("n_lines"))


@query("SELECT doc_id, '{' || upper(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21)) || '}' AS guid, h AS back FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents)")
def guids(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("doc_id").cast("string"))
    data = text.guid_bytes(h)
    shown = text.guid_text(data)
    return t(spark, sf_dir, "documents").select("doc_id", shown.alias("guid"), F.lower(F.regexp_replace(text.guid_text(text.guid_bytes(shown)), "[{}-]", "")).alias("back"))


@query("""SELECT o_orderkey, month(d) || '/' || day(d) || '/' || year(d) AS us_date, strftime(d, '%d/%m/%Y') AS day_first, '12:00:00 AM' AS us_time, '00:00:00' AS time FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def date_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date").cast("timestamp")
    (us, us_time), (day, time) = text.us_stamp(d), text.day_first_stamp(d)
    return t(spark, sf_dir, "orders").select("o_orderkey", us.alias("us_date"), day.alias("day_first"), us_time.alias("us_time"), time.alias("time"))


@query("SELECT p_partkey, p_brand AS colour, CAST(2 AS INTEGER) AS n_entries, [CAST(p_size AS BIGINT)] AS shown FROM part")
def view_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    value = F.concat(F.lit("CFG2D.A=old`CFG3D.X=1`CFG2D.A="), F.col("p_brand"), F.lit("`CFG2D.SET=g~0_g.Include~Version=2,Class=T,"), n, F.lit("=1,99=0,"), n, F.lit("=1,x=1"))
    rows = t(spark, sf_dir, "part").select("p_partkey", text.config_entries(value, "CFG2D.").alias("e"))
    shown = F.filter(text.layers_shown(F.col("e")[1]["value"]), lambda x: x["shown"])
    return rows.select("p_partkey", F.col("e")[0]["value"].alias("colour"), F.size("e").alias("n_entries"), F.transform(shown, lambda x: x["layer"]).alias("shown"))


@query("SELECT p_partkey, p_size * 1000 AS x, CAST(p_retailprice AS INTEGER) * 100000 + 5 AS y, p_size + 1 AS last FROM (SELECT p_partkey, p_size, floor(p_retailprice) AS p_retailprice FROM part)".replace("p_size * 1000 AS x", "CAST(p_size AS INTEGER) * 100000 AS x").replace("p_size + 1 AS last", "(CAST(p_size AS INTEGER) + 1) * 100000 AS last"))
def vertex_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    record = F.concat(F.lit("|X1="), n, F.lit("|Y1="), F.floor("p_retailprice").cast("string"), F.lit("|Y1_FRAC=5|EXTRALOCATIONCOUNT=2|EX2="), (F.col("p_size") + 1).cast("string"), F.lit("|EY3=9"))
    rows = t(spark, sf_dir, "part").select("p_partkey", params.vertices(params.parse(record), F.lit(1)).alias("v"))
    v = F.col("v")
    return rows.select("p_partkey", v[0]["x"].alias("x"), v[0]["y"].alias("y"), v[1]["x"].alias("last"))


# -- lengths, layers, bits


@query("SELECT p_partkey, CAST(p_size AS INTEGER) * 10000 AS mil, CAST(p_size AS INTEGER) * 10000000 AS inch, CAST(p_size AS INTEGER) AS plain, CAST(p_size * 10 + 5 AS INTEGER) AS constant, p_size || '.' || (p_size % 9 + 1) AS trimmed, CAST(2147483647 AS INTEGER) AS held FROM part")
def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    text_of = lambda end: F.concat(F.lit(" "), n, F.lit(end))
    return t(spark, sf_dir, "part").select("p_partkey", units.parse_length(text_of("mil")).alias("mil"), units.parse_length(text_of("in")).alias("inch"), units.parse_length(n).alias("plain"), units.thousandths(F.concat((F.col("p_size") * 10 + 5).cast("string"), F.lit("e"))).alias("none"), units.thousandths(F.concat(F.lit("0."), F.lpad((F.col("p_size") * 10 + 5).cast("string"), 3, "0"))).alias("constant"), units.trimmed_decimal(F.concat(n, F.lit("."), (F.col("p_size") % 9 + 1).cast("string"), F.lit("00"))).alias("trimmed"), units.saturating_add(F.lit(2147483000), F.col("p_size") + 1000).alias("held")).drop("none")


@query("""SELECT p_partkey, CASE WHEN p_size = 32 THEN 'BottomLayer' ELSE 'TopLayer' END AS side,
CASE WHEN k % 6 = 0 THEN 'copper' WHEN k % 6 = 1 THEN 'dielectric' WHEN k % 6 = 2 THEN 'solder mask' WHEN k % 6 = 3 THEN 'paste' WHEN k % 6 = 4 THEN 'overlay' ELSE 'other' END AS kind FROM (SELECT p_partkey, p_size, p_partkey AS k FROM part)""")
def layer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides by layer number; kinds by ids of the newer form, of which each part has one."""
    ids = F.array(*map(F.lit, (0x01000001, 0x01040002, 0x0103000A, 0x01030009, 0x01030006, 0x01020000)))
    return t(spark, sf_dir, "part").select("p_partkey", reports.side(F.col("p_size"), 0).alias("side"), layers.kind_of(F.element_at(ids, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("kind"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dense_rank() OVER (ORDER BY CASE
  WHEN layer = 32 THEN 0 WHEN layer = 38 THEN 1 WHEN layer = 36 THEN 2 WHEN layer = 34 THEN 3 WHEN layer <= 31 AND layer >= 1 THEN 6 WHEN layer = 37 THEN 9 WHEN layer = 35 THEN 7
  WHEN layer = 33 THEN 2 WHEN layer = 74 THEN 1 WHEN layer BETWEEN 39 AND 54 THEN 11 WHEN layer = 55 THEN 12 WHEN layer = 56 THEN 13 WHEN layer BETWEEN 57 AND 72 THEN 14 WHEN layer = 73 THEN 15
  WHEN layer IN (81, 82) THEN 1 ELSE 50 END, l_linenumber % 3) AS draw
FROM (SELECT *, l_partkey % 90 AS layer FROM lineitem)""")
def draw_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", layers.draw_priority(F.col("l_partkey") % 90).alias("priority"), (F.col("l_linenumber") % 3).alias("type_ord"))
    return ordering.dense_rank_of(rows, ["priority", "type_ord"], "draw").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("draw").cast("bigint").alias("draw"))


@query("SELECT p_partkey, CASE k WHEN 1 THEN 'TopLeft' WHEN 2 THEN 'MiddleLeft' WHEN 3 THEN 'BottomLeft' WHEN 4 THEN 'TopCenter' WHEN 5 THEN 'MiddleCenter' WHEN 6 THEN 'BottomCenter' WHEN 7 THEN 'TopRight' WHEN 8 THEN 'MiddleRight' WHEN 9 THEN 'BottomRight' END AS place, CASE WHEN k BETWEEN 1 AND 9 THEN CAST(k AS INTEGER) END AS byte, CASE k WHEN 0 THEN 'none' WHEN 1 THEN 'I-a' WHEN 9 THEN 'V' WHEN 10 THEN 'VI-a' WHEN 2 THEN 'I-b' WHEN 3 THEN 'II-a' WHEN 4 THEN 'II-b' WHEN 5 THEN 'III-a' WHEN 6 THEN 'III-b' WHEN 7 THEN 'IV-a' ELSE 'IV-b' END AS structure FROM (SELECT p_partkey, p_partkey % 11 AS k FROM part)")
def code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 11
    place = layers.justification(k)
    return t(spark, sf_dir, "part").select("p_partkey", place.alias("place"), layers.justification_byte(place).alias("byte"), layers.via_structure(k).alias("structure"))


@query("SELECT c_custkey, CAST(coalesce(list_min(d), 18) AS INTEGER) AS first, CAST(len(d) AS INTEGER) AS n FROM (SELECT c_custkey, list_filter(range(0, 18), lambda i: c_name[i + 1] <> replace(c_name, '1', '7')[i + 1]) AS d FROM customer)")
def byte_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("c_name").cast("binary"), F.replace(F.col("c_name"), F.lit("1"), F.lit("7")).cast("binary")
    return t(spark, sf_dir, "customer").select("c_custkey", bits.first_difference(a, b).alias("first"), F.size(bits.differing(a, b)).alias("n"))


# -- reports


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return t(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("doc_id"), k.cast("int").alias("ord"), F.concat(F.lit("R"), k.cast("string")).alias("designator"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("c,"), k.cast("string"))).alias("comment"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.lit("SO8")).alias("pattern"), F.lit("fallback").alias("source_lib_reference"), F.lit("own").alias("name"), F.lit('5" disc').alias("description"),
        (k * 12500).cast("int").alias("x"), (k * -2500).cast("int").alias("y"), F.when(k % 2 == 0, 90.0).otherwise(22.5).alias("rotation"), F.when(k % 5 == 0, 32).otherwise(k % 5).cast("int").alias("layer"),
        F.when(k % 7 == 0, 5).when(k % 11 == 0, 2).otherwise(0).alias("component_kind"),
    )


_PLACED = """p AS (SELECT s_nationkey, s_suppkey AS k FROM supplier WHERE s_suppkey % 11 <> 0 OR s_suppkey % 7 = 0),
l AS (SELECT s_nationkey AS doc_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY k) AS INTEGER) AS ord, k,
  CASE WHEN k % 3 = 0 THEN 'fallback' ELSE '"c,' || k || '"' END AS comment, CASE WHEN k % 4 = 0 THEN 'own' ELSE 'SO8' END AS pattern, CASE WHEN k % 2 = 0 THEN '90' ELSE '22.50' END AS turn,
  CAST(k AS DECIMAL(18, 2)) * 1.25 AS x, CAST(k AS DECIMAL(18, 2)) * -0.25 AS y FROM p)"""


@query(f"""WITH {_PLACED}
SELECT doc_id, ord, 'R' || k || ',' || comment || ',' || CASE WHEN k % 5 = 0 THEN 'BottomLayer' ELSE 'TopLayer' END || ',' || pattern || ',' || printf('%.2f', x) || ',' || printf('%.2f', y) || ',' || turn || ',"5"" disc"' AS line FROM l
UNION ALL SELECT DISTINCT doc_id, 0, 'Designator,Comment,Layer,Footprint,Center-X(mil),Center-Y(mil),Rotation,Description' FROM l""")
def placement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.placement_texts(reports.placements(_components(spark, sf_dir), True), 0, "mil")


@query(f"""WITH {_PLACED}
SELECT doc_id, ord, 'R' || k || ',' || comment || ',' || pattern || ',' || printf('%.2f', x) || ',' || printf('%.2f', y) || ',' || turn || ',' || CASE WHEN k % 5 = 0 THEN 'bottom' ELSE 'top' END AS line FROM l
UNION ALL SELECT DISTINCT doc_id, 0, 'Ref,Val,Package,PosX,PosY,Rot,Side' FROM l""")
def placement_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.placement_texts(reports.placements(_components(spark, sf_dir), True), 2, "mil")


@query("""SELECT p_partkey AS ord, p_name || ';' || '"' || p_brand || ';x"' || ';' || p_size AS line FROM part""")
def bom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), "p_name", F.concat("p_brand", F.lit(";x")).alias("brand"), "p_size")
    return reports.bom_lines(rows, ["p_name", "brand", "p_size"], ";")


@query("""
WITH r AS (SELECT s_nationkey AS doc_id, s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'Clearance' ELSE 'Width' END AS kind, s_suppkey % 4 AS priority FROM supplier),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind, priority, 'R' || k, k) AS INTEGER) AS ord, lag(kind) OVER (PARTITION BY doc_id ORDER BY kind, priority, 'R' || k, k) AS before FROM r)
SELECT doc_id, ord, 0 AS part, '[' || kind || ']' AS line FROM o WHERE before IS DISTINCT FROM kind
UNION ALL SELECT doc_id, ord, 1, '  R' || k || ' (priority ' || priority || ')' || CASE WHEN k % 5 = 0 THEN ' [disabled]' ELSE '' END FROM o
UNION ALL SELECT doc_id, ord, 2, '    scope: All' || CASE WHEN k % 3 = 0 THEN '' ELSE '  vs  InNet' END FROM o
UNION ALL SELECT doc_id, ord, 4, '    GAP=' || k || 'mil' FROM o
UNION ALL SELECT doc_id, CAST(count(*) + 1 AS INTEGER), 0, count(*) || ' rule(s)' FROM r GROUP BY doc_id""")
def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    rows = t(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("doc_id"), k.alias("ord"), F.when(k % 2 == 0, "Clearance").otherwise("Width").alias("kind"), (k % 4).alias("priority"), F.concat(F.lit("R"), k.cast("string")).alias("name"), (k % 5 != 0).alias("enabled"),
        F.lit("All").alias("scope1"), F.when(k % 3 == 0, "").otherwise("InNet").alias("scope2"), F.lit("").alias("comment"), F.array(pair("Name", F.lit("x")), pair("GAP", F.concat(k.cast("string"), F.lit("mil"))), pair("EMPTY", F.lit(""))).alias("params"),
    )
    return reports.rule_texts(rows)


@query("""SELECT n_regionkey, '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS json FROM nation GROUP BY n_regionkey""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.as_documents(t(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name"), ["n_regionkey"], ["n_nationkey"])


# -- netlists of boards


def _board_nets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as boards: their suppliers are components, their lines pads, ship modes nets."""
    lines = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").cast("string").alias("s"), "l_suppkey", F.col("l_linenumber").cast("string").alias("designator"), F.col("l_returnflag").alias("net"))
    parts = lines.select("doc_id", F.col("l_suppkey").alias("ord"), F.concat(F.lit("U"), "s").alias("designator")).distinct()
    return netlist.board_netlist(parts, lines.select("doc_id", F.col("l_suppkey").alias("component_index"), "designator", "net", F.lit(0).alias("ord")))


_NETS = """n AS (SELECT l_orderkey AS doc_id, l_returnflag AS net, string_agg(DISTINCT m, ' ' ORDER BY m) AS members FROM (SELECT l_orderkey, l_returnflag, 'U' || l_suppkey || '-' || l_linenumber AS m FROM lineitem) GROUP BY ALL)"""


@query(f"WITH {_NETS} SELECT * FROM n")
def board_netlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, nets = _board_nets(spark, sf_dir)
    return nets.select("doc_id", "net", F.array_join(F.array_sort(F.transform("members", lambda m: F.concat_ws("-", m["designator"], m["pad"]))), " ").alias("members"))


@query("""SELECT l_orderkey AS doc_id, l_returnflag AS net, 'U' || l_suppkey AS designator, CAST(l_linenumber AS VARCHAR) AS pad FROM lineitem GROUP BY ALL""")
def netlist_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netlist.tsv_rows(_board_nets(spark, sf_dir)[1])


def _small_board(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations as boards, their suppliers as parts, each with one pad in a net of its own."""
    rows = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("ord"), F.concat(F.lit("U"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("designator"))
    parts = rows.select("*", F.lit("SO 8").alias("footprint"), F.lit("v").alias("value"), F.lit("ref").alias("library_reference"), F.lit(None).cast("string").alias("description"))
    nets = rows.select("doc_id", F.concat(F.lit("N"), "designator").alias("net"), F.array(F.struct("designator", F.lit("1").alias("pad"))).alias("members"))
    return parts, nets


_U = "(SELECT s_nationkey AS doc_id, s_suppkey AS k, 'U' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS d FROM supplier)"


@query(f"""SELECT doc_id, md5(string_agg('[' || e || d || e || 'SO 8' || e || 'v' || e || ']' || e, '' ORDER BY d) || string_agg('(' || e || 'N' || d || e || d || '-1' || e || ')' || e, '' ORDER BY d)) AS text
FROM (SELECT *, chr(13) || chr(10) AS e FROM {_U}) GROUP BY doc_id""")
def netlist_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netlist.protel(*_small_board(spark, sf_dir)).select("doc_id", F.md5("text").alias("text"))


@query(f"""SELECT doc_id, md5('(export (version D)' || e || '  (components' || e || string_agg('    (comp (ref ' || d || ')' || e || '      (value v)' || e || '      (footprint "SO 8"))' || e, '' ORDER BY k) || '  )' || e || '  (nets' || e
  || string_agg('    (net (code ' || n || ') (name N' || d || ')' || e || '      (node (ref ' || d || ') (pin 1))' || e || '    )' || e, '' ORDER BY n) || '  )' || e || ')' || e) AS text
FROM (SELECT *, chr(10) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS n FROM {_U}) GROUP BY doc_id, e""")
def netlist_sexpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netlist.kicad(*_small_board(spark, sf_dir)).select("doc_id", F.md5("text").alias("text"))


@query(f"""SELECT doc_id, md5('{{"components":[' || string_agg('{{"designator":"' || d || '","footprint":"SO 8","value":"v","library_reference":"ref","description":null}}', ',' ORDER BY k) || '],"nets":['
  || string_agg('{{"name":"N' || d || '","connections":[{{"designator":"' || d || '","pad":"1"}}]}}', ',' ORDER BY d) || ']}}') AS json FROM {_U} GROUP BY doc_id""")
def netlist_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netlist.as_json(*_small_board(spark, sf_dir)).select("doc_id", F.md5("json").alias("json"))


# -- lookups


@query("SELECT s_nationkey AS doc_id, s_suppkey AS ord, CASE WHEN s_suppkey % 3 = 0 THEN 'T' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'S' || s_suppkey ELSE s_name END AS designator FROM supplier")
def live_designators(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    rows = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), k.alias("ord"), F.col("s_name").alias("name"), F.when(k % 3 == 1, F.concat(F.lit("S"), n)).otherwise("").alias("source_designator"))
    shown = rows.where("ord % 3 = 0").select("doc_id", F.col("ord").alias("component_index"), F.explode(F.array(F.lit(" .Designator"), F.concat(F.lit(" T"), F.col("ord").cast("string")), F.lit("late"))).alias("text"), F.lit(True).alias("is_designator"))
    return resolve.live_designator(rows, shown.withColumn("ord", F.when(F.col("text") == "late", 9).otherwise(1))).select("doc_id", "ord", "designator")


@query("""SELECT p_partkey, CASE WHEN p_size = 1 THEN 'none' WHEN p_size <= 25 THEN 'resolved' ELSE 'unresolved' END AS state, CASE WHEN p_size BETWEEN 2 AND 25 THEN n_name END AS template
FROM part LEFT JOIN nation ON n_nationkey = p_size - 1""")
def via_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as vias: those of odd size find their template by the link table, the others by ids of their own."""
    n = F.col("p_size")
    own = F.when((n > 1) & (n % 2 == 0), n - 1)
    vias = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("via"), n.alias("size"), F.lit("lib").alias("library_id"), own.cast("string").alias("template_id"))
    links = t(spark, sf_dir, "part").where((n > 1) & (n % 2 == 1)).select(F.col("p_partkey").alias("via"), F.lit("lib").alias("library_id"), (n - 1).cast("string").alias("template_id"))
    names_ = t(spark, sf_dir, "nation").select(F.lit("lib").alias("library_id"), F.col("n_nationkey").cast("string").alias("template_id"), F.col("n_name").alias("name"))
    return resolve.with_template(vias, links, names_).select(F.col("via").alias("p_partkey"), "state", "template")


@query("""SELECT c_nationkey AS nation, c_custkey, s_suppkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)
JOIN (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS n2 FROM supplier) ON s_nationkey = c_nationkey AND n = n2""")
def zipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    b = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", (-F.col("s_suppkey")).alias("back"))
    return resolve.zipped(a, b, ["nation"], ["c_custkey"], ["back"]).select("nation", "c_custkey", "s_suppkey")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'r/X' || s_suppkey || '.lib' WHEN s_suppkey % 3 = 1 THEN 'r/x' || s_suppkey || '.lib' END AS file FROM supplier")
def referenced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey").cast("string")
    rows = t(spark, sf_dir, "supplier")
    refs = rows.select(F.col("s_suppkey").alias("ref"), F.concat(F.lit("c:\\Old\\X"), n, F.lit(".lib")).alias("path"))
    file = lambda letter: F.concat(F.lit(f"r/{letter}"), n, F.lit(".lib"))
    files = rows.where("s_suppkey % 3 = 0").select(file("X").alias("file"), F.lit(0).alias("root_ord")).unionByName(rows.where("s_suppkey % 3 <> 2").select(file("x").alias("file"), F.lit(0).alias("root_ord")))
    return resolve.best_file(refs, files).select(F.col("ref").alias("s_suppkey"), "file")


@query("SELECT c_custkey, CAST(CASE WHEN c_nationkey % 5 = 4 THEN 0 ELSE c_nationkey + 101 END AS INTEGER) AS net_index FROM customer")
def net_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    prims = t(spark, sf_dir, "customer").select("c_custkey", F.lit(1).alias("doc_id"), F.col("c_nationkey").cast("string").alias("net"))
    nets = t(spark, sf_dir, "nation").where("n_nationkey % 5 <> 4").select(F.lit(1).alias("doc_id"), F.explode(F.array(F.col("n_nationkey").cast("int"), (F.col("n_nationkey") + 100).cast("int"))).alias("ord"), F.col("n_nationkey").cast("string").alias("name"))
    return resolve.net_numbers(prims, nets).select("c_custkey", "net_index")


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY -turn) - 1 AS new FROM conversations)
SELECT r.conv_id, r.turn, CAST(r.new AS INTEGER) AS place, CAST(o.new AS INTEGER) AS owner FROM r LEFT JOIN r o ON o.conv_id = r.conv_id AND o.turn = r.turn - 1""")
def retargeted_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as records, each owned by the one before it, turned round."""
    rows = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), (F.col("turn") - 1).alias("owner"), F.col("turn").alias("was"), (-F.col("turn")).alias("back"))
    return resolve.retargeted(rows, ["back"]).select(F.col("doc_id").alias("conv_id"), F.col("was").alias("turn"), F.col("ord").alias("place"), "owner")


@query("SELECT conv_id, turn, CASE WHEN (row_number() OVER (PARTITION BY conv_id ORDER BY turn)) % 2 = 1 THEN 'even' END AS mark FROM conversations")
def slot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.lit("s").alias("storage"), F.col("turn").alias("ord"))
    side = rows.groupBy("path", "storage").agg(F.count("*").alias("n")).select("path", "storage", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"), F.lit(2))).alias("record_index"), F.lit("even").alias("mark"))
    return resolve.by_slot(rows, side, "mark").select(F.col("path").alias("conv_id"), F.col("ord").alias("turn"), "mark")


@query("SELECT n_regionkey, CAST(min(n_nationkey) AS INTEGER) AS n_nationkey FROM nation WHERE n_nationkey % 2 = 0 GROUP BY n_regionkey")
def named_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "nation").select("n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, "Even").otherwise("odd").alias("name"), F.col("n_nationkey").cast("int").alias("n_nationkey"))
    return resolve.named_or_first(rows, "name", "n_nationkey", "EVEN", ["n_regionkey"]).select("n_regionkey", "n_nationkey")


@query("SELECT p_partkey, CASE WHEN p_size <= 25 THEN CAST(p_size - 1 AS INTEGER) END AS pad, CASE WHEN p_size <= 25 THEN 1 ELSE 2 END AS left FROM part")
def region_pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.concat(F.lit("|A=1|PadIndex= "), F.col("p_size").cast("string"))
    regions = t(spark, sf_dir, "part").select(F.lit("b").alias("path"), F.col("p_partkey").alias("ord"), params.parse(record).alias("params"))
    pads = t(spark, sf_dir, "nation").select(F.lit("b").alias("path"), F.col("n_nationkey").cast("int").alias("ord"))
    return resolve.region_pads(regions, pads).select(F.col("ord").alias("p_partkey"), "pad", F.size("params").alias("left"))


@query("""SELECT n_nationkey, string_agg(s_name, ',' ORDER BY s_suppkey) AS texts FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 0 GROUP BY n_nationkey""")
def component_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by component, without those that are designators."""
    rows = t(spark, sf_dir, "supplier").select(F.lit("b").alias("path"), F.col("s_nationkey").alias("component_index"), "s_suppkey", "s_name", (F.col("s_suppkey") % 4 == 0).alias("is_designator"))
    owned, _ = boxes.by_component(rows.where("not is_designator"), t(spark, sf_dir, "nation").select(F.lit("b").alias("path"), F.col("n_nationkey").alias("ord")))
    return owned.groupBy(F.col("component_index").alias("n_nationkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]), ",").alias("texts"))


@query("""WITH c AS (SELECT source || '.txt' AS name, sha256(text) AS sha, min(doc_id) AS first FROM documents WHERE text <> '' GROUP BY 1, 2),
v AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY first) AS version FROM c),
x AS (SELECT source || '-2.txt' AS name, 'real' AS sha, 1000000000 + min(doc_id) AS first FROM documents GROUP BY source)
SELECT v.name, v.sha, CASE WHEN version = 1 THEN v.name ELSE replace(v.name, '.txt', '-' || version || '.txt') END AS file FROM v
UNION ALL SELECT x.name, sha256('real'), CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.name = replace(x.name, '-2.txt', '.txt') AND version = 2) THEN replace(x.name, '-2.txt', '-2-2.txt') ELSE x.name END FROM x""")
def generated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later file whose own name was given to another content by then takes the next number."""
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    real = docs.groupBy("source").agg((F.min("doc_id") + 1_000_000_000).alias("doc_id")).select("doc_id", F.concat("source", F.lit("-2.txt")).alias("name"), F.lit("real").alias("text"))
    rows = docs.select("doc_id", F.concat("source", F.lit(".txt")).alias("name"), "text").unionByName(real)
    return dedup.suffixed(rows, "name", "text", "doc_id").select("name", "sha", "file")


# -- stacks and outlines


@query("SELECT n_regionkey AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS place, n_name AS name, CAST(n_nationkey * 10000 AS INTEGER) AS copper_thickness FROM nation")
def layer_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = (F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).cast("string")
    rows = t(spark, sf_dir, "nation").select("n_regionkey", "n_name", "n_nationkey", n.alias("n"))
    pair = lambda k, v: F.struct(F.concat(F.lit("V9_STACK_LAYER"), "n", F.lit(f"_{k}")).alias("key"), v.alias("value"))
    entries = rows.select(F.col("n_regionkey").alias("doc_id"), F.posexplode(F.array(pair("NAME", F.col("n_name")), pair("NAME", F.lit("later")), pair("COPTHICK", F.concat(F.col("n_nationkey").cast("string"), F.lit("mil"))))).alias("ord", "e"))
    return stack.numbered_stack(entries.select("doc_id", "ord", "e.key", "e.value")).select("doc_id", "place", "name", "copper_thickness")


@query("SELECT n_regionkey AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) - 1 AS INTEGER) AS place, n_name AS name FROM nation")
def linked_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked from the last nation of a region to its first."""
    from pyspark.sql import Window as W

    w = W.partitionBy("n_regionkey").orderBy("n_nationkey")
    text_of = lambda c: F.coalesce((c + 1).cast("string"), F.lit("0"))
    rows = t(spark, sf_dir, "nation").select("n_regionkey", "n_name", (F.col("n_nationkey") + 1).cast("string").alias("n"), text_of(F.lead("n_nationkey").over(w)).alias("prev"), text_of(F.lag("n_nationkey").over(w)).alias("next"))
    pair = lambda k, c: F.struct(F.concat(F.lit("V7_LAYER"), "n", F.lit(k)).alias("key"), F.col(c).alias("value"))
    entries = rows.select(F.col("n_regionkey").alias("doc_id"), F.posexplode(F.array(pair("NAME", "n_name"), pair("PREV", "prev"), pair("NEXT", "next"))).alias("ord", "e"))
    return stack.linked_stack(entries.select("doc_id", "ord", "e.key", "e.value")).select("doc_id", "place", "name")


@query("SELECT p_partkey AS doc_id, CAST(4 AS INTEGER) AS corners, CAST(p_size * 10000 AS INTEGER) AS x, CAST(p_size * 1000 AS INTEGER) AS radius, CAST(NULL AS VARCHAR) AS error FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL, 'corner 1' FROM part WHERE p_size % 2 <> 0")
def board_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square with one arc, closed by its first corner; parts of odd size have a corner that cannot be read."""
    n = F.col("p_size").cast("string")
    mil = F.concat(n, F.lit("mil"))
    corner = lambda k, x, y: {f"KIND{k}": F.lit("0"), f"VX{k}": x, f"VY{k}": y}
    zero = F.lit("0mil")
    keys = {**corner(0, zero, zero), **corner(1, mil, F.when(F.col("p_size") % 2 == 0, zero).otherwise("?")), **corner(2, mil, mil), "CX2": zero, "CY2": zero, "SA2": F.lit("0"), "EA2": F.lit("90"), "R2": F.concat(F.col("p_size").cast("string"), F.lit("00")), **corner(3, zero, mil), **corner(4, zero, zero)}
    keys["KIND2"], keys["R2"] = F.lit("1"), F.concat((F.col("p_size") * 1000).cast("string"))
    entries = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in keys.items()))).alias("ord", "e"))
    found = stack.outline(entries.select("doc_id", "ord", "e.key", "e.value"))
    v = F.col("vertices")
    return found.select("doc_id", F.when(v.isNotNull(), F.size("vertices")).alias("corners"), v[1]["x"].alias("x"), v[2]["radius"].alias("radius"), "error")


# -- geometry


@query("""SELECT s_nationkey, CAST(min(least(a - 5, b)) AS INTEGER) AS x_min, CAST(min(least(-b - 5, -2 * b - 7)) AS INTEGER) AS y_min, CAST(max(greatest(a + b + 5, 3 * b)) AS INTEGER) AS x_max, CAST(max(greatest(a + 5, 7)) AS INTEGER) AS y_max
FROM (SELECT s_nationkey, s_suppkey AS a, s_suppkey % 100 AS b FROM supplier) GROUP BY s_nationkey""")
def primitive_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track of width 10 from (a, -b) to (a + b, a), and an arc of radius b and width 14 about (2b, -b), for each supplier."""
    a, b = F.col("s_suppkey").cast("int"), (F.col("s_suppkey") % 100).cast("int")
    rows = t(spark, sf_dir, "supplier")
    tracks = rows.select("s_nationkey", a.alias("x0"), (-b).alias("y0"), (a + b).alias("x1"), a.alias("y1"), F.lit(10).alias("width"))
    fills = rows.select("s_nationkey", b.alias("x0"), (-2 * b - 7).alias("y0"), (3 * b).alias("x1"), F.lit(7).alias("y1"))
    return boxes.enclosing({"track": tracks, "fill": fills}, ["s_nationkey"])


@query("""WITH r AS (SELECT p_partkey AS k, p_size AS s, CAST(floor(p_retailprice) AS BIGINT) AS x FROM part WHERE p_partkey % 3 = 0), q AS (SELECT p_partkey AS k, p_size AS s, CAST(floor(p_retailprice) AS BIGINT) AS x FROM part WHERE p_partkey % 3 = 1),
f AS (SELECT r.k AS region, min(q.k) AS pad FROM r JOIN q ON r.s = q.s AND q.x BETWEEN r.x AND r.x + 20 GROUP BY r.k)
SELECT min(region) AS region, pad FROM f GROUP BY pad""")
def pad_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").select(F.lit("b").alias("path"), F.col("p_partkey").alias("ord"), F.col("p_size").alias("component_index"), F.lit(1).alias("layer"), F.floor("p_retailprice").cast("int").alias("x"), F.lit(0).alias("y"))
    at = lambda dx, y: F.struct((F.col("x") + dx).alias("x"), F.lit(y).alias("y"))
    regions = rows.where("ord % 3 = 0").withColumn("outline", F.array(at(0, -5), at(20, 5))).withColumn("is_shape_based", F.lit(True)).withColumn("sub_poly_index", F.lit(-1)).drop("x", "y")
    regions = regions.unionByName(regions.withColumn("sub_poly_index", F.lit(0)).withColumn("ord", -F.col("ord")))
    return boxes.pad_shapes(regions, rows.where("ord % 3 = 1")).select("region", "pad")


@query("SELECT p_partkey, CAST(-p_size AS INTEGER) AS x, CAST(1000 + p_size AS INTEGER) AS far, 1000.0 * sqrt(2.0) AS diagonal, CAST(CASE p_size % 2 WHEN 0 THEN 20.0 ELSE 180.0 END AS DOUBLE) AS sweep FROM part")
def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square grown by the part's size; its diagonal; sweeps of arcs over zero."""
    square = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (1000, 0), (1000, 1000), (0, 1000))))
    even = F.col("p_size") % 2 == 0
    rows = t(spark, sf_dir, "part").select("p_partkey", spatial.offset_polygon(square, F.col("p_size")).alias("g"), spatial.distance(*map(F.lit, (0, 0, 1000, 1000))).alias("diagonal"), spatial.ccw_sweep(F.when(even, 350.0).otherwise(270.0), F.when(even, 10.0).otherwise(90.0)).alias("sweep"))
    return rows.select("p_partkey", F.col("g")[0]["x"].alias("x"), F.col("g")[2]["y"].alias("far"), "diagonal", "sweep")


@query("SELECT p_partkey, least(80.0 / p_size, 80.0 / 100) AS scale FROM part")
def canvas_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").select("p_partkey", F.lit(0).alias("x_min"), F.lit(0).alias("y_min"), F.col("p_size").alias("x_max"), F.lit(100).alias("y_max"))
    return spatial.fit(rows, 100.0, 100.0, 10.0).select("p_partkey", "scale")


# -- flat boards


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel that holds each region's board once, every second one mirrored and turned."""
    k = F.col("r_regionkey")
    one, zero = F.lit(1), F.lit(0.0)
    odd = k % 2 == 1
    placed = t(spark, sf_dir, "region").select(
        F.lit("panel").alias("parent"), F.concat(F.lit("r"), k.cast("string")).alias("child"), k.cast("int").alias("ord"), (k * 100000).cast("double").alias("x"), F.lit(500.0).alias("y"), F.when(odd, 90.0).otherwise(0.0).alias("rotation"), odd.alias("mirror"),
        one.alias("cols"), one.alias("rows"), zero.alias("dx"), zero.alias("dy"), zero.alias("origin_x"), zero.alias("origin_y"),
    )
    return flatten.instances(placed, spark.range(1).select(F.lit("panel").alias("doc")))[0]


def _of_region(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    nations = t(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("doc"), "n_nationkey", "n_name")
    return t(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("doc", "s_suppkey", *columns)


# odd regions: (x, y) goes to (-y, -x) from the place, as x is mirrored first and the quarter turn comes after
@query("""SELECT s_suppkey, CAST(100000 * r + CASE WHEN r % 2 = 0 THEN s_suppkey ELSE -7 END AS INTEGER) AS x, CAST(500 + CASE WHEN r % 2 = 0 THEN 7 ELSE -s_suppkey END AS INTEGER) AS y,
CAST(CASE WHEN r % 2 = 0 THEN 30.0 ELSE 60.0 END AS DOUBLE) AS rotation, r % 2 = 0 AS is_mirrored FROM (SELECT s_suppkey, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey)""")
def flat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prims = _of_region(spark, sf_dir, F.col("s_suppkey").cast("double").alias("x"), F.lit(7.0).alias("y"), F.lit(30.0).alias("rotation"), F.lit(True).alias("is_mirrored"))
    return flatten.moved(prims, "text", _panel(spark, sf_dir)).select("s_suppkey", "x", "y", F.round("rotation", 6).alias("rotation"), "is_mirrored")


@query("""SELECT s_suppkey, CAST(s AS DOUBLE) AS start_angle, CAST(CASE WHEN full_circle THEN s + 360 WHEN r % 2 = 0 THEN 100.0 ELSE 260.0 END AS DOUBLE) AS end_angle FROM (
SELECT s_suppkey, r, s_suppkey % 3 = 0 AS full_circle, CASE WHEN r % 2 = 0 THEN 10.0 WHEN s_suppkey % 3 = 0 THEN 260.0 ELSE 170.0 END AS s FROM (SELECT s_suppkey, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey))""")
def flat_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps from 10 to 100 degrees, or full circles from 10."""
    prims = _of_region(spark, sf_dir, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("start_angle"), F.when(F.col("s_suppkey") % 3 == 0, 370.0).otherwise(100.0).alias("end_angle"))
    return flatten.moved(prims, "arc", _panel(spark, sf_dir)).select("s_suppkey", F.round("start_angle", 6).alias("start_angle"), F.round("end_angle", 6).alias("end_angle"))


@query("""WITH p AS (SELECT s_suppkey, n_regionkey AS r, s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey), c AS (SELECT r, count(*) AS n FROM p GROUP BY r),
b AS (SELECT r_regionkey AS r, coalesce(sum(n) OVER (ORDER BY r_regionkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM region LEFT JOIN c ON c.r = r_regionkey)
SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 5 = 0 THEN -1 ELSE 3 + base END AS INTEGER) AS component_index,
CAST(CASE WHEN s_suppkey % 4 = 3 THEN 0 WHEN s_suppkey % 4 = 0 THEN 1 ELSE p.r + 2 END AS INTEGER) AS net_index FROM p JOIN b ON b.r = p.r""")
def flat_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each board has the nets GND, which all share, and one of its own; a third index that some pads have is of no net."""
    found = _panel(spark, sf_dir)
    k = F.col("s_suppkey")
    net = F.when(k % 4 == 3, 9).when(k % 4 == 0, 1).otherwise(2)
    prims = _of_region(spark, sf_dir, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("rotation"), F.when(k % 5 == 0, -1).otherwise(3).alias("component_index"), net.alias("net_index"))
    doc = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    nets = t(spark, sf_dir, "region").select(doc.alias("doc"), F.posexplode(F.array(F.lit("GND"), F.col("r_name"))).alias("ord", "name"))
    _, net_map = flatten.merged_nets(found, nets)
    out = flatten.remapped(flatten.moved(prims, "pad", found), flatten.component_bases(found, prims), net_map)
    return out.select("s_suppkey", F.col("component_index").cast("int").alias("component_index"), F.col("net_index").cast("int").alias("net_index"))


@query("SELECT 'GND' AS name, CAST(1 AS INTEGER) AS net_index UNION ALL SELECT r_name, CAST(r_regionkey + 2 AS INTEGER) FROM region")
def flat_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    nets = t(spark, sf_dir, "region").select(doc.alias("doc"), F.posexplode(F.array(F.lit("GND"), F.col("r_name"))).alias("ord", "name"))
    return flatten.merged_nets(_panel(spark, sf_dir), nets)[0].select("name", "net_index")


@query("SELECT n_nationkey, n_name AS rule, [CAST(n_regionkey AS INTEGER), 0, 0] AS visit FROM nation")
def flat_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("doc"), "n_nationkey", F.col("n_name").alias("rule"))
    return flatten.copied(rules, _panel(spark, sf_dir)).select("n_nationkey", "rule", "visit")


@query("SELECT 'M' || (n_nationkey % 4) AS id, CAST(min(n_regionkey * 100 + n_nationkey) % 100 AS INTEGER) AS ord FROM nation GROUP BY 1")
def flat_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models whose ids differ in case only are one, the first that is visited."""
    n = F.col("n_nationkey")
    rows = t(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("doc"), n.cast("int").alias("ord"), F.concat(F.when(n % 2 == 0, "m").otherwise("M"), (n % 4).cast("string")).alias("id"))
    return flatten.kept_models(_panel(spark, sf_dir), rows).select("id", "ord")


# -- models and sheets


@query("SELECT 'model' AS check, c_name AS item, CASE c_custkey % 4 WHEN 0 THEN 'no payload' WHEN 1 THEN 'does not inflate' ELSE 'checksum differs' END AS message FROM customer WHERE c_custkey % 4 <> 3 UNION ALL SELECT 'body', 'X' || s_suppkey, 'model does not exist' FROM supplier")
def model_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.compression import deflated

    k = F.col("c_custkey")
    rows = t(spark, sf_dir, "customer").select("c_name", k.alias("k"), deflated(F.col("c_name").cast("binary")).alias("z"))
    right = bits.weighted_checksum(F.col("c_name").cast("binary"))
    metadata = rows.select(F.lit(1).alias("doc_id"), F.col("k").alias("ord"), F.col("k").cast("string").alias("id"), F.col("c_name").alias("name"), F.when(F.col("k") % 4 == 2, right + 1).otherwise(right).alias("checksum"))
    payloads = rows.where("k % 4 <> 0").select(F.lit(1).alias("doc_id"), F.col("k").alias("ord"), F.when(F.col("k") % 4 == 1, F.lit(b"broken")).otherwise(F.col("z")).alias("payload"))
    loose = t(spark, sf_dir, "supplier").select(F.lit(1).alias("doc_id"), F.concat(F.lit("x"), F.col("s_suppkey").cast("string")).alias("model_id"), F.lit("b").alias("name"))
    known = t(spark, sf_dir, "customer").select(F.lit(1).alias("doc_id"), F.col("c_custkey").cast("string").alias("model_id"), F.lit("b").alias("name"))
    return models.checks(models.joined(metadata, payloads), loose.unionByName(known))


@query("SELECT p_partkey, (a = 0 OR c = 0 OR a = c) AND (m < 2 OR d = e) AS netted, (a <= 0 OR a = CASE WHEN c > 0 THEN c ELSE 1 END) AND (m <= 1 OR d = e) AS drawn FROM (SELECT p_partkey, p_partkey % 3 AS a, p_size % 3 AS c, p_partkey % 2 AS d, p_size % 2 AS e, p_size % 4 AS m FROM part)")
def visible_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    args = (k % 3, n % 3, k % 2, n % 2, n % 4)
    return t(spark, sf_dir, "part").select("p_partkey", schematic.visible(*args).alias("netted"), schematic.drawn(*args).alias("drawn"))


@query("""WITH p AS (SELECT c_nationkey AS doc_id, c_mktsegment AS seg, c_custkey AS k FROM customer),
n AS (SELECT doc_id, seg, count(*) AS n, string_agg('C' || k, ',' ORDER BY 'C' || k) AS members, dense_rank() OVER (PARTITION BY doc_id ORDER BY seg) AS place FROM p GROUP BY doc_id, seg)
SELECT doc_id, CASE WHEN seg = 'BUILDING' THEN 'B' ELSE 'N' || lpad(CAST(rank AS VARCHAR), 5, '0') END AS net, members FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, seg = 'BUILDING' ORDER BY m) AS rank FROM (SELECT n.*, m FROM n JOIN (SELECT doc_id, seg, min(k) AS m FROM p GROUP BY doc_id, seg) x ON x.doc_id = n.doc_id AND x.seg = n.seg))
WHERE NOT (seg <> 'BUILDING' AND n < 2)""")
def sheet_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sheets: customers are pins on the vertical wire of their market segment, whose x is its least key; one segment has a label."""
    pins = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), "c_mktsegment", F.col("c_custkey").cast("bigint").alias("k"))
    wires = pins.groupBy("doc_id", "c_mktsegment").agg(F.min("k").alias("x0"), F.max("k").alias("far"), F.first("c_mktsegment").alias("seg"))
    step = 20_000
    pins = pins.join(wires.select("doc_id", "c_mktsegment", "x0"), ["doc_id", "c_mktsegment"]).select("doc_id", F.concat(F.lit("C"), F.col("k").cast("string")).alias("designator"), F.lit("1").alias("pad"), (F.col("x0") * 100_000).alias("x"), (F.col("k") * step).alias("y"))
    at = lambda y: F.struct((F.col("x0") * 100_000).alias("x"), y.cast("bigint").alias("y"))
    lines = wires.select("doc_id", F.array(at(F.lit(0)), at((F.col("far") + 1) * step)).alias("vertices"))
    labels = wires.where("seg = 'BUILDING'").select("doc_id", F.lit(0).alias("ord"), F.lit(" B ").alias("text"), (F.col("x0") * 100_000).alias("x"), F.lit(0).alias("y"))
    none = labels.limit(0)
    ports = none.select("doc_id", "ord", F.lit("").alias("name"), "x", "y", F.lit(0).alias("width"), F.lit(0).alias("style"))
    found = schematic.nets(pins, lines, labels, none, ports, none.select("doc_id", "x", "y"))
    return found.select("doc_id", "net", F.array_join(F.array_sort(F.transform("members", lambda m: m["designator"])), ",").alias("members"))


# the harness entry of the sheet symbol, which has the least point, takes the first number and goes, as it is alone
@query("""WITH s AS (SELECT s_nationkey AS doc_id, s_suppkey AS k, s_name, s_suppkey % 2 = 0 AS even, CAST(bool_or(s_suppkey % 2 = 0) OVER (PARTITION BY s_nationkey) AS INTEGER) AS bus FROM supplier)
SELECT doc_id, CASE WHEN even THEN 'bus.' || s_name ELSE 'N' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, even ORDER BY k) + bus AS VARCHAR), 5, '0') END AS net, 'P' || k || '-1' AS members,
  CASE WHEN even THEN 'bus.' || s_name ELSE '' END AS ports, 'child/' || CASE WHEN even THEN 'bus.' || s_name ELSE s_name END AS entries FROM s""")
def sheet_entry_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sheets: each supplier is a pin; even ones lie on an entry of the sheet's harness connector, which meets a harness entry of a sheet symbol, odd ones on a plain sheet entry."""
    k = F.col("s_suppkey")
    rows = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), k.cast("int").alias("ord"), "s_name", (k.cast("bigint") * 100_000).alias("x"), F.lit(0).alias("y"))
    pins = rows.select("doc_id", F.concat(F.lit("P"), F.col("ord").cast("string")).alias("designator"), F.lit("1").alias("pad"), "x", "y")
    of_symbol = lambda df, name, kind: df.select("doc_id", "ord", F.lit("child").alias("sheet_symbol"), F.lit("child.SchDoc").alias("file_name"), name.alias("name"), F.lit(1).alias("io_type"), F.lit(kind).alias("harness_type"), "x", "y")
    sheets = rows.where("ord % 2 = 0").select("doc_id").distinct().select("doc_id", F.lit(0).alias("ord"), F.lit(-700_000).alias("x"), F.lit(900_000).alias("y"))
    entries = of_symbol(rows.where("ord % 2 = 1"), F.col("s_name"), None).unionByName(of_symbol(sheets, F.lit(" bus "), "H"))
    signals = rows.where("ord % 2 = 0").select("doc_id", F.lit(0).alias("connector"), "ord", F.col("s_name").alias("name"), "x", "y")
    none = rows.limit(0)
    lines = none.select("doc_id", "ord", F.array(F.struct("x", "y")).alias("vertices"))
    texts_ = none.select("doc_id", "ord", F.col("s_name").alias("text"), "x", "y")
    ports = none.select("doc_id", "ord", F.col("s_name").alias("name"), "x", "y", F.lit(0).alias("width"), F.lit(0).alias("style"))
    found = schematic.nets(pins, lines, texts_, texts_, ports, none.select("doc_id", "x", "y"), sheet_entries=entries, connectors=sheets.withColumn("harness_type", F.lit("H")), harness_entries=signals)
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return found.select("doc_id", "net", joined("members", lambda m: F.concat_ws("-", m["designator"], m["pad"])).alias("members"), F.array_join("ports", ",").alias("ports"), joined("entries", lambda e: F.concat_ws("/", e["sheet_symbol"], e["entry"])).alias("entries"))


@query("""SELECT p_partkey, CASE WHEN k <= 30 THEN 1 + k WHEN k <= 46 THEN 26 + k WHEN k = 47 THEN 56 ELSE 0 END AS number,
CASE WHEN k <= 30 THEN 'MID' || k WHEN k <= 46 THEN 'MECHANICAL' || (k - 30) WHEN k = 47 THEN 'KEEPOUTLAYER' ELSE 'MECHANICAL1' END AS name FROM (SELECT p_partkey, p_size AS k FROM part)""".replace("26 + k", "56 + k - 30"))
def layer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size")
    name = F.when(k <= 30, F.concat(F.lit("Mid-Layer "), k.cast("string"))).when(k <= 46, F.concat(F.lit("mechanical "), (k - 30).cast("string"))).when(k == 47, "Keep-Out Layer").otherwise(F.concat(F.lit("Mid Layer "), k.cast("string")))
    number = layers.number_of(name)
    return t(spark, sf_dir, "part").select("p_partkey", number.alias("number"), layers.name_of(number).alias("name"))


@query("""SELECT p_partkey, p_brand AS version, CASE WHEN p_size % 2 = 0 THEN 'x,"Comment=' || p_name || '","Note=a ""b"", c"' ELSE 'x,"Comment=' || p_name || '",URL=?a=1&b=2' END AS tokens FROM part""".replace("'x,", "'A=1,"))
def token_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    even = F.col("p_size") % 2 == 0
    some = F.when(even, F.array(pair("A", F.lit("1")), pair("Comment", F.col("p_name")), pair("Note", F.lit('a "b", c')))).otherwise(F.array(pair("A", F.lit("1")), pair("Comment", F.col("p_name")), pair("URL", F.lit("?a=1&b=2"))))
    return t(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("version"), params.token_text(some).alias("tokens"))


def _bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each part: a header, and an item of which every second has no comment of its own."""
    n = F.col("p_size").cast("string")
    inner = F.concat(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Comment=C"), n, F.lit(","))).otherwise(""), F.lit('"Manufacturer Part Number=M '), n, F.lit('",Supplier='), F.regexp_replace("p_brand", " ", ""))
    body = F.concat(F.lit("|RECORD=BOM|VERSION=7|FILENAME="), F.col("p_name"), F.lit("|PRODUCTIONQUANTITY="), n, F.lit("\r\n|RECORD=GeneralOptions|X="), n, F.lit("\r\n|RECORD=CatalogItem|DESIGNITEMID=D"), n, F.lit("|USERCOMMENTS=user, own|DESCRIPTION="), F.col("p_type"), F.lit("|COMPONENTPARAMETERS="), inner, F.lit("\r\n"))
    return texts.records(t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), body.alias("text")))


@query("""SELECT p_partkey, CAST(0 AS BIGINT) AS ord, 'DesignItemId,Comment,Description,Footprint,Manufacturer,Manufacturer Part Number,Supplier,Supplier Part Number,ItemSource,UniqueId' AS line FROM part
UNION ALL SELECT p_partkey, 3, 'D' || p_size || ',' || CASE WHEN p_size % 2 = 0 THEN 'C' || p_size ELSE '"user, own"' END || ',' || p_type || ',,,M ' || p_size || ',' || replace(p_brand, ' ', '') || ',,,' FROM part""")
def bom_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.bom_report(texts.bom_items(_bom(spark, sf_dir)))
    return found.select(F.col("path").cast("bigint").alias("p_partkey"), "ord", "line")


@query("SELECT p_partkey, CAST(7 AS INTEGER) AS version, p_name AS filename, CAST(p_size AS INTEGER) AS production_quantity, CAST(p_size AS VARCHAR) AS option FROM part")
def bom_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _bom(spark, sf_dir)
    options = texts.bom_options(found).select("path", params.first(F.col("params"), "X").alias("option"))
    return texts.bom_header(found).join(options, "path").select(F.col("path").cast("bigint").alias("p_partkey"), "version", "filename", "production_quantity", "option")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || 'é' ELSE c_name || 'é' END AS text FROM customer")
def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of UTF-8 and, every second, of single bytes."""
    from ..functions.compression import deflated

    k = F.col("c_custkey")
    name = F.concat("c_name", F.lit("é"))
    rows = t(spark, sf_dir, "customer").select(k.alias("k"), deflated(F.when(k % 2 == 0, name.cast("binary")).otherwise(F.encode(name, "ISO-8859-1"))).alias("z"))
    metadata = rows.select(F.lit(1).alias("doc_id"), F.col("k").alias("ord"))
    return models.joined(metadata, rows.select(F.lit(1).alias("doc_id"), F.col("k").alias("ord"), F.col("z").alias("payload"))).select(F.col("ord").alias("c_custkey"), "text")
