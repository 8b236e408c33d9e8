"""Sources over small files made here."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from tracewright.functions import params
from tracewright.sources import container
from tracewright.sources import text as sources


def compound(streams: dict[tuple[str, str], bytes]) -> bytes:
    """A minimal compound file: 512-byte sectors, one level of storages; short streams go to the short stream."""
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        if not data:
            return container.END
        first = len(sectors)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        sectors.extend(parts)
        fat.extend([*range(first + 1, first + len(parts)), container.END])
        return first

    mini, mini_fat, nodes = b"", [], []
    storages = sorted({s for s, _ in streams if s})
    for (storage, name), data in streams.items():
        if data and len(data) < 4096:
            start, n = len(mini) // 64, -(-len(data) // 64)
            mini_fat += [*range(start + 1, start + n), container.END]
            mini += data.ljust(n * 64, b"\0")
        else:
            start = put(data)
        nodes.append([storage, name, 2, start, len(data)])
    nodes += [["", s, 1, 0, 0] for s in storages]
    free = container.FREE
    right = {i: free for i in range(len(nodes))}
    child = {}
    for i, (storage, *_rest) in enumerate(nodes):
        if storage in child:
            right[i] = child[storage]
        child[storage] = i

    def entry(name, kind, r, c, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", free, r, c) + b"\0" * 36 + struct.pack("<IQ", start, size)

    at = lambda i: i if i == free else i + 1
    mini_start = put(mini)
    directory = entry("Root Entry", 5, free, at(child.get("", free)), mini_start, len(mini))
    for i, (storage, name, kind, start, size) in enumerate(nodes):
        directory += entry(name, kind, at(right[i]), at(child[name]) if kind == 1 else free, start, size)
    dir_start = put(directory)
    mini_fat_start = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat)) if mini_fat else container.END
    n_fat = 1
    while len(fat) + n_fat > n_fat * 128:
        n_fat += 1
    places = list(range(len(sectors), len(sectors) + n_fat))
    table = (fat + [0xFFFFFFFD] * n_fat + [free] * (n_fat * 128))[: n_fat * 128]
    sectors.append(struct.pack(f"<{len(table)}I", *table))
    header = container.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10
    header += struct.pack("<IIIIIIII", n_fat, dir_start, 0, 4096, mini_fat_start, int(bool(mini_fat)), container.END, 0)
    header += struct.pack("<109I", *(places + [free] * 109)[:109])
    return header + b"".join(sectors)


STREAMS = {("", "FileHeader"): b"hello", ("Board6", "Data"): struct.pack("<I", 5) + b"|A=1|" + struct.pack("<I", (7 << 24) | 3) + b"xyz" + b"\x09\0", ("Nets6", "Data"): bytes(range(256)) * 40, ("Nets6", "Header"): b""}


def test_container_streams(spark, tmp_path):
    (tmp_path / "a.PcbDoc").write_bytes(compound(STREAMS))
    (tmp_path / "b.txt").write_bytes(b"not a container")
    found = container.files(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[-1]: r["kind"] for r in found.collect()} == {"a.PcbDoc": "pcbdoc", "b.txt": None}
    rows = container.streams(found)
    got = {(r["storage"], r["name"]): bytes(r["data"]) for r in rows.where("error is null").collect()}
    assert got == STREAMS
    assert [r["error"] for r in rows.where("error is not null").collect()] == ["not a compound file"]
    blocks = container.block_rows(rows.where("storage = 'Board6'")).orderBy("ord").collect()
    assert [(r["flags"], bytes(r["payload"])) for r in blocks] == [(0, b"|A=1|"), (7, b"xyz")]


@pytest.mark.parametrize("cut", [3, 511, 600, 1500, 4000])
def test_broken_containers_give_a_row(spark, cut):
    data = bytearray(compound(STREAMS)[:cut] if cut < 4000 else compound(STREAMS))
    if cut == 4000:
        data[48:52] = struct.pack("<I", 99999)
    try:
        list(container.entries(bytes(data)))
    except (ValueError, struct.error):
        pass


def test_ini_sections(spark, tmp_path):
    (tmp_path / "x.LibPkg").write_bytes("﻿; note\r\n [Design] \r\nName = a=b\r\nName = z\r\nName = c=d\r\n[Document10]\r\nDocumentPath=z\r\n[Document2]\r\nDocumentPath=old\r\n[Document2]\r\nDocumentPath=new\r\n".encode())
    rows = sources.ini(sources.documents(spark, str(tmp_path)))
    assert sorted((r["section"], r["key"], r["value"]) for r in rows.collect()) == [("Design", "Name ", " c=d"), ("Document10", "DocumentPath", "z"), ("Document2", "DocumentPath", "new")]
    assert [r["n"] for r in sources.numbered(rows).orderBy("n").collect()] == [2, 10]
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "y.LibPkg").write_bytes(b"stray=1\n[Design]\nName=a\n")
    assert [(r["section"], r["error"]) for r in sources.ini(sources.documents(spark, str(tmp_path / "y"))).collect()] == [(None, "key stray before any section")]


def test_bom_records_and_encodings(spark, tmp_path):
    lines = b'|RECORD=BOM_HEADER|TITLE=\xb5\r\n|RECORD=CatalogItem|COMPONENTPARAMETERS=Comment=10k,"Component Kind=Standard",Footprint=R0402|NOTE=one\r\ntwo\r\n\r\n|RECORD=CatalogItem|COMPONENTPARAMETERS=comment=c,Comment=d\r\n'
    (tmp_path / "x.BomDoc").write_bytes(lines)
    found = sources.records(sources.documents(spark, str(tmp_path)))
    assert {r["record_no"]: (r["kind"], r["t"], r["n"]) for r in found.select("record_no", "kind", params.first(F.col("params"), "TITLE").alias("t"), params.first(F.col("params"), "NOTE").alias("n")).collect()} == {1: ("BOM_HEADER", "µ", None), 2: ("CatalogItem", None, "one\ntwo"), 3: ("CatalogItem", None, None)}
    assert [(r["comment"], r["footprint"], r["component_kind"]) for r in sources.bom_items(found).orderBy("record_no").collect()] == [("10k", "R0402", "Standard"), ("c", None, None)]


def primitive(kind: int, *blocks: bytes) -> bytes:
    return bytes([kind]) + b"".join(struct.pack("<I", len(b)) + b for b in blocks)


def test_board_primitives(spark):
    from tracewright.sources import board

    pre = lambda layer, flags, net, comp: struct.pack("<BHHHHI", layer, flags, net, 0xFFFF, comp, 0xFFFFFFFF)
    arc = pre(1, 0x04, 0, 0xFFFF) + struct.pack("<iiiddi", -5, 7, 100, 22.5, -0.1, 10)
    pad_main = pre(74, 0x00, 0xFFFF, 3) + struct.pack("<9i3Bd?", 1, -2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 270.0, True)
    track = pre(32, 0x204, 4, 0) + struct.pack("<5i", 1, 2, 3, 4, 5)
    data = primitive(1, arc) + primitive(2, b"\x02A1", b"", b"\x00", b"", pad_main, b"") + primitive(4, track) + primitive(4, track + struct.pack("<HB", 9, 0)) + primitive(6, pre(1, 4, 1, 1) + struct.pack("<4id", 1, 2, 3, 4, 1e-300)) + primitive(3, pre(1, 4, 1, 1) + struct.pack("<4iBB", 1, 2, 3, 4, 1, 32)) + b"\x04\xff"
    records = board.raw_records(spark.createDataFrame([("p", "Prims", bytearray(data))], "path string, storage string, data binary"))
    assert [r["kind"] for r in records.orderBy("ord").collect()] == [1, 2, 4, 4, 6, 3]
    a = board.arcs(records).first()
    assert (a["x"], a["y"], a["radius"], a["start_angle"], a["end_angle"], a["width"], a["net_index"], a["component_index"], a["is_locked"]) == (-5, 7, 100, 22.5, -0.1, 10, 1, -1, False)
    p = board.pads(records).first()
    assert (p["designator"], p["x"], p["y"], p["hole_size"], p["shape_bottom"], p["rotation"], p["is_plated"], p["net_index"], p["component_index"], p["is_locked"]) == ("A1", 1, -2, 9, 3, 270.0, True, 0, 3, True)
    assert [(t["net_index"], t["is_keepout"], t["width"]) for t in board.tracks(records).orderBy("ord").collect()] == [(5, True, 5), (9, True, 5)]
    assert board.fills(records).first()["rotation"] == 1e-300 and board.vias(records).first()["end_layer"] == 32
    nets = spark.createDataFrame([("p", 0, "GND"), ("p", 4, "VCC")], "path string, ord int, name string")
    assert board.with_names(board.arcs(records), nets).first()["net"] == "GND"


def test_typed_records(spark):
    from tracewright.functions import schema
    from tracewright.sources import board

    payload = b"|PATTERN=R0402|X=100mil|Y=-1mil|COMPONENTKIND=0|COMPONENTKINDVERSION2=5|SOURCEDESIGNATOR=R1|UNKNOWN=\xb5|\x00junk"
    rows = board.param_records(spark.createDataFrame([("p", "Components6", 0, bytearray(payload))], "path string, storage string, ord int, payload binary"))
    r = schema.typed(rows, "component").first()
    assert (r["name"], r["x"], r["y"], r["component_kind"], r["source_designator"], r["rotation"], [tuple(e)[:2] for e in r["extra"]]) == ("R0402", 1_000_000, -10_000, 5, "R1", 0.0, [("UNKNOWN", "µ")])
    text = rows.select(schema.record_text(F.col("params")).alias("t")).first()["t"]
    assert text.startswith("|PATTERN=R0402|X=100mil") and text.endswith("|UNKNOWN=µ")


def test_sheet_records_to_netlist(spark):
    from tracewright.sources import sheet

    lines = [
        "|HEADER=x", "|RECORD=31|X=1",
        "|RECORD=1|LIBREFERENCE=RES|CURRENTPARTID=1|DISPLAYMODECOUNT=1|DESIGNATORPREFIX=R",  # owner number 1
        "|RECORD=2|OWNERINDEX=1|OWNERPARTID=1|DESIGNATOR=1|LOCATION.X=0|LOCATION.Y=0|PINLENGTH=10|PINCONGLOMERATE=0",
        "|RECORD=2|OWNERINDEX=1|OWNERPARTID=2|DESIGNATOR=9|LOCATION.X=0|LOCATION.Y=0|PINLENGTH=10",
        "|RECORD=41|OWNERINDEX=1|NAME=Designator|TEXT=R1", "|RECORD=44|OWNERINDEX=1", "|RECORD=45|OWNERINDEX=5|MODELNAME=OLD|MODELTYPE=PCBLIB|ISCURRENT=F", "|RECORD=45|OWNERINDEX=5|MODELNAME=R0402|MODELTYPE=PCBLIB|ISCURRENT=T",
        "|RECORD=46|OWNERINDEX=7", "|RECORD=47|OWNERINDEX=8|DESINTF=1|DESIMP0=A|DESIMP1=B",
        "|RECORD=1|LIBREFERENCE=CAP|DESIGNATORPREFIX=C", "|RECORD=2|DESIGNATOR=2|LOCATION.X=50|LOCATION.Y=0|PINLENGTH=10|PINCONGLOMERATE=2",
        "|RECORD=27|LOCATIONCOUNT=2|X1=10|Y1=0|X2=30|Y2=0", "|RECORD=37|LOCATION.X=30|LOCATION.Y=0|CORNER.X=40|CORNER.Y=0|CORNER.X_FRAC=0", "|RECORD=25|LOCATION.X=20|LOCATION.Y=0|TEXT=SIG",
        "|RECORD=15|LOCATION.X=500|LOCATION.Y=500|FILENAME=psu.SchDoc", "|RECORD=16|OWNERINDEX=15|NAME=EN", "|RECORD=32|LOCATION.X=505|LOCATION.Y=510|TEXT=PSU", "|RECORD=33|LOCATION.X=900|LOCATION.Y=500|TEXT=far",
    ]
    records = spark.createDataFrame([("s", i, t) for i, t in enumerate(lines)], "doc_id string, pos int, t string").select("doc_id", "pos", params.parse(F.col("t")).alias("params"))
    got = {r["net"]: [tuple(m) for m in r["members"]] for r in sheet.netlist(records).collect()}
    assert got == {"SIG": [("C?", "2"), ("R1", "A"), ("R1", "B")]}
    rows = sheet.placed(records)
    assert sorted((r["designator"], r["ord"]) for r in sheet.components(rows).collect()) == [("C?", 10), ("R1", 1)]
    assert {r["ord"]: r["footprint"] for r in sheet.footprints(rows).collect()} == {1: "R0402", 10: None}
    assert [(r["name"], r["file_name"]) for r in sheet.symbol_identity(rows).collect()] == [("PSU", "psu.SchDoc")]


def test_texts_go_round(spark, tmp_path):
    from tracewright.sources import sinks

    body = "﻿[Design]\r\nName=a\r\n[Document1]\r\nDocumentPath=z\r\n"
    (tmp_path / "x.LibPkg").write_bytes(body.encode())
    rows = sources.ini(sources.documents(spark, str(tmp_path)))
    assert sinks.ini_text(rows).first()["text"] == body
    bom = "|RECORD=BOM_HEADER|TITLE=t\r\n|RECORD=CatalogItem|A=1|A=2\r\n"
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.BomDoc").write_bytes(bom.encode())
    found = sources.records(sources.documents(spark, str(tmp_path / "b")))
    assert sinks.bom_text(found).first()["text"] == bom
    lines = spark.createDataFrame([("d", 1, "b"), ("d", 0, "a"), ("../e", 0, "c")], "doc_id string, ord int, line string")
    texts = sinks.report_text(lines, end="\n")
    assert {r["doc_id"]: r["text"] for r in texts.collect()} == {"d": "a\nb\n", "../e": "c\n"}
    sinks.write_texts(texts, str(tmp_path / "out"), "doc")
    assert {r["doc"]: r["value"] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()} == {"d": "a\nb\n\n", "UNSAFE_e": "c\n\n"}


def test_wide_strings_and_view_config(spark):
    from tracewright.functions import text as texts
    from tracewright.sources import board

    entry = lambda i, t: struct.pack("<II", i, 2 * len(t) + 2) + t.encode("utf-16-le") + b"\0\0"
    older = b"|ENCODEDTEXT0=72,105,x,1114112|ENCODEDTEXT1=|ENCODEDTEXT3=65\0"
    rows = [("new", entry(1, "b\u00e9") + struct.pack("<II", 0, 0) + entry(1, "c") + b"\1"), ("old", struct.pack("<I", len(older)) + older), ("none", b"")]
    got = sorted((r["path"], r["index"], r["text"]) for r in board.wide_strings(spark.createDataFrame(rows, "path string, data binary")).collect())
    assert got == [("new", 0, ""), ("new", 1, "c"), ("old", 0, "Hi"), ("old", 1, "")]
    value = "CFG3D.A=1`x`CFG2D.B=2=3`CFG2D.A=1`CFG2D.A=4"
    r = spark.range(1).select(texts.config_entries(F.lit(value), "CFG2D.").alias("e"), texts.layers_shown(F.lit("g~0_g.I~V.Version=2,Class=T,16777217=1,5=0,7=2,5=1")).alias("s")).first()
    assert [tuple(e) for e in r["e"]] == [("CFG2D.A", "4"), ("CFG2D.B", "2=3")] and [tuple(e) for e in r["s"]] == [(5, True), (16777217, True)]


def test_binary_pins(spark):
    from tracewright.sources import sheet

    word = lambda t: bytes([len(t)]) + t.encode("latin-1")
    body = struct.pack("<iBhBBBBB", 2, 0, -1, 1, 2, 3, 4, 5) + word("\xb5") + struct.pack("<BBBhhhi", 1, 4, 58, 30, -10, 20, 255) + word("VCC") + word("A1") + word("") + word("1|&|0") + word("dv")
    rows = spark.createDataFrame([(0, body), (1, body[:-2]), (2, b"\x01" + body[1:]), (3, b"")], "k int, body binary")
    got = {r["k"]: r["params"] and {p["name"]: p["value"] for p in r["params"]} for r in sheet.binary_pins(rows).collect()}
    assert got[1] is None and got[2] is None and got[3] is None
    assert {k: got[0][k] for k in ("RECORD", "OWNERPARTID", "DESCRIPTION", "PINLENGTH", "LOCATION.X", "COLOR", "NAME", "DESIGNATOR", "DEFAULTVALUE")} == {"RECORD": "2", "OWNERPARTID": "-1", "DESCRIPTION": "µ", "PINLENGTH": "30", "LOCATION.X": "-10", "COLOR": "255", "NAME": "VCC", "DESIGNATOR": "A1", "DEFAULTVALUE": "dv"}


def test_sheet_entries_and_harnesses(spark):
    """A sheet symbol with a plain and a harness entry, a connector on a signal harness to the latter, and a label on another bundle."""
    from tracewright.sources import sheet

    text = [
        "|HEADER=x", "|RECORD=1|LIBREFERENCE=R|CURRENTPARTID=1|DISPLAYMODECOUNT=1", "|RECORD=34|OWNERINDEX=0|NAME=Designator|TEXT=R1", "|RECORD=41|OWNERINDEX=0|NAME=Designator|TEXT=R1",
        # two pins, to the right: their ends are at (20, 0) and (20, 50)
        "|RECORD=2|OWNERINDEX=0|DESIGNATOR=1|PINCONGLOMERATE=0|LOCATION.X=10|LOCATION.Y=0|PINLENGTH=10", "|RECORD=2|OWNERINDEX=0|DESIGNATOR=2|PINCONGLOMERATE=0|LOCATION.X=10|LOCATION.Y=50|PINLENGTH=10",
        # the left edge's entries at (100, 90) and (100, 70)
        "|RECORD=15|LOCATION.X=100|LOCATION.Y=100|XSIZE=60|YSIZE=60|SHEETNAME=child|FILENAME=child.SchDoc", "|RECORD=16|OWNERINDEX=5|SIDE=0|DISTANCEFROMTOP=1|NAME=EN|IOTYPE=2", "|RECORD=16|OWNERINDEX=5|SIDE=0|DISTANCEFROMTOP=3|NAME=USB|IOTYPE=1|HARNESSTYPE=usb",
        "|RECORD=27|LOCATIONCOUNT=3|X1=20|Y1=0|X2=20|Y2=-20|X3=30|Y3=-20", "|RECORD=27|LOCATIONCOUNT=2|X1=20|Y1=50|X2=40|Y2=50", "|RECORD=27|LOCATIONCOUNT=2|X1=30|Y1=-20|X2=100|Y2=90",
        # a connector whose right edge's middle (60, 40) is its primary point; its left entry is at (40, 50)
        "|RECORD=215|LOCATION.X=40|LOCATION.Y=60|XSIZE=20|YSIZE=40|PRIMARYCONNECTIONPOSITION=20|HARNESSCONNECTORSIDE=1", "|RECORD=216|SIDE=0|DISTANCEFROMTOP=1|NAME=DP", "|RECORD=217|TEXT=usb",
        "|RECORD=218|LOCATIONCOUNT=2|X1=60|Y1=40|X2=100|Y2=70",
    ]
    records = spark.createDataFrame([("d", i, r) for i, r in enumerate(text)], "doc_id string, pos int, record string").select("doc_id", "pos", params.parse(F.col("record")).alias("params"))
    got = {r["net"]: ([tuple(m) for m in r["members"]], r["ports"], [tuple(e) for e in r["entries"]]) for r in sheet.netlist(records).collect()}
    assert got == {
        "N00001": ([("R1", "1")], [], [("child", "child.SchDoc", "EN", 2)]),
        "USB.DP": ([("R1", "2")], ["USB.DP"], [("child", "child.SchDoc", "USB.DP", 1)]),
    }


def test_regions_and_bodies(spark):
    from tracewright.sources import board

    def body(record: bytes, *corners, holes=()):
        head = struct.pack("<BHHHHI", 1, board.UNLOCKED, 4, 0xFFFF, 2, 0xFFFFFFFF) + b"\0" * 5
        flat = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<dd", *p) for p in ps)
        return head + struct.pack("<I", len(record) + 1) + record + b"\0" + flat(corners) + b"".join(flat(h) for h in holes)

    square = [(0.5, -0.5), (1e12, 2.4), (float("nan"), -2.6)]
    cut = body(b"|HOLECOUNT=3", *square, holes=[[(1.0, 2.0)]]) + struct.pack("<I", 9)
    stream = b"".join(primitive(k, d) for k, d in ((11, cut), (12, body(b"|MODELID={A}|STANDOFFHEIGHT=1mil|MODEL.CHECKSUM=-5", *square)), (11, cut[:30]), (11, b"")))
    rows = board.raw_records(spark.createDataFrame([("p", "s", stream)], "path string, storage string, data binary"))
    (r,) = board.regions(rows).collect()
    assert [tuple(v) for v in r["outline"]] == [(1, -1), (2**31 - 1, 2), (0, -3)] and [[tuple(v) for v in h] for h in r["holes"]] == [[(1, 2)]]
    assert (r["net_index"], r["component_index"], r["sub_poly_index"]) == (5, 2, -1)
    (b,) = board.bodies(rows).collect()
    assert [tuple(v) for v in b["outline"]] == [(0, 0), (2**31 - 1, 2), (0, -2)] and (b["model_id"], b["standoff_height"], b["model_checksum"]) == ("{A}", 10000, -5)
    assert {x["error"] for x in board.shape_regions(rows).collect()} == {"more vertices than the record holds", "the record is too short"}


def test_records_are_cut_and_parsed_once(spark):
    """Neither the filter on what was cut nor the number of parameters that are read makes the work be done again."""
    from tracewright.sources import board

    streams = spark.createDataFrame([("a", "Data", b"")], "path string, storage string, data binary")
    plan = board.regions(board.raw_records(streams))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("run(__b") == 1 and plan.count("split(") == 1


def test_numbers_need_no_lambda(spark):
    """Fields are read by expressions that are compiled; one that the data does not hold is null."""
    from tracewright.functions import binary

    df = spark.createDataFrame([(b"\x01\x02\x03\xff",), (b"\x01",), (None,)], "b binary")
    found = df.select(binary.unsigned(F.col("b"), 1, 3).alias("u"), binary.int32(F.col("b"), 0).alias("i"))
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(0xFF0302, int.from_bytes(b"\x01\x02\x03\xff", "little", signed=True)), (None, None), (None, None)]
