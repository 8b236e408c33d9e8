"""Operators on small tables whose results are known."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import bits, params, text, units
from tracewright.operators import dedup, diff, documents, flatten, graph, netlist, ordering, reports, resolve, schematic, spatial

MIL = 10_000


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


# -- scalar functions


@pytest.mark.parametrize(("given_", "raw"), [("123mil", 1_230_000), ("10.5mil", 105_000), ("25.4mm", 10_000_000), ("1in", 10_000_000), ("1inch", 10_000_000), ("42", 42), ("x", None), ("", None), ("9999999999mil", 2_147_483_647)])
def test_lengths(spark, given_, raw):
    got = one(spark, units.parse_length(F.col("t")), t=given_)
    assert got == raw or abs(got - raw) <= 1


@pytest.mark.parametrize(("raw", "shown"), [(-12_500, "-1.25mil"), (10_000, "1mil"), (1, "0.0001mil"), (0, "0mil"), (-2_147_483_648, "-214748.3648mil")])
def test_length_text(spark, raw, shown):
    assert one(spark, units.mil_text(F.col("r")), r=raw) == shown


def test_saturation(spark):
    assert one(spark, units.saturating_add(F.lit(2**31 - 1), F.lit(5))) == 2**31 - 1
    assert one(spark, units.saturating_sub(F.lit(-(2**31)), F.lit(5))) == -(2**31)


def test_fixed_decimals_are_exact(spark):
    r = random.Random(1)
    raws = [r.randint(-(2**31), 2**31 - 1) for _ in range(300)] + [i * 100 + 50 for i in range(300)]
    rows = spark.createDataFrame([(x,) for x in raws], "r int").select("r", units.fixed(F.col("r") / 10000.0, 2).alias("s")).collect()
    for row in rows:
        want = Decimal(row["r"] / 10000.0).quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN)
        assert row["s"] in (str(want), "0.00" if want == 0 else str(want), "-0.00" if want == 0 else str(want))


@pytest.mark.parametrize(("given_", "n"), [("4.310", 4310), ("3.0005", 3001), ("-0.0005", -1), ("four", None), (".", None), ("1e3", None)])
def test_thousandths(spark, given_, n):
    assert one(spark, units.thousandths(F.col("t")), t=given_) == n


def test_two_bool_rules(spark):
    for value, loose, strict in [("T", True, False), ("t", True, False), ("TRUE", True, True), ("true", True, True), ("F", False, False), ("", False, False), (None, False, False), ("yes", False, False)]:
        df = spark.createDataFrame([(value,)], "v string").select(params.as_bool(F.col("v")).alias("a"), params.as_explicit_bool(F.col("v")).alias("b")).first()
        assert (df["a"], df["b"]) == (loose, strict), value


def test_parameter_records(spark):
    df = spark.createDataFrame([("|RECORD=1|Name=a|NAME=b|%UTF8%Text=Ω|Text=?|Empty=|Flag|X=1=2|M0=p|M1=q|M3=r",)], "t string").select(params.parse(F.col("t")).alias("p"))
    p = F.col("p")
    got = df.select(params.first(p, "name").alias("first"), params.last(p, "name").alias("last"), params.lookup(p, "TEXT").alias("utf8"), params.first(p, "empty").alias("empty"), params.first(p, "none").alias("none"), params.first(p, "x").alias("x"), params.indexed(p, "M").alias("m")).first()
    assert got.asDict() == {"first": "a", "last": "b", "utf8": "Ω", "empty": "", "none": None, "x": "1=2", "m": ["p", "q"]}


def test_quoted_tokens(spark):
    t = 'Comment=10k,"Component Kind=Standard, x",Footprint=R0402,"Quoted ""name""=value",'
    assert one(spark, params.quoted_tokens(F.lit(t))) == ["Comment=10k", "Component Kind=Standard, x", "Footprint=R0402", 'Quoted "name"=value', ""]


def test_three_quoting_rules(spark):
    for value, placement, bom, tsv in [("a,b", '"a,b"', '"a,b"', "a,b"), ("a\rb", "a\rb", '"a\rb"', "a b"), ('q"', '"q"""', '"q"""', 'q"'), ("x\ty", "x\ty", "x\ty", "x y")]:
        df = spark.createDataFrame([(value,)], "v string").select(text.quote_placement(F.col("v")).alias("p"), text.quote_bom(F.col("v")).alias("b"), text.plain_tsv(F.col("v")).alias("t")).first()
        assert tuple(df) == (placement, bom, tsv)


def test_safe_path(spark):
    assert one(spark, text.safe_path(F.lit(r"..\a\.\b/../c.txt"))) == "UNSAFE/a/b/UNSAFE/c.txt"


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=40))
def test_checksum(spark, data):
    want = sum(b * max(i, 1) for i, b in enumerate(data)) % 2**32
    assert one(spark, bits.weighted_checksum(F.lit(bytearray(data)))) == (want - 2**32 if want >= 2**31 else want)


def test_colours(spark):
    assert one(spark, bits.colour_text(F.lit(0x0302FF))) == "#ff0203"


# -- lookups and order


def test_live_designator(spark):
    comps = spark.createDataFrame([("d", 0, "n0", "R1"), ("d", 1, "n1", ""), ("d", 2, "n2", None)], "doc_id string, ord int, name string, source_designator string")
    texts = spark.createDataFrame([("d", 0, 5, " R9 ", True), ("d", 0, 6, "R8", True), ("d", 1, 1, ".Designator", True), ("d", 2, 1, "C", False)], "doc_id string, component_index int, ord int, text string, is_designator boolean")
    assert {r["ord"]: r["designator"] for r in resolve.live_designator(comps, texts).collect()} == {0: "R9", 1: "n1", 2: "n2"}


def test_global_rank_and_chains(spark):
    r = random.Random(2)
    values = [(i, r.randrange(50)) for i in range(500)]
    got = {x["i"]: x["rank"] for x in ordering.global_rank(spark.createDataFrame(values, "i int, v int"), ["v", "i"]).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(values, key=lambda x: (x[1], x[0])), 1)}
    links = [(i, i - 1 if i % 40 else None) for i in range(200)] + [(900, 901), (901, 900)]
    got = {x["node"]: x["position"] for x in ordering.chain_positions(spark.createDataFrame(links, "node int, after int")).collect()}
    assert got == {i: i % 40 for i in range(200)} | {900: None, 901: None}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components(spark, edges):
    parent = {n: n for e in edges for n in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: find(n) for n in parent}


def test_long_chain_is_one_component(spark):
    got = graph.components(spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.select("root").distinct().collect()[0]["root"] == 0 and got.count() == 1001


# -- netlists


def test_board_netlist(spark):
    comps = spark.createDataFrame([("d", 0, "R1")], "doc_id string, ord int, designator string")
    pads = spark.createDataFrame([("d", 0, 0, "1", "VCC"), ("d", 1, 0, "2", "GND"), ("d", 2, 42, "99", "VBUS"), ("d", 3, 0, None, "VCC"), ("d", 4, 0, "3", None), ("d", 5, 0, "1", "VCC")], "doc_id string, ord int, component_index int, designator string, net string")
    parts, nets = netlist.board_netlist(comps, pads)
    assert parts.count() == 1
    assert {r["net"]: [tuple(m) for m in r["members"]] for r in nets.collect()} == {"VCC": [("R1", "1")], "GND": [("R1", "2")], "VBUS": [("?", "99")]}
    full = parts.withColumn("footprint", F.lit("0402")).withColumn("value", F.lit(None).cast("string"))
    assert netlist.protel(full, nets).first()["text"].startswith("[\r\nR1\r\n0402\r\n\r\n]\r\n(\r\nGND\r\nR1-2\r\n)\r\n")
    assert netlist.tsv_rows(nets).count() == 3


def sheet(spark, pins=(), wires=(), labels=(), power=(), ports=(), junctions=()):
    make = lambda rows, ddl: spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "doc_id string, ord int, " + ddl)
    found = schematic.nets(
        make(pins, "designator string, pad string, x int, y int"), make([([{"x": x, "y": y} for x, y in w],) for w in wires], "vertices array<struct<x:int,y:int>>"),
        make(labels, "text string, x int, y int"), make(power, "text string, x int, y int"), make(ports, "name string, x int, y int, width int, style int"), make(junctions, "x int, y int"),
    )
    return {r["net"]: ([tuple(m) for m in r["members"]], r["ports"]) for r in found.collect()}


def test_wire_joins_within_tolerance(spark):
    pins = [("R1", "1", 10 * MIL, 0), ("R2", "1", 40 * MIL, 0), ("R3", "1", 25 * MIL, 40), ("R4", "1", 25 * MIL, 20 * MIL)]
    got = sheet(spark, pins, wires=[[(10 * MIL + 40, 0), (40 * MIL, 0)], [(10 * MIL, 0), (10 * MIL + 40, 0)]])
    assert [m for m, _ in got.values()] == [[("R1", "1"), ("R2", "1"), ("R3", "1")]]


def test_names_and_filters(spark):
    pins = [("R1", "1", 0, 0), ("R2", "1", 100, 0), ("R3", "1", 50_000_000, 0), ("C1", "1", 60_000_000, 0), ("C2", "1", 70_000_000, 0)]
    got = sheet(spark, pins, wires=[[(0, 0), (100, 0)], [(60_000_000, 0), (70_000_000, 0)]], labels=[(" ", 0, 0)], power=[("GND", 0, 0)], ports=[("OUT", 60_000_000 - 500, 0, 1_000_000, 0)])
    assert got == {"GND": ([("R1", "1"), ("R2", "1")], []), "OUT": ([("C1", "1"), ("C2", "1")], ["OUT"])}
    assert sheet(spark, pins[:2], labels=[("A", 0, 0), ("A", 100, 0)]) == {"A": ([("R1", "1"), ("R2", "1")], [])}
    assert sheet(spark, [("R1", "1", 0, 0), ("R2", "2", 0, 0), ("R3", "3", 5, 5)]) == {"N00001": ([("R1", "1"), ("R2", "2")], [])}


def test_pin_rules(spark):
    df = spark.createDataFrame([(1, 2, -1, 0, 1), (0, 2, -1, 0, 1), (2, 2, 1, 0, 2), (2, 2, 0, 0, 2), (2, 2, 1, 0, 1)], "p int, cp int, m int, cm int, n int")
    assert [r["v"] for r in df.select(schematic.visible(*map(F.col, ("p", "cp", "m", "cm", "n"))).alias("v")).collect()] == [False, True, False, True, True]
    pins = spark.createDataFrame([("s", 0, "1"), ("s", 0, "2")], "doc_id string, component_ord int, pad string")
    maps = spark.createDataFrame([("s", 0, 0, "1", ["A"]), ("s", 0, 1, "1", ["B", "C"]), ("s", 0, 2, "1", [])], "doc_id string, component_ord int, ord int, pad string, pads array<string>")
    assert sorted(r["pad"] for r in schematic.fan_out(pins, maps).collect()) == ["2", "B", "C"]


# -- geometry


def test_on_segment(spark):
    cases = [((50, 5), True), ((0, 0), False), ((100, 0), False), ((50, 11), False), ((-5, 0), True), ((105, 3), True)]
    for (x, y), want in cases:
        assert one(spark, spatial.on_segment(*map(F.lit, (x, y, 0, 0, 100, 0)), 10)) == want, (x, y)
    big = 2_000_000_000
    assert one(spark, spatial.on_segment(*map(F.lit, (0, 0, -big, -big, big, big)), MIL))


def test_nearest_node_ties(spark):
    points = spark.createDataFrame([(1, "s", 0, 0), (2, "s", 10**6, 0)], "id int, doc_id string, x int, y int")
    nodes = spark.createDataFrame([("s", 60_000, 0), ("s", -60_000, 0), ("s", 0, 60_000), ("t", 0, 0), ("s", 10**6 + 100_001, 0)], "doc_id string, x int, y int")
    got = {r["id"]: (r["node_x"], r["node_y"]) for r in spatial.nearest_node(points, nodes, 100_000).collect()}
    assert got == {1: (-60_000, 0), 2: (None, None)}


def test_flatten_array_and_cap(spark):
    ddl = "parent string, child string, ord int, x double, y double, rotation double, mirror boolean, cols int, rows int, dx double, dy double, origin_x double, origin_y double"
    panel = spark.createDataFrame([("p", "c", 0, 1000.0, 2000.0, 0.0, False, 2, 3, 200.0, 150.0, 100.0, 200.0), ("p", None, 1, 0.0, 0.0, 0.0, False, 1, 1, 0.0, 0.0, 0.0, 0.0)], ddl)
    found, lost = flatten.instances(panel, spark.createDataFrame([("p",)], "doc string"))
    x, y = flatten.applied(F.lit(150.0), F.lit(260.0))
    got = [(r["x"], r["y"]) for r in found.where("doc = 'c'").orderBy("visit").select(x.alias("x"), y.alias("y")).collect()]
    assert got == [(1050 + 200 * c, 2060 + 150 * r) for c in range(2) for r in range(3)]
    assert [r["ord"] for r in lost.collect()] == [1]
    loop = spark.createDataFrame([("p", "p", 0, 1.0, 0.0, 90.0, True, 1, 1, 0.0, 0.0, 0.0, 0.0)], ddl)
    found, lost = flatten.instances(loop, spark.createDataFrame([("p",)], "doc string"))
    assert found.count() == flatten.DEPTH + 1 and lost.count() == 1


def test_rotation_by_quarters(spark):
    ddl = "parent string, child string, ord int, x double, y double, rotation double, mirror boolean, cols int, rows int, dx double, dy double, origin_x double, origin_y double"
    for rotation, mirror, want, turn in [(90.0, True, (-2, -1), 60.0), (90.0, False, (-2, 1), 120.0), (180.0, False, (-1, -2), 210.0), (270.0, False, (2, -1), 300.0), (0.0, True, (-1, 2), 330.0)]:
        df = spark.createDataFrame([("p", "c", 0, 0.0, 0.0, rotation, mirror, 1, 1, 0.0, 0.0, 0.0, 0.0)], ddl)
        found, _ = flatten.instances(df, spark.createDataFrame([("p",)], "doc string"))
        x, y = flatten.applied(F.lit(1.0), F.lit(2.0))
        r = found.where("doc = 'c'").select(x.alias("x"), y.alias("y"), flatten.turned(F.lit(30.0)).alias("t")).first()
        assert (r["x"], r["y"]) == want and r["t"] == pytest.approx(turn), rotation


def test_doubled_area(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    for points, want in [(square, 200), (square[::-1], -200), ([], 0), ([(1, 1)], 0)]:
        df = spark.createDataFrame([([{"x": x, "y": y} for x, y in points],)], "p array<struct<x:int,y:int>>")
        assert df.select(spatial.doubled_area(F.col("p")).alias("a")).first()["a"] == want


# -- reports and differences


def test_placement_order_and_lines(spark):
    ddl = "doc_id string, ord int, designator string, comment string, pattern string, description string, component_kind int, x int, y int, rotation double, layer int"
    rows = [("d", 0, "R16", "10K", "R0402", None, 0, 300 * MIL, 400 * MIL, 90.0, 1), ("d", 1, "R2", "a,b", "R0402", "", 0, 100 * MIL, 200 * MIL, 22.5, 32), ("d", 2, "TP1", None, None, None, 5, 0, 0, 0.0, 1), ("d", 3, "MH1", None, None, None, 1, 0, 0, 0.0, 1), ("d", 4, "R02", None, None, None, 0, 0, 0, 0.0, 1)]
    comps = spark.createDataFrame(rows, ddl)
    placed = reports.placements(comps, origin=(100 * MIL, 200 * MIL))
    assert [r["designator"] for r in placed.orderBy("place").collect()] == ["R2", "R02", "R16"]
    assert reports.placements(comps, with_requested=True).count() == 4
    got = {r["designator"]: (r["a"], r["b"], r["c"]) for r in placed.select("designator", reports.placement_line(0).alias("a"), reports.placement_line(1).alias("b"), reports.placement_line(2, "mil").alias("c")).collect()}
    assert got["R16"] == ("R16,10K,TopLayer,R0402,5.0800,5.0800,90,", "R16,10K,R0402,5.0800,5.0800,90,Top", "R16,10K,R0402,200.00,200.00,90,top")
    assert got["R2"][2] == 'R2,"a,b",R0402,0.00,0.00,22.50,bottom'


def test_rules_report(spark):
    rows = spark.createDataFrame([("d", 0, "Width", 2, "b"), ("d", 1, "Clearance", 1, "z"), ("d", 2, "Width", 1, "c")], "doc_id string, ord int, kind string, priority int, name string")
    got = [(r["ord"], r["new_kind"]) for r in reports.rules(rows).orderBy("place").collect()]
    assert got == [(1, True), (2, True), (0, False)]


def test_rule_texts(spark):
    ddl = "doc_id string, ord int, kind string, priority int, name string, enabled boolean, scope1 string, scope2 string, comment string, params array<struct<name:string,value:string>>"
    rows = [("d", 0, "Width", 1, "W", False, "All", "InNet('A')", "note", [("Name", "W"), ("MAXLIMIT", "10mil"), ("EMPTY", "")]), ("d", 1, "Clearance", 1, "C", True, "", "", "", [])]
    lines = [r["line"] for r in reports.rule_texts(spark.createDataFrame(rows, ddl), metric=True).orderBy("ord", "part").collect()]
    assert lines == ["[Clearance]", "  C (priority 1)", "[Width]", "  W (priority 1) [disabled]", "    scope: All  vs  InNet('A')", "    comment: note", "    MAXLIMIT=0.254mm", "2 rule(s)"]


def test_moved_polygons_and_kept_boards(spark):
    ddl = "parent string, child string, ord int, x double, y double, rotation double, mirror boolean, cols int, rows int, dx double, dy double, origin_x double, origin_y double"
    found, _ = flatten.instances(spark.createDataFrame([("p", "c", 0, 100.0, 0.0, 90.0, True, 1, 1, 0.0, 0.0, 0.0, 0.0)], ddl), spark.createDataFrame([("p",)], "doc string"))
    vertex = [{"x": 10, "y": 1, "is_arc": True, "cx": 0, "cy": 0, "start_angle": 0.0, "end_angle": 90.0}, {"x": 5, "y": 5, "is_arc": False, "cx": 7, "cy": 7, "start_angle": 1.0, "end_angle": 2.0}]
    polygon = spark.createDataFrame([("c", 1.0, 2.0, vertex)], "doc string, x double, y double, vertices array<struct<x:int,y:int,is_arc:boolean,cx:int,cy:int,start_angle:double,end_angle:double>>")
    r = flatten.moved(polygon, "polygon", found).first()
    assert (r["x"], r["y"]) == (98, -1)
    a, b = r["vertices"]
    assert (a["x"], a["y"], a["cx"], a["cy"]) == (99, -10, 100, 0) and (a["start_angle"], a["end_angle"]) == pytest.approx((180.0, 270.0))
    assert (b["x"], b["y"], b["cx"], b["start_angle"]) == (95, -5, 7, 1.0)
    kept = spark.createDataFrame([("c", 1.0, 2.0, 0.0, 0, 0, 10, 20, False)], "doc string, x double, y double, rotation double, box_x0 int, box_y0 int, box_x1 int, box_y1 int, mirror boolean")
    r = flatten.moved(kept, "embedded", found).first()
    assert (r["box_x0"], r["box_y0"], r["box_x1"], r["box_y1"], r["mirror"]) == (80, -10, 100, 0, True) and r["rotation"] == pytest.approx(90.0)


def test_differences(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "y", "r")], "id int, kind string, v string")
    b = spark.createDataFrame([(1, "x", "p"), (2, "x", "Q"), (4, "y", "s"), (5, "y", "s")], "id int, kind string, v string")
    assert {r["kind"]: (r["added"], r["removed"], r["changed"]) for r in diff.changed(a, b, ["id"], "kind").collect()} == {"x": (0, 0, 1), "y": (2, 1, 0)}
    assert {r["kind"]: (r["added"], r["removed"]) for r in diff.multiset(a.drop("id"), b.drop("id"), "kind").collect()} == {"x": (1, 1), "y": (2, 1)}


def test_suffixed_files(spark):
    rows = spark.createDataFrame([(0, "m.step", "A"), (1, "m.step", "B"), (2, "m.step", "A"), (3, "m.step", ""), (4, "n", "A"), (5, "n", "C")], "ord int, name string, data string")
    assert sorted((r["file"], r["copies"]) for r in dedup.suffixed(rows, "name", "data", "ord").collect()) == [("m-2.step", 1), ("m.step", 2), ("n", 1), ("n-2", 1)]
    rows = spark.createDataFrame([(0, "x-2.s", "A"), (1, "x.s", "B"), (2, "x.s", "C"), (3, "x.s", "D"), (4, "x-3.s", "E"), (5, "a/b:c", "F")], "ord int, name string, data string")
    got = {r["first"]: r["file"] for r in dedup.suffixed(rows, "name", "data", "ord").collect()}
    assert got == {0: "x-2.s", 1: "x.s", 2: "x-3.s", 3: "x-4.s", 4: "x-3-2.s", 5: "a_b_c"}


def test_document_paths(spark):
    df = spark.createDataFrame([(1, '{"components":[{"d":"R16","k":1},{"d":"R2","k":9}],"nets":[]}'), (2, "broken"), (3, None)], "i int, t string").select("i", documents.parsed(F.col("t")).alias("d"))
    got = {r["i"]: tuple(r)[1:] for r in df.select("i", documents.length(F.col("d"), "$.components").alias("n"), documents.at(F.col("d"), "$.components[0].d").alias("first"), documents.length(F.col("d")).alias("fields")).collect()}
    assert got == {1: (2, "R16", 2), 2: (None, None, None), 3: (None, None, None)}
    each = documents.each(df, "d", "$.components", keep=("i",))
    found = each.select("i", "pos", documents.at(F.col("value"), "$.d").alias("n"), documents.at(F.col("value"), "$.k", "int").alias("k")).where("k > 5").collect()
    assert [tuple(r) for r in found] == [(1, 1, "R2", 9)]


# -- further functions


def test_overline_runs(spark):
    for value, want in [("R\\E\\SET", [("RE", True), ("SET", False)]), ("abc", [("abc", False)]), ("\\a\\\\b", [("a", True), ("b", False)]), ("", [])]:
        assert [tuple(x) for x in one(spark, text.overline_runs(F.lit(value)))] == want


def test_wrapping(spark):
    assert one(spark, text.wrapped(F.lit("aa bb cc\n\ndddddddd e"), F.lit(10.0), F.lit(36.0))) == ["aa bb", "cc", "", "dddddddd", "e"]


def test_guids_and_exponents(spark):
    guid = "{00112233-4455-6677-8899-AABBCCDDEEFF}"
    data = one(spark, text.guid_bytes(F.lit(guid)))
    assert data.hex() == "33221100554477668899aabbccddeeff" and one(spark, text.guid_text(F.lit(data))) == guid
    assert one(spark, text.guid_bytes(F.lit("{12}"))) is None
    assert one(spark, text.exponent_text(F.lit(5.3844e-11))) == "5.384400E-011" and one(spark, text.exponent_text(F.lit(0.0))) == "0.000000E+000"


def test_two_section_keys(spark):
    name = "a/b:" + "x" * 40
    assert one(spark, text.section_key(F.lit(name))) == "a_b_" + "x" * 27 and one(spark, text.footprint_key(F.lit(name))) == "a_b:" + "x" * 27


def test_rule_values_in_mm(spark):
    for key, value, want in [("GAP", "10mil", "0.254mm"), ("GAP", "x mil", "x mil"), ("ObjectClearances", "a:b:100000;c;d:x", "a:b:0.254mm;c;d:x"), ("GAP", "7", "7")]:
        assert one(spark, units.rule_value_in_mm(F.lit(key), F.lit(value))) == want


def test_indirection_and_via_names(spark):
    from tracewright.functions import layers

    p = params.parse(F.lit("|Comment=10k|comment=x"))
    assert [one(spark, text.indirect(F.lit(v), p)) for v in ("=COMMENT", "=Other", "plain")] == ["10k", "Other", "plain"]
    assert [one(spark, layers.via_structure(F.lit(v))) for v in (0, 12, 40)] == ["none", "VII", "unknown (40)"]


@pytest.mark.parametrize(
    ("points", "offset", "want"),
    [
        ([(0, 0), (10, 0), (10, 10), (0, 10)], 2, [(-2, -2), (12, -2), (12, 12), (-2, 12)]),
        ([(0, 0), (0, 10), (10, 10), (10, 0)], 2, [(-2, -2), (-2, 12), (12, 12), (12, -2)]),
        ([(0, 0), (10, 0), (10, 10), (0, 10)], -2, [(2, 2), (8, 2), (8, 8), (2, 8)]),
        ([(0, 0), (10, 0), (10, 10), (0, 10)], -6, None),
        ([(0, 0), (10, 0)], 2, None),
        ([(0, 0), (5, 0), (10, 0)], 2, None),
        ([(0, 0), (20, 0), (20, 10), (10, 10), (10, 20), (0, 20)], 2, [(-2, -2), (22, -2), (22, 12), (12, 12), (12, 22), (-2, 22)]),
    ],
)
def test_polygon_offset(spark, points, offset, want):
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in points],)], "p array<struct<x:int,y:int>>")
    got = df.select(spatial.offset_polygon(F.col("p"), F.lit(offset)).alias("o")).first()["o"]
    assert got == want if want is None else [(p["x"], p["y"]) for p in got] == want


def test_further_netlist_formats(spark):
    comps = spark.createDataFrame([("d", 0, "R 1", None, "0402", None, None)], "doc_id string, ord int, designator string, value string, footprint string, library_reference string, description string")
    nets = spark.createDataFrame([("d", "VCC", [("R 1", "2")]), ("d", "GND", [("R 1", "1")])], "doc_id string, net string, members array<struct<designator:string,pad:string>>")
    out = netlist.kicad(comps, nets).first()["text"]
    assert out == '(export (version D)\n  (components\n    (comp (ref "R 1")\n      (value "")\n      (footprint 0402))\n  )\n  (nets\n    (net (code 1) (name GND)\n      (node (ref "R 1") (pin 1))\n    )\n    (net (code 2) (name VCC)\n      (node (ref "R 1") (pin 2))\n    )\n  )\n)\n'
    assert '"nets":[{"name":"GND"' in netlist.as_json(comps, nets).first()["json"]


def test_templates_files_and_zip(spark):
    vias = spark.createDataFrame([(1, None, None), (2, "L", "T"), (3, "L", "X"), (4, "L", "X")], "via int, library_id string, template_id string")
    links = spark.createDataFrame([(4, "L", "T")], "via int, library_id string, template_id string")
    got = resolve.with_template(vias, links, spark.createDataFrame([("L", "T", "v50")], "library_id string, template_id string, name string"))
    assert {r["via"]: (r["state"], r["template"]) for r in got.collect()} == {1: ("none", None), 2: ("resolved", "v50"), 3: ("unresolved", None), 4: ("resolved", "v50")}
    files = spark.createDataFrame([("lib/A.PcbDoc", 0), ("lib/a.pcbdoc", 0), ("old/A.PcbDoc", 1)], "file string, root_ord int")
    refs = spark.createDataFrame([(1, "x\\A.PcbDoc"), (2, "old/A.PcbDoc"), (3, "none")], "ref int, path string")
    assert {r["ref"]: r["file"] for r in resolve.best_file(refs, files).collect()} == {1: "lib/A.PcbDoc", 2: "lib/A.PcbDoc", 3: None}
    a, b = spark.createDataFrame([("d", 5, "p"), ("d", 1, "q")], "doc_id string, i int, x string"), spark.createDataFrame([("d", 9, "r"), ("d", 2, "s")], "doc_id string, j int, y string")
    assert {r["x"]: r["y"] for r in resolve.zipped(a, b, ["doc_id"], ["i"], ["j"]).collect()} == {"q": "s", "p": "r"}


# -- stacks, outlines, models, libraries, streams


def board(spark, text_):
    return spark.createDataFrame([("d", i, *kv.split("=", 1)) for i, kv in enumerate(text_.split("|"))], "doc_id string, ord int, key string, value string")


def test_layer_stacks(spark):
    from tracewright.operators import stack

    v9 = board(spark, "V9_STACK_LAYER0_NAME=Top|V9_STACK_LAYER0_COPTHICK=1.4mil|V9_STACK_LAYER1_NAME=Core|V9_STACK_LAYER1_DIELCONST=4.310|V9_STACK_LAYER0_NAME=Again|V9_STACK_LAYER3_NAME=Lost")
    assert [(r["place"], r["name"], r["copper_thickness"], r["dielectric_constant"]) for r in stack.numbered_stack(v9).orderBy("place").collect()] == [(0, "Top", 14000, None), (1, "Core", None, 4310)]
    v7 = board(spark, "V7_LAYER1NAME=old|V7_LAYER1NAME=A|V7_LAYER1NEXT=5|V7_LAYER5NAME=C|V7_LAYER5PREV=1|V7_LAYER5NEXT=3|V7_LAYER3NAME=B|V7_LAYER3PREV=5|V7_LAYER3NEXT=1|V7_LAYER9NAME=orphan|V7_LAYER9PREV=9|V7_LAYER9NEXT=9")
    assert [r["name"] for r in stack.linked_stack(v7).orderBy("place").collect()] == ["A", "C", "B", "orphan"]


def test_outline(spark):
    from tracewright.operators import stack

    corners = "|".join(f"KIND{i}=0|VX{i}={x}mil|VY{i}={y}mil" for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 0)]))
    r = stack.outline(board(spark, corners)).first()
    assert [(v["x"], v["y"], v["is_arc"]) for v in r["vertices"]] == [(0, 0, False), (MIL, 0, False), (MIL, MIL, False)] and r["error"] is None
    r = stack.outline(board(spark, corners + "|KIND4=2|VX4=1mil|VY4=1mil")).first()
    assert r["vertices"] is None and r["error"] == "corner 4"


def test_vertices(spark):
    p = params.parse(F.lit("|X1=1|Y1=2|X1_FRAC=5|X2=-1|EXTRALOCATIONCOUNT=3|EX3=7|EY3=8|EX5=1"))
    assert [tuple(v) for v in one(spark, params.vertices(p, F.lit(2)))] == [(100_005, 200_000), (-100_000, 0), (700_000, 800_000)]
    assert one(spark, params.vertices(p, F.lit(0))) == []


def test_models(spark):
    import zlib

    from tracewright.operators import models

    good = b"solid model"
    checksum = sum(b * max(i, 1) for i, b in enumerate(good))
    meta = spark.createDataFrame([("d", 0, "{a}", "good", checksum), ("d", 1, "{b}", "wrong", 1), ("d", 2, "{c}", "broken", 1), ("d", 3, "{d}", "none", 1)], "doc_id string, ord int, id string, name string, checksum int")
    data = spark.createDataFrame([("d", 0, bytearray(zlib.compress(good))), ("d", 1, bytearray(zlib.compress(good))), ("d", 2, bytearray(b"xx"))], "doc_id string, ord int, payload binary")
    bodies = spark.createDataFrame([("d", "{A}", "x"), ("d", "{Z}", "y"), ("d", "", "z")], "doc_id string, model_id string, name string")
    got = sorted((r["item"], r["message"]) for r in models.checks(models.joined(meta, data), bodies).collect())
    assert got == [("broken", "does not inflate"), ("none", "no payload"), ("wrong", "checksum differs"), ("{Z}", "model does not exist")]


def test_library_checks(spark):
    from tracewright.operators import library

    make = spark.createDataFrame
    listed = make([("l", "A", 2), ("l", "B", 1), ("l", "C", 0)], "library string, name string, stated_count int")
    stored = make([("l", "A", True, "A"), ("l", "B", False, "X"), ("l", "D", True, None)], "library string, name string, has_data boolean, pattern string")
    records = make([("l", "A", 0, 2, 202), ("l", "A", 1, 11, 7), ("l", "A", 2, 4, 48)], "library string, name string, ord int, kind int, size int")
    ids = make([("l", "A", 1, 1), ("l", "A", 9, 1)], "library string, name string, record_index int, type_code int")
    unique = make([("l", "A", 0, 2), ("l", "A", 1, 0)], "library string, name string, ord int, record_index int")
    got = {(r["check"], r["item"], r["message"]) for r in library.checks(listed, stored, records, ids, unique).collect()}
    assert got == {
        ("listed", "l/C", "has no storage"), ("stored", "l/D", "is not listed"), ("data", "l/B", "has no data stream"), ("pattern", "l/B", "pattern is X"), ("count", "l/A", "states 2, has 3"), ("count", "l/B", "states 1, has 0"),
        ("body", "l/A", "record 2 has 48 bytes"), ("guids", "l/A", "2 rows for 3 records"), ("guids", "l/A", "no record 9"), ("guids", "l/A", "wrong type of record 1"),
        ("unique ids", "l/A", "out of order at record 0"), ("unique ids", "l/A", "record 2 is no pad"),
    }


def test_streamed_net_sizes(spark, tmp_path):
    from tracewright.streaming import nets

    rows = spark.createDataFrame([("VCC", "R1", "1"), ("VCC", "R1", "1"), ("VCC", "R2", "1"), ("GND", "R1", "2"), (None, "R1", "3")], "net string, designator string, pad string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = nets.net_sizes(stream).writeStream.outputMode("complete").format("memory").queryName("net_sizes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["net"]: r["n_conn"] for r in spark.table("net_sizes").collect()} == {"VCC": 2, "GND": 1}
    seen = []
    nets.changed_sheets(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "c2")).awaitTermination(120)
    assert seen == [5]


def test_boxes(spark):
    from tracewright.operators import boxes

    make = lambda ddl, *rows: spark.createDataFrame([("p", i, 0, *r) for i, r in enumerate(rows)], "path string, ord int, component_index int, " + ddl)
    tables = {
        "track": make("x0 int, y0 int, x1 int, y1 int, width int", (10, 0, 0, 5, 3)), "arc": make("x int, y int, radius int, width int", (0, 0, 10, 4)), "pad": make("x int, y int, x_size_top int, y_size_top int", (0, 0, 6, 8)),
        "via": make("x int, y int, diameter int", (2**31 - 1, 0, 10)), "fill": make("x0 int, y0 int, x1 int, y1 int", (5, 5, 1, 1)), "text": make("x int, y int, height int, text string", (0, 0, 10, "abc")),
        "outline": make("outline array<struct<x:int,y:int>>", ([{"x": 1, "y": 2}, {"x": -3, "y": 9}],)),
    }
    got = {r["kind"]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in boxes.boxes(tables, ["path"]).collect()}
    assert got == {"track": (-1, -1, 11, 6), "arc": (-12, -12, 12, 12), "pad": (-3, -4, 3, 4), "via": (2**31 - 6, -5, 2**31 - 1, 5), "fill": (1, 1, 5, 5), "text": (0, 0, 18, 10), "outline": (-3, 2, 1, 9)}
    r = boxes.enclosing({k: tables[k] for k in ("track", "arc")}, ["path"]).first()
    assert (r["x_min"], r["y_min"], r["x_max"], r["y_max"]) == (-12, -12, 12, 12)
    shape = tables["outline"].withColumn("layer", F.lit(1)).withColumn("is_shape_based", F.lit(True)).withColumn("sub_poly_index", F.lit(-1))
    regions = shape.withColumn("ord", F.lit(5)).unionByName(shape.withColumn("ord", F.lit(7)))
    regions = regions.unionByName(shape.withColumn("is_shape_based", F.lit(False))).unionByName(shape.withColumn("sub_poly_index", F.lit(3)).withColumn("ord", F.lit(1)))
    pads = make("layer int, x int, y int", (1, 50, 50), (2, 0, 5), (1, 0, 5), (1, 1, 5))
    assert [tuple(r) for r in boxes.pad_shapes(regions, pads).collect()] == [("p", 5, 2)]
    owned, free = boxes.by_component(pads.withColumn("component_index", F.col("ord") - 1), spark.createDataFrame([("p", 0), ("p", 1)], "path string, ord int"))
    assert (owned.count(), free.count()) == (2, 2)


def test_numbers_and_owners(spark):
    nets = spark.createDataFrame([("d", 0, "A"), ("d", 1, "B"), ("d", 2, "A")], "doc_id string, ord int, name string")
    prims = spark.createDataFrame([("d", "A"), ("d", "B"), ("d", "C"), ("d", None)], "doc_id string, net string")
    assert {r["net"]: r["net_index"] for r in resolve.net_numbers(prims, nets).collect()} == {"A": 3, "B": 2, "C": 0, None: 0}
    records = spark.createDataFrame([("d", 0, None, 2), ("d", 1, 0, 1), ("d", 2, 9, 0)], "doc_id string, ord int, owner int, k int")
    assert {r["k"]: (r["ord"], r["owner"]) for r in resolve.retargeted(records, ["k"]).collect()} == {0: (0, None), 1: (1, 2), 2: (2, None)}
    side = spark.createDataFrame([("p", "s", 1, "u")], "path string, storage string, record_index int, uid string")
    prims = spark.createDataFrame([("p", "s", 2, 4), ("p", "s", 2, 9)], "path string, storage string, kind int, ord int")
    assert {r["ord"]: r["uid"] for r in resolve.by_slot(prims, side, "uid").collect()} == {4: None, 9: "u"}
    assert [r["ord"] for r in resolve.first_rows(prims, ["ord"], 1).collect()] == [4] and resolve.first_rows(prims, ["ord"], None).count() == 2
