"""Steps whose cost must not grow faster than their input: each did so before."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from tracewright.functions import params
from tracewright.operators import boxes, graph, ordering, schematic, spatial, stack
from tracewright.sources import board, sheet


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stream_data_is_put_together_once(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("path"), F.lit("Data").alias("storage"), F.when(F.col("id") > 0, F.concat(F.lit(b"\x01\x02\0\0\0"), F.lit(b"ab"))).alias("data"))
    found = board.raw_records(rows)
    assert "Filter" not in planned(found)
    assert sorted((r["path"], r["ord"], r["kind"], bytes(r["blocks"][0])) for r in found.collect()) == [("1", 0, 1, b"ab"), ("2", 0, 1, b"ab")]


def test_streams_come_back_in_frames(spark, monkeypatch):
    one = b"\x01" + struct.pack("<I", 2) + b"ab"
    monkeypatch.setattr(board, "FRAME_ROWS", 3)
    found = board.raw_records(spark.createDataFrame([("a", "s", one * 7), ("b", "s", None), ("c", "s", one)], "path string, storage string, data binary"))
    assert sorted((r["path"], r["ord"]) for r in found.collect()) == [*(("a", i) for i in range(7)), ("c", 0)]


def test_parts_are_dealt_before_their_records_are_made(spark):
    from tracewright.plans import designs

    assert "RepartitionByExpression [p_partkey" in planned(designs.board_regions(spark, "/root/testdata/sf0.001"))


def test_edges_are_contracted_where_they_lie(spark, monkeypatch):
    written = []
    write = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: written.append(name) or write(df, name))
    for node in ("bigint", "string"):
        edges = spark.range(1, 2000, 1, 1).select(F.col("id").cast(node).alias("a"), (F.col("id") - 1).cast(node).alias("b"))
        found = {r["node"]: r["root"] for r in graph.components(edges).collect()}
        assert set(found.values()) == {0 if node == "bigint" else "0"} and len(found) == 2000
    assert written == ["edges", "edges"]  # no round of joins
    monkeypatch.setattr(graph, "CONTRACT_ROWS", 3)
    long = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10] + [(7, 7), (50, 50), (None, 3)], "a int, b int")
    assert {r["node"]: r["root"] for r in graph.components(long.repartition(4)).collect()} == {i: (i - 1) // 10 * 10 + 1 for i in range(1, 41)} | {50: 50}


def test_vertices_index_their_parameters_once(spark):
    rows = spark.createDataFrame([("|X1=2|Y1=3|Y1_FRAC=5|EXTRALOCATIONCOUNT=2|EX2=4|EY3=9",)], "r string").select(params.vertices(params.parse(F.col("r")), F.lit(1)).alias("v"))
    assert planned(rows).count("map_from_entries") == 1
    assert [tuple(p) for p in rows.first()["v"]] == [(200_000, 300_005), (400_000, 0), (0, 900_000)]


def test_wide_strings_need_no_shuffle(spark):
    entry = lambda i, s: struct.pack("<II", i, 2 * len(s) + 2) + s.encode("utf-16-le") + b"\0\0"
    found = board.wide_strings(spark.createDataFrame([("a", entry(0, "x") + entry(1, "y") + entry(0, "z")), ("b", b"\0\0\0\0|ENCODEDTEXT0=65|ENCODEDTEXT2=66"), ("c", None)], "path string, data binary"))
    assert "Aggregate" not in planned(found)
    assert sorted(map(tuple, found.collect())) == [("a", 0, "z"), ("a", 1, "y"), ("b", 0, "A")]


def test_pin_fields_are_read_once(spark):
    assert planned(sheet.binary_pins(spark.createDataFrame([(b"",)], "body binary"))).count("PINLENGTH") == 1


def test_sheets_wider_than_int(spark):
    far = 90_000_000_000
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    pins = table([(1, "A", "1", far, 0), (1, "B", "1", far, far)], "doc_id int, designator string, pad string, x long, y long")
    wires = table([(1, [(far, 0), (far, far + 20_000)])], "doc_id int, vertices array<struct<x:long,y:long>>")
    labels = table([], "doc_id int, ord int, text string, x long, y long")
    ports = table([], "doc_id int, ord int, name string, x long, y long, width int, style int")
    found = schematic.nets(pins, wires, labels, labels, ports, labels.select("doc_id", "x", "y")).collect()
    assert [[m["designator"] for m in r["members"]] for r in found] == [["A", "B"]]


def test_equal_boxes_and_places_meet_once(spark, monkeypatch):
    seen = []
    once = spatial.pair_once
    monkeypatch.setattr(spatial, "pair_once", lambda hits, *rest: seen.append(hits.count()) or once(hits, *rest))
    rows = spark.range(50).select(F.lit("b").alias("path"), F.col("id").alias("ord"), F.lit(1).alias("component_index"), F.lit(1).alias("layer"))
    at = lambda v: F.struct(F.lit(v).alias("x"), F.lit(v).alias("y"))
    regions = rows.withColumn("outline", F.array(at(-3), at(3))).withColumn("is_shape_based", F.lit(True)).withColumn("sub_poly_index", F.lit(-1))
    found = boxes.pad_shapes(regions, rows.withColumn("x", F.lit(1)).withColumn("y", F.lit(1)))
    assert list(map(tuple, found.collect())) == [("b", 0, 0)]
    assert seen == [1]


def test_reached_heads_stay_out_of_joins(spark, monkeypatch):
    plans = []
    write = ordering.written
    monkeypatch.setattr(ordering, "written", lambda df, name: plans.append(planned(df)) or write(df, name))
    found = ordering.chain_positions(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 6)], "node int, after int"))
    assert sorted(map(tuple, found.collect())) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 1), (6, None)]
    assert all("Union" in p for p in plans[1:])


def test_entries_are_dealt_before_they_are_sorted(spark):
    board_ = spark.createDataFrame([(1, 0, "VX0", "1mil"), (1, 1, "VY0", "2mil"), (1, 2, "KIND0", "0")], "doc_id int, ord int, key string, value string")
    found = stack.outline(board_)
    assert "RepartitionByExpression [doc_id" in planned(found)
    assert [(v["x"], v["y"]) for v in found.first()["vertices"]] == [(10_000, 20_000)]
    assert "RepartitionByExpression [doc_id" in planned(stack.numbered_stack(board_))


def test_queries_in_several_passes(spark, monkeypatch):
    import numpy as np

    from tracewright.llm import ann

    monkeypatch.setattr(ann, "QUERY_ROWS", 4)
    monkeypatch.setattr(ann, "PASS_BYTES", 1)
    monkeypatch.setattr(ann, "TILE_BYTES", 1 << 10)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    v = np.random.default_rng(1).integers(-3, 4, (300, 4)).astype(float) + 0.5
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    d = lambda q: np.sqrt(sum((v[:, j] - v[q, j]) ** 2 for j in range(4)))
    assert got == {q: [(i, d(q)[i]) for i in sorted((i for i in range(300) if i != q), key=lambda i: (d(q)[i], i))[:10]] for q in range(0, 300, 20)}
    assert spark.conf.get(name) == before


def test_ini_reads_a_document_in_one_pass(spark):
    from tracewright.sources import text

    body = "﻿[A]\r\nx=1\r\n y = 2 \n[B]\n=0\n[A]\nx=3\nx=4\nz\n[ ]\n[]\n"
    found = text.ini(spark.createDataFrame([("p", body), ("q", "a=1\nb=2\n[S]\nc=3"), ("r", None), ("s", "")], "path string, text string"))
    assert not any(word in planned(found) for word in ("Window", "Join", "Aggregate", "Filter"))
    assert sorted(map(tuple, found.collect()), key=str) == [("p", "A", 0, "x", 6, "4", None), ("p", "B", 3, "", 4, "0", None), ("q", None, None, None, None, None, "key a before any section")]
