"""Netlists: endpoints grouped by net, merging of nets by name, names for unnamed nets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_tsv, quote_sexpr
from .ordering import global_rank
from .resolve import first_by


def endpoints(pads: DataFrame) -> DataFrame:
    """Pads (net, designator, pad) that take part: with a net and a pad name."""
    return pads.where((F.coalesce(F.col("net"), F.lit("")) != "") & (F.coalesce(F.col("pad"), F.lit("")) != ""))


def group_by_net(pads: DataFrame) -> DataFrame:
    """(net, n_conn, members): the distinct endpoints of each net, sorted by designator and pad as bytes."""
    grouped = endpoints(pads).select("net", "designator", "pad").distinct().groupBy("net").agg(F.array_sort(F.collect_list(F.struct("designator", "pad"))).alias("members"))
    return grouped.select("net", F.size("members").cast("long").alias("n_conn"), "members")


def members_text(members: Column, between: str = " ") -> Column:
    return F.array_join(F.transform(members, lambda m: F.concat_ws("-", m["designator"], m["pad"])), between)


def board_netlist(components: DataFrame, pads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components, first row of each designator, and nets of a board.

    ``components``: (doc_id, ord, designator, ...); ``pads``: (doc_id, ord, component_index, designator, net), of which
    ``designator`` is the pad's name. A pad whose component does not exist is free and belongs to '?'.
    """
    parts = first_by(components, ["doc_id", "designator"], ["ord"])
    owner = components.select("doc_id", F.col("ord").alias("component_index"), F.col("designator").alias("__owner"))
    joined = pads.join(owner, ["doc_id", "component_index"], "left")
    named = joined.select(F.concat_ws("\x00", "doc_id", "net").alias("__net"), "doc_id", "net", F.coalesce("__owner", F.lit("?")).alias("designator"), F.col("designator").alias("pad"))
    nets = endpoints(named).select("doc_id", "net", "designator", "pad").distinct().groupBy("doc_id", "net").agg(F.array_sort(F.collect_list(F.struct("designator", "pad"))).alias("members"))
    return parts, nets


def merge_by_name(nets: DataFrame, auto: Column, least: int = 2) -> DataFrame:
    """Nets (name, designator, pad) of one name become one; automatic names with fewer than ``least`` distinct members go.

    Members are counted after duplicates are removed. ``auto`` judges the name, so a label that looks automatic counts as such.
    """
    rows = nets.select("name", "designator", "pad").distinct()
    return rows.groupBy("name").agg(F.count("*").alias("n_members")).where(~auto | (F.col("n_members") >= least))


def name_roots(candidates: DataFrame, roots: DataFrame, order: list[str]) -> DataFrame:
    """(root, name): each root's candidate name of least priority and position, else ``N`` and a five-digit number.

    ``candidates``: (root, priority, ord, name); ``roots``: the root and what orders it. Numbers run over the unnamed
    roots only.
    """
    named = candidates.where("name is not null").groupBy("root").agg(F.min_by("name", F.struct("priority", "ord")).alias("name"))
    unnamed = global_rank(roots.join(named, "root", "left_anti"), order, "__n")
    auto = unnamed.select("root", F.concat(F.lit("N"), F.when(F.col("__n") < 100000, F.lpad(F.col("__n").cast("string"), 5, "0")).otherwise(F.col("__n").cast("string"))).alias("name"))
    return named.unionByName(auto)


def protel(components: DataFrame, nets: DataFrame) -> DataFrame:
    """One text for each document: bracketed components, then nets in parentheses, lines ended by CR LF."""
    end = F.lit("\r\n")
    lines = lambda *x: F.concat(*(F.concat(v, end) for v in x))
    part = components.select("doc_id", F.lit(0).alias("k"), F.col("designator").alias("sort"), lines(F.lit("["), F.col("designator"), F.coalesce("footprint", F.lit("")), F.coalesce("value", F.lit("")), F.lit("]")).alias("line"))
    net = nets.select("doc_id", F.lit(1).alias("k"), F.col("net").alias("sort"), lines(F.lit("("), F.col("net"), F.array_join(F.transform("members", lambda m: F.concat_ws("-", m["designator"], m["pad"])), "\r\n"), F.lit(")")).alias("line"))
    return part.unionByName(net).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "sort", "line"))), lambda x: x["line"]), "").alias("text"))


def tsv_rows(nets: DataFrame) -> DataFrame:
    """Net, designator and pad of each connection, safe for a tab-separated file."""
    return nets.select("doc_id", "net", F.explode("members").alias("m")).select("doc_id", *(plain_tsv(F.col(c)).alias(n) for c, n in (("net", "net"), ("m.designator", "designator"), ("m.pad", "pad"))))


def kicad(components: DataFrame, nets: DataFrame) -> DataFrame:
    """One S-expression for each document: components, then nets numbered from 1 in the order of their names."""
    q = lambda c: quote_sexpr(F.coalesce(c, F.lit("")))
    part = F.concat(F.lit("    (comp (ref "), q(F.col("designator")), F.lit(")\n      (value "), q(F.col("value")), F.lit(")\n      (footprint "), q(F.col("footprint")), F.lit("))\n"))
    parts = components.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("t")))), lambda x: x["t"]), "").alias("parts"))
    pins = F.array_join(F.transform("members", lambda m: F.concat(F.lit("      (node (ref "), q(m["designator"]), F.lit(") (pin "), q(m["pad"]), F.lit("))\n"))), "")
    sorted_nets = F.array_sort(F.collect_list(F.struct("net", F.concat(F.lit(") (name "), q(F.col("net")), F.lit(")\n"), pins, F.lit("    )\n")).alias("t"))))
    listed = nets.groupBy("doc_id").agg(F.array_join(F.transform(sorted_nets, lambda x, i: F.concat(F.lit("    (net (code "), (i + 1).cast("string"), x["t"])), "").alias("nets"))
    text = F.concat(F.lit("(export (version D)\n  (components\n"), F.coalesce("parts", F.lit("")), F.lit("  )\n  (nets\n"), F.coalesce("nets", F.lit("")), F.lit("  )\n)\n"))
    return parts.join(listed, "doc_id", "full_outer").select("doc_id", text.alias("text"))


def as_json(components: DataFrame, nets: DataFrame) -> DataFrame:
    """One JSON object for each document, without the components' parameters."""
    part = F.struct("designator", "footprint", "value", "library_reference", "description")
    parts = components.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("c")))), lambda x: x["c"]).alias("components"))
    listed = nets.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("net").alias("name"), F.col("members").alias("connections")))).alias("nets"))
    return parts.join(listed, "doc_id", "full_outer").select("doc_id", F.to_json(F.struct("components", "nets"), {"ignoreNullFields": "false"}).alias("json"))
