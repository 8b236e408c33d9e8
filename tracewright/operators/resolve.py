"""Lookups by position, by first match and by the preceding parent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key: a minimum with partial aggregation, so a hot key does not gather its rows."""
    rest = [c for c in rows.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(best.alias("__row")).select(*key, *(F.col(f"__row.{c}").alias(c) for c in rest))


def positional(rows: DataFrame, index: str, names: DataFrame, ord_col: str, name: str, into: str) -> DataFrame:
    """Fills ``into``, where it is null, with the name at position ``index``."""
    side = names.select(F.col(ord_col).alias("__ord"), F.col(name).alias("__name"))
    found = rows.join(side, F.col(index) == F.col("__ord"), "left").drop("__ord")
    value = F.coalesce(F.col(into), F.col("__name")) if into in rows.columns else F.col("__name")
    return found.withColumn(into, value).drop("__name")


def unmatched(rows: DataFrame, others: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner."""
    return rows.join(others.select(*on).distinct(), list(on), "left_anti")


def preceding(rows: DataFrame, partition: Sequence[str], order: Sequence[str], is_parent: Column, value: str, into: str) -> DataFrame:
    """The value of the last parent at or before each row."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(into, F.last(F.when(is_parent, F.col(value)), ignorenulls=True).over(w))


def live_designator(components: DataFrame, texts: DataFrame) -> DataFrame:
    """``components`` (doc_id, ord, name, source_designator) with ``designator``.

    The first designator text of the component that, trimmed, is neither empty nor starts with a point; else the source
    designator if not empty; else the name. ``texts``: (doc_id, component_index, ord, text, is_designator).
    """
    t = F.trim("text")
    shown = texts.where(F.col("is_designator") & (t != "") & ~t.startswith(".")).groupBy("doc_id", F.col("component_index").alias("ord")).agg(F.min_by(t, F.col("ord")).alias("__shown"))
    source = F.when(F.col("source_designator") != "", F.col("source_designator"))
    return components.join(shown, ["doc_id", "ord"], "left").withColumn("designator", F.coalesce("__shown", source, "name")).drop("__shown")


def with_template(vias: DataFrame, links: DataFrame, templates: DataFrame) -> DataFrame:
    """``vias`` (via, library_id, template_id) with ``template`` and ``state``: by the link table first, else by their own ids.

    ``links``: (via, library_id, template_id); ``templates``: (library_id, template_id, name).
    """
    side = links.select("via", F.col("library_id").alias("__l"), F.col("template_id").alias("__t"))
    found = vias.join(side, "via", "left").withColumn("library_id", F.coalesce("__l", "library_id")).withColumn("template_id", F.coalesce("__t", "template_id")).drop("__l", "__t")
    named = found.join(templates.select("library_id", "template_id", F.col("name").alias("template")), ["library_id", "template_id"], "left")
    return named.withColumn("state", F.when(F.col("template_id").isNull(), "none").when(F.col("template").isNull(), "unresolved").otherwise("resolved"))


def zipped(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The n-th row of one side with the n-th of the other, within the keys."""
    nth = lambda df, order: df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return nth(left, left_order).join(nth(right, right_order), [*keys, "__n"]).drop("__n")


def by_name(rows: DataFrame, name: str, wanted: str, order: str) -> DataFrame:
    """The first row of that name in any case."""
    return rows.where(F.lower(name) == wanted.lower()).orderBy(order).limit(1)


def best_file(references: DataFrame, files: DataFrame) -> DataFrame:
    """``references`` (ref, path) with ``file``: a file of that very path, else of its base name, else of the base name in any case; earlier roots first.

    ``files``: (file, root_ord).
    """
    base = lambda c: F.regexp_extract(F.replace(F.col(c), F.lit("\\"), F.lit("/")), "([^/]*)$", 1)
    hits = references.withColumn("__k", F.lower(base("path"))).join(files.withColumn("__k", F.lower(base("file"))), "__k")
    rank = F.when(F.col("file") == F.col("path"), 0).when(base("file") == base("path"), 1).otherwise(2)
    best = hits.groupBy("ref").agg(F.min_by("file", F.struct("root_ord", rank.alias("r"), "file")).alias("file"))
    return references.join(best, "ref", "left")


def net_numbers(prims: DataFrame, nets: DataFrame) -> DataFrame:
    """``prims`` (doc_id, net) with ``net_index`` from 1, that of the last net of the name; 0 where there is none."""
    last = nets.groupBy("doc_id", F.col("name").alias("net")).agg((F.max("ord") + 1).alias("net_index"))
    return prims.drop("net_index").join(last, ["doc_id", "net"], "left").withColumn("net_index", F.coalesce("net_index", F.lit(0)))


def retargeted(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """``records`` (doc_id, ord, owner) renumbered from 0 in ``order``, owners following; an owner that is gone becomes null."""
    new = records.withColumn("__new", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) - 1)
    places = new.select("doc_id", F.col("ord").alias("owner"), F.col("__new").alias("__owner"))
    joined = new.join(places, ["doc_id", "owner"], "left")
    return joined.withColumn("ord", F.col("__new")).withColumn("owner", F.col("__owner")).drop("__new", "__owner")


def by_slot(prims: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """``prims`` (path, storage, kind, ord) with ``value`` from a side table (path, storage, record_index, value): the index counts all records of the storage in order."""
    slot = F.row_number().over(W.partitionBy("path", "storage").orderBy("ord")) - 1
    return prims.withColumn("record_index", slot).join(side.select("path", "storage", "record_index", value), ["path", "storage", "record_index"], "left")


def first_rows(rows: DataFrame, order: Sequence[str], n: int | None = 10) -> DataFrame:
    """The first ``n`` rows of a listing, or all."""
    return rows.orderBy(*order) if n is None else rows.orderBy(*order).limit(n)


def named_or_first(rows: DataFrame, name: str, order: str, wanted: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Of each key, the first row of the wanted name in any case, or the first of all where none is wanted."""
    some = rows if wanted is None else rows.where(F.lower(name) == wanted.lower())
    return first_by(some, keys, [order]) if keys else some.orderBy(order).limit(1)


def region_pads(regions: DataFrame, pads: DataFrame) -> DataFrame:
    """``regions`` (path, ord, params) with ``pad``, the place of the pad that PADINDEX (from 1) names, taken out of ``params``.

    An index that is no number or names no pad stays where it is. ``pads``: (path, ord), numbered from 0.
    """
    named = F.get(F.filter("params", lambda p: F.upper(p["name"]) == "PADINDEX"), F.lit(0))
    found = regions.withColumn("__pad", F.trim(named["value"]).try_cast("int") - 1)
    found = found.join(pads.select("path", F.col("ord").alias("__pad"), F.col("ord").alias("pad")), ["path", "__pad"], "left")
    rest = F.filter("params", lambda p: p["name"] != named["name"])
    return found.withColumn("params", F.when(F.col("pad").isNotNull(), rest).otherwise(F.col("params"))).drop("__pad")
