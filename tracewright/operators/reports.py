"""Placement, bill of materials, rules and counts as report rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import natural_key, quote_bom, quote_placement
from ..functions.units import RAW_PER_MIL, fixed, rule_value_in_mm, to_mm

#: Component kinds that are placed, and the one that is placed on request.
PLACED, ON_REQUEST = (0,), (5,)
#: The bottom layer's number, and what the three dialects call the two sides (bottom, then top).
BOTTOM, SIDES = 32, (("BottomLayer", "TopLayer"), ("Bottom", "Top"), ("bottom", "top"))
#: Header lines of the three dialects; the unit's name follows in the first.
HEADERS = ("Designator,Comment,Layer,Footprint,Center-X({0}),Center-Y({0}),Rotation,Description", "Designator,Val,Package,Mid X,Mid Y,Rotation,Layer", "Ref,Val,Package,PosX,PosY,Rot,Side")
#: Parameters of a rule that its report leaves out.
NOISE = ("SELECTION", "LAYER", "LOCKED", "POLYGONOUTLINE", "USERROUTED", "KEEPOUT", "UNIONINDEX", "RULEKIND", "NAME", "ENABLED", "PRIORITY", "COMMENT", "UNIQUEID", "SCOPE1EXPRESSION", "SCOPE2EXPRESSION", "DEFINEDBYLOGICALDOCUMENT")


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, n) for each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def placements(components: DataFrame, with_requested: bool = False, origin: tuple[int, int] | None = None) -> DataFrame:
    """Components to place, in natural order of their designators (``place`` from 1 within a document), relative to the origin.

    An empty comment becomes the source library's reference, an empty pattern the component's name, where there are
    columns ``source_lib_reference`` and ``name``.
    """
    kinds = PLACED + (ON_REQUEST if with_requested else ())
    ox, oy = origin or (0, 0)
    prefix, number = natural_key(F.col("designator"))
    rows = components.where(F.col("component_kind").isin(*kinds)).withColumn("px", F.col("x").cast("bigint") - ox).withColumn("py", F.col("y").cast("bigint") - oy)
    for c, other in (("comment", "source_lib_reference"), ("pattern", "name")):
        if other in rows.columns:
            rows = rows.withColumn(c, F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(other), F.lit("")))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(prefix, number, "ord")))


def side(layer: Column, k: int) -> Column:
    """What the ``k``-th dialect calls the side of a layer: all but the bottom layer are the top."""
    return F.when(layer == BOTTOM, SIDES[k][0]).otherwise(SIDES[k][1])


def placement_line(dialect: int, unit: str = "mm") -> Column:
    """One CSV line in one of three dialects; lengths have four decimals in mm and two in mil."""
    length = lambda c: fixed(to_mm(F.col(c)), 4) if unit == "mm" else fixed(F.col(c) / RAW_PER_MIL, 2)
    whole = F.col("rotation") == F.floor("rotation")
    rotation = F.when(whole, fixed(F.col("rotation"), 0)).otherwise(fixed(F.col("rotation"), 2))
    d, c, f = (quote_placement(F.coalesce(F.col(x), F.lit(""))) for x in ("designator", "comment", "pattern"))
    text = quote_placement(F.coalesce(F.col("description"), F.lit("")))
    if dialect == 0:
        return F.concat_ws(",", d, c, side(F.col("layer"), 0), f, length("px"), length("py"), rotation, text)
    return F.concat_ws(",", d, c, f, length("px"), length("py"), rotation, side(F.col("layer"), dialect))


def placement_texts(placed: DataFrame, dialect: int, unit: str = "mm") -> DataFrame:
    """(doc_id, ord, line): the header line and the lines of ``placements``, in order."""
    head = placed.select("doc_id").distinct().select("doc_id", F.lit(0).alias("ord"), F.lit(HEADERS[dialect].format(unit)).alias("line"))
    return head.unionByName(placed.select("doc_id", F.col("place").alias("ord"), placement_line(dialect, unit).alias("line")))


def bom_lines(items: DataFrame, columns: list[str], separator: str = ",") -> DataFrame:
    """Items as quoted lines."""
    return items.select("ord", F.concat_ws(separator, *(quote_bom(F.coalesce(F.col(c).cast("string"), F.lit("")), separator) for c in columns)).alias("line"))


#: The columns of the report on catalogue items, and where they come from.
BOM_COLUMNS = {
    "DesignItemId": "design_item_id", "Comment": "__comment", "Description": "description", "Footprint": "footprint", "Manufacturer": "manufacturer", "Manufacturer Part Number": "manufacturer_part_number",
    "Supplier": "supplier", "Supplier Part Number": "supplier_part_number", "ItemSource": "item_source", "UniqueId": "unique_id",
}


def bom_report(items: DataFrame, separator: str = ",") -> DataFrame:
    """(path, ord, line): the header and a line for each item of ``sources.text.bom_items``; the user's comment stands where there is no other."""
    rows = items.withColumn("__comment", F.coalesce("comment", "user_comments")).withColumnRenamed("record_no", "ord")
    head = F.lit(separator.join(BOM_COLUMNS))
    cells = F.concat_ws(separator, *(quote_bom(F.coalesce(F.col(c), F.lit("")), separator) for c in BOM_COLUMNS.values()))
    return rows.select("path").distinct().select("path", F.lit(0).cast("bigint").alias("ord"), head.alias("line")).unionByName(rows.select("path", F.col("ord").cast("bigint").alias("ord"), cells.alias("line")))


def rules(rows: DataFrame) -> DataFrame:
    """Rules by kind, priority and name within a document, with a flag where a new kind begins."""
    w = W.partitionBy("doc_id").orderBy("kind", "priority", "name", "ord")
    return rows.withColumn("place", F.row_number().over(w)).withColumn("new_kind", ~F.col("kind").eqNullSafe(F.lag("kind").over(w)))


def rule_texts(rows: DataFrame, metric: bool = False) -> DataFrame:
    """(doc_id, ord, part, line): the report of ``rules``, with a last line that counts them.

    ``rows``: (doc_id, ord, kind, priority, name, enabled, scope1, scope2, comment, params array<struct<name,value>>).
    """
    some = F.filter("params", lambda p: (p["value"] != "") & ~F.upper(p["name"]).isin(*NOISE))
    shown = F.array_join(F.transform(some, lambda p: F.concat_ws("=", p["name"], rule_value_in_mm(p["name"], p["value"]) if metric else p["value"])), " | ")
    flag = F.when(F.col("enabled"), "").otherwise(" [disabled]")
    scope = F.when(F.col("scope2") == "", F.col("scope1")).otherwise(F.concat("scope1", F.lit("  vs  "), "scope2"))
    lines = F.array(
        F.when(F.col("new_kind"), F.concat(F.lit("["), "kind", F.lit("]"))),
        F.concat(F.lit("  "), "name", F.lit(" (priority "), F.col("priority").cast("string"), F.lit(")"), flag),
        F.when((F.col("scope1") != "") | (F.col("scope2") != ""), F.concat(F.lit("    scope: "), scope)),
        F.when(F.col("comment") != "", F.concat(F.lit("    comment: "), "comment")),
        F.when(shown != "", F.concat(F.lit("    "), shown)),
    )
    listed = rules(rows).select("doc_id", F.col("place").alias("ord"), F.posexplode(lines).alias("part", "line")).where("line is not null")
    ends = rows.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", (F.col("n") + 1).cast("int").alias("ord"), F.lit(0).alias("part"), F.concat(F.col("n").cast("string"), F.lit(" rule(s)")).alias("line"))
    return listed.unionByName(ends)


def as_documents(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(*keys, json): the rows of each key, in order, as one JSON array of objects, nulls included."""
    fields = [c for c in rows.columns if c not in keys]
    lists = F.transform(F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"__{c}") for c in order), F.struct(*fields).alias("__row")))), lambda x: x["__row"])
    return rows.groupBy(*keys).agg(F.to_json(lists, {"ignoreNullFields": "false"}).alias("json"))
