"""Path-style access to nested documents held as VARIANT: fields, elements and conditions are column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The document, or null if the text is none."""
    return F.try_parse_json(text)


def at(document: Column, path: str, kind: str = "string") -> Column:
    """The value at a path such as ``$.nets[0].name``; null where it is missing or of another kind."""
    return F.try_variant_get(document, path, kind)


def each(rows: DataFrame, document: str, path: str = "$", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each element or field at the path: pos, key, value (VARIANT), beside the ``keep`` columns."""
    inner = rows.select(*keep, F.try_variant_get(F.col(document), path, "variant").alias("__v"))
    return inner.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("__v").outer())).drop("__v")


def length(document: Column, path: str = "$") -> Column:
    """Elements of an array, fields of an object, characters of a string."""
    v = F.try_variant_get(document, path, "variant")
    text = F.to_json(v)
    kind = F.schema_of_variant(v)
    items = F.size(F.try_variant_get(document, path, "array<variant>"))
    fields = F.size(F.map_keys(F.try_variant_get(document, path, "map<string,variant>")))
    return F.when(text.startswith("["), items).when(text.startswith("{"), fields).when(kind == "STRING", F.length(F.try_variant_get(document, path, "string")))
