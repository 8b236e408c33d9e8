"""Typed columns from parameter records, by one table of keys for each kind of record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import params, units

#: How a key's text is read; what is missing or unreadable gives the default.
READERS = {
    "text": (lambda t: t, None), "int": (params.as_int, 0), "double": (params.as_double, 0.0), "flag": (params.as_explicit_bool, False), "bool": (params.as_bool, False),
    "length": (lambda t: F.coalesce(units.parse_length(t), params.as_int(t)), 0),
}

#: Keys of board records, as {column: (key, how to read it)}.
RECORDS: dict[str, dict[str, tuple[str, str]]] = {
    "net": {"name": ("NAME", "text")},
    "class": {"name": ("NAME", "text"), "super_class": ("SUPERCLASS", "text"), "sub_class": ("SUBCLASS", "text"), "kind": ("KIND", "text"), "unique_id": ("UNIQUEID", "text"), "enabled": ("ENABLED", "flag")},
    "rule": {"name": ("NAME", "text"), "kind": ("RULEKIND", "text"), "priority": ("PRIORITY", "int"), "enabled": ("ENABLED", "flag"), "scope1": ("SCOPE1EXPRESSION", "text"), "scope2": ("SCOPE2EXPRESSION", "text")},
    "component": {
        "name": ("PATTERN", "text"), "pattern": ("PATTERN", "text"), "comment": ("COMMENT", "text"), "description": ("DESCRIPTION", "text"), "x": ("X", "length"), "y": ("Y", "length"), "height": ("HEIGHT", "length"),
        "rotation": ("ROTATION", "double"), "layer_name": ("LAYER", "text"), "component_kind": ("COMPONENTKIND", "int"), "kind_v2": ("COMPONENTKINDVERSION2", "int"), "source_designator": ("SOURCEDESIGNATOR", "text"),
        "source_lib_reference": ("SOURCELIBREFERENCE", "text"), "source_description": ("SOURCEDESCRIPTION", "text"), "unique_id": ("UNIQUEID", "text"), "locked_strings": ("LOCKSTRINGS", "flag"),
    },
    "differential_pair": {"name": ("NAME", "text"), "positive_net": ("POSITIVENETNAME", "text"), "negative_net": ("NEGATIVENETNAME", "text"), "unique_id": ("UNIQUEID", "text")},
    "embedded_board": {
        "document_path": ("DOCUMENTPATH", "text"), "x": ("X", "length"), "y": ("Y", "length"), "rotation": ("ROTATION", "double"), "mirror": ("MIRRORFLAG", "flag"), "cols": ("COLCOUNT", "int"), "rows": ("ROWCOUNT", "int"),
        "dx": ("COLSPACING", "length"), "dy": ("ROWSPACING", "length"),
    },
}


def column(record: Column, key: str, how: str) -> Column:
    read, default = READERS[how]
    value = read(params.lookup(record, key))
    return value if default is None else F.coalesce(value, F.lit(default))


def typed(rows: DataFrame, kind: str, record: str = "params") -> DataFrame:
    """``rows`` with the kind's columns in place of ``record``, and ``extra``: the pairs that no column took."""
    spec = RECORDS[kind]
    taken = [k for k, _ in spec.values()]
    p = F.col(record)
    found = rows.select(*(c for c in rows.columns if c != record), *(column(p, k, how).alias(n) for n, (k, how) in spec.items()), F.filter(p, lambda e: ~F.upper(e["name"]).isin(*taken)).alias("extra"))
    if kind == "component":  # the newer key counts where it is there
        newer = F.coalesce(params.as_int(params.first(p, "COMPONENTKINDVERSION2")), params.as_int(params.first(p, "COMPONENTKIND")), F.lit(0))
        found = rows.withColumn("component_kind", newer).select("*", *(column(p, k, how).alias(n) for n, (k, how) in spec.items() if n not in ("component_kind", "kind_v2")), F.filter(p, lambda e: ~F.upper(e["name"]).isin(*taken)).alias("extra")).drop(record)
    return found


def record_text(pairs: Column) -> Column:
    """array<struct<name,value,is_utf8>> back as ``|NAME=VALUE|...``."""
    return F.array_join(F.transform(pairs, lambda e: F.concat(F.lit("|"), F.when(e["is_utf8"], params.UTF8_MARK).otherwise(""), e["name"], F.lit("="), e["value"])), "")
