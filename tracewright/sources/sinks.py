"""Texts and files from tables: INI sections, BOM records, reports by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schema
from ..functions.text import safe_path


def _joined(rows: DataFrame, key: str, order: list[str], line: Column, end: str) -> DataFrame:
    """(key, text): the lines of each key in order, each with its end."""
    lists = F.array_sort(F.collect_list(F.struct(*order, line.alias("__line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(lists, lambda x: F.concat(x["__line"], F.lit(end))), "").alias("text"))


def ini_text(entries: DataFrame) -> DataFrame:
    """(path, text) from (path, section, section_ord, key, key_ord, value): sections in order, with a byte-order mark and CR LF."""
    heads = entries.select("path", "section", "section_ord").distinct().select("path", "section_ord", F.lit(-1).alias("key_ord"), F.concat(F.lit("["), "section", F.lit("]")).alias("line"))
    keys = entries.select("path", "section_ord", "key_ord", F.concat_ws("=", "key", "value").alias("line"))
    found = _joined(heads.unionByName(keys), "path", ["section_ord", "key_ord"], F.col("line"), "\r\n")
    return found.withColumn("text", F.concat(F.lit("﻿"), "text"))


def bom_text(records: DataFrame) -> DataFrame:
    """(path, text) from (path, record_no, params)."""
    return _joined(records, "path", ["record_no"], schema.record_text(F.col("params")), "\r\n")


def report_text(lines: DataFrame, key: str = "doc_id", end: str = "\r\n") -> DataFrame:
    """(key, text) from (key, ord, line): a report's lines for each document."""
    return _joined(lines, key, ["ord"], F.col("line"), end)


def write_texts(texts: DataFrame, folder: str, name: str, key: str = "doc_id") -> None:
    """One text file for each key, in a folder of that name, by Spark's own writer."""
    rows = texts.select(F.regexp_replace(safe_path(F.col(key).cast("string")), "/", "_").alias(name), F.col("text").alias("value"))
    rows.write.partitionBy(name).option("lineSep", "\n").mode("overwrite").text(folder)
