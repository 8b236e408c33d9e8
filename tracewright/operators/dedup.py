"""One copy of equal contents, and names for different contents of one name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written
from .ordering import global_rank


def file_name(name: Column) -> Column:
    """A name without path separators and colons."""
    return F.translate(name, "/\\:", "___")


def suffixed(files: DataFrame, name: str, content: str, order: str) -> DataFrame:
    """(name, first, copies, version, file): equal contents of a name once, in order of their first place; the second and
    later contents of a name get ``-2``, ``-3`` before the extension. Null and empty contents are dropped.

    A file's name goes to the content that came first, whether the name is its own or a generated one; another content
    takes its next number, until no two want one name. Contents meet by their SHA-256, so that the texts themselves are
    not shuffled, and the versions of a name are numbered by ranges, so that a common name fills no single task.
    """
    kept = files.where((F.col(content).isNotNull()) & (F.octet_length(content) > 0)).select(F.col(name).alias("name"), F.sha2(F.col(content).cast("binary"), 256).alias("sha"), F.col(order).alias("ord"))
    once = kept.groupBy("name", "sha").agg(F.min("ord").alias("first"), F.count("*").alias("copies"))
    ranked = global_rank(once, ["name", "first", "sha"], "__n")
    least = ranked.groupBy("name").agg(F.min("__n").alias("__least"))
    now = ranked.join(least, "name").withColumn("version", (F.col("__n") - F.col("__least") + 1).cast("int")).drop("__n", "__least")
    base, extension = F.regexp_extract("name", r"(?s)^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"(?s)^(.*?)(\.[^.]*)?$", 2)
    named = F.when(F.col("version") == 1, file_name(F.col("name"))).otherwise(file_name(F.concat(base, F.lit("-"), F.col("version").cast("string"), extension)))
    while True:
        now = written(now.withColumn("file", named), "files")
        holder = now.groupBy("file").agg(F.min_by("sha", F.struct("first", "name", "sha")).alias("__sha"), F.count_distinct("sha").alias("__n")).where("__n > 1").select("file", "__sha")
        if holder.isEmpty():
            return now.select("name", "sha", "first", "copies", "version", "file")
        now = now.join(holder, "file", "left").withColumn("version", F.col("version") + F.coalesce((F.col("sha") != F.col("__sha")).cast("int"), F.lit(0))).drop("__sha", "file")
