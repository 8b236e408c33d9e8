"""Embedded 3-D models: metadata beside payloads, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import weighted_checksum
from ..functions.compression import inflated
from . import lint


def joined(metadata: DataFrame, payloads: DataFrame) -> DataFrame:
    """``metadata`` (doc_id, ord, id, name, checksum) with ``data``, the inflated payload of the same place
    (doc_id, ord, payload), and its ``text``: UTF-8 where it is that, else byte by byte."""
    data = F.col("data")
    side = payloads.select("doc_id", "ord", "payload", inflated("payload").alias("data"))
    side = side.withColumn("text", F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.decode(data, "ISO-8859-1")))
    return metadata.join(side, ["doc_id", "ord"], "left")


def checks(models: DataFrame, bodies: DataFrame) -> DataFrame:
    """Models without payload, whose payload does not inflate, or whose checksum differs; bodies (doc_id, model_id, name) of no model."""
    missing = models.where("payload is null")
    broken = models.where("payload is not null and data is null")
    wrong = models.where(F.col("data").isNotNull() & (weighted_checksum(F.col("data")) != F.col("checksum")))
    known = models.select("doc_id", F.upper("id").alias("model_id"))
    loose = bodies.where("model_id <> ''").withColumn("model_id", F.upper("model_id")).join(known, ["doc_id", "model_id"], "left_anti")
    return lint.report([
        lint.found(missing, "model", "name", "no payload"), lint.found(broken, "model", "name", "does not inflate"),
        lint.found(wrong, "model", "name", "checksum differs"), lint.found(loose, "body", "model_id", "model does not exist"),
    ])
