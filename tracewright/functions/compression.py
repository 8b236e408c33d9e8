"""Deflated bytes: Spark has no function for them, so they pass through Python in Arrow batches."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _inflate(data: bytes | None) -> bytes | None:
    try:
        return None if data is None else zlib.decompress(data)
    except zlib.error:
        return None


def _inflate_all(data: pd.Series) -> pd.Series:
    return data.map(_inflate)


def _deflate_all(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else zlib.compress(d))


def inflated(data: Column | str) -> Column:
    """The inflated bytes; null where the data is null or broken."""
    return F.pandas_udf(_inflate_all, "binary")(data)


def deflated(data: Column | str) -> Column:
    return F.pandas_udf(_deflate_all, "binary")(data)
