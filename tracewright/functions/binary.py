"""Little-endian numbers in BINARY columns, as SQL expressions; null where the data is too short."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import let


def unsigned(data: Column, offset: int | Column, size: int) -> Column:
    """Up to seven bytes as BIGINT."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    if size == 1:  # no order of bytes to turn round
        return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("bigint")
    digits = F.when(F.octet_length(data) >= at + size, F.hex(F.substring(data, at + 1, F.lit(size))))
    return F.conv(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size)))), 16, 10).cast("bigint")


def signed(data: Column, offset: int | Column, size: int) -> Column:
    raw = unsigned(data, offset, size)
    return F.when(raw >= 1 << (8 * size - 1), raw - (1 << 8 * size)).otherwise(raw)


def int32(data: Column, offset: int | Column) -> Column:
    return signed(data, offset, 4).cast("int")


def double(data: Column, offset: int) -> Column:
    """An IEEE double, from its bits: exact, as its parts are scaled by powers of two."""

    def value(w: Column) -> Column:
        low, high = w["low"], w["high"]
        sign = F.when(high >= 1 << 31, F.lit(-1.0)).otherwise(1.0)
        exponent = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF))
        part = (high.bitwiseAND(F.lit(0xFFFFF)).cast("double") * float(1 << 32) + low.cast("double")) * 2.0**-52
        normal = (part + 1.0) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
        return F.when(exponent == 0, sign * part * 2.0**-1022).when((exponent == 0x7FF) & (part == 0), sign * float("inf")).when(exponent == 0x7FF, F.lit(float("nan"))).otherwise(sign * normal)

    return let(F.struct(unsigned(data, offset, 4).alias("low"), unsigned(data, offset + 4, 4).alias("high")), lambda w: F.when(w["high"].isNotNull(), value(w)))


def pascal(data: Column, offset: int = 0) -> Column:
    """A string after its one-byte length."""
    return F.substring(data, F.lit(offset + 2), unsigned(data, offset, 1).cast("int"))
