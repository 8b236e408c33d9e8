"""Flags, packed colours, weighted checksums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def has_bit(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def colour_parts(packed: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a colour whose lowest byte is red."""
    byte = lambda k: F.shiftright(packed, 8 * k).bitwiseAND(F.lit(255)).cast("int")
    return byte(0), byte(1), byte(2)


def colour_text(packed: Column) -> Column:
    """``#rrggbb``, small letters."""
    return F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(x.cast("bigint")), 2, "0") for x in colour_parts(packed))))


def weighted_checksum(data: Column) -> Column:
    """Sum of byte times weight (1 for the first, its place for the others) modulo 2**32, as a signed INT."""
    hexed = F.hex(data)
    places = F.sequence(F.lit(0), F.octet_length(data) - 1)
    byte = lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")
    total = F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, i: (acc + byte(i) * F.greatest(i, F.lit(1))).bitwiseAND(F.lit(0xFFFFFFFF)))
    unsigned = F.when(F.octet_length(data) > 0, total).otherwise(F.lit(0).cast("bigint"))
    return F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned).cast("int")


def differing(a: Column, b: Column) -> Column:
    """The offsets at which two byte strings differ, as far as both go."""
    byte = lambda c, i: F.substring(c, i + 1, F.lit(1))
    n = F.least(F.octet_length(a), F.octet_length(b))
    return F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: byte(a, i) != byte(b, i))


def first_difference(a: Column, b: Column) -> Column:
    """The first such offset, or the length of the shorter."""
    return F.coalesce(F.get(differing(a, b), F.lit(0)), F.least(F.octet_length(a), F.octet_length(b)))
