"""Parameter records ``|KEY=VALUE|...`` as ordered arrays of (name, value): keys may repeat, so they are no maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import let

UTF8_MARK = "%UTF8%"


def parse(record: Column) -> Column:
    """array<struct<name,value,is_utf8>> in order; pieces without '=' have an empty value, empty pieces are dropped."""
    pieces = F.filter(F.split(record, r"\|"), lambda p: p != "")

    def entry(p: Column) -> Column:
        at = F.instr(p, "=")
        name = F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)
        value = F.when(at > 0, F.substring(p, at + 1, F.length(p))).otherwise("")
        utf8 = F.startswith(F.upper(name), F.lit(UTF8_MARK))
        return F.struct(F.when(utf8, F.substring(name, F.lit(len(UTF8_MARK) + 1), F.length(name))).otherwise(name).alias("name"), value.alias("value"), utf8.alias("is_utf8"))

    return F.transform(pieces, entry)


def first(params: Column, key: str) -> Column:
    """The first value of the key, in any case; null if there is none."""
    return F.get(F.filter(params, lambda p: F.upper(p["name"]) == key.upper()), F.lit(0))["value"]


def last(params: Column, key: str) -> Column:
    """The last value of the key, in any case."""
    found = F.filter(params, lambda p: F.upper(p["name"]) == key.upper())
    return F.get(found, F.size(found) - 1)["value"]


def lookup(params: Column, key: str) -> Column:
    """The value of the key's UTF-8 twin if it has one, else of the key."""
    twin = F.filter(params, lambda p: (F.upper(p["name"]) == key.upper()) & p["is_utf8"])
    return F.coalesce(F.get(twin, F.lit(0))["value"], first(params, key))


def as_int(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def as_double(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def as_bool(text: Column) -> Column:
    """Schematic rule: absent or empty is false, one character is T in either case, else TRUE in any case."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == 1, F.upper(t) == "T").otherwise(F.upper(t) == "TRUE")


def as_explicit_bool(text: Column) -> Column:
    """Board rule: only TRUE, in any case, is true."""
    return F.upper(F.coalesce(text, F.lit(""))) == "TRUE"


def indexed(params: Column, prefix: str, start: int = 0) -> Column:
    """The values of PREFIX0, PREFIX1, ... up to the first that is missing."""
    numbers = F.transform(F.filter(params, lambda p: F.upper(p["name"]).rlike(f"^{prefix.upper()}[0-9]+$")), lambda p: F.struct(F.regexp_extract(p["name"], "([0-9]+)$", 1).cast("int").alias("i"), p["value"].alias("value")))

    def unbroken(ordered: Column) -> Column:
        return F.transform(F.filter(ordered, lambda e: F.size(F.filter(ordered, lambda x: (x["i"] >= start) & (x["i"] < e["i"]))) == e["i"] - start), lambda e: e["value"])

    return let(F.array_sort(numbers), unbroken)


def quoted_tokens(text: Column) -> Column:
    """Comma-separated tokens; a token may be in double quotes, in which a quote is doubled."""
    found = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    plain = lambda t: F.when(t.startswith('"') & (F.length(t) > 1), F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))).otherwise(t)
    return F.transform(found, plain)


def token_params(tokens: Column) -> Column:
    """Tokens ``name=value`` (split at the first '=') as array<struct<name,value>>."""

    def entry(t: Column) -> Column:
        at = F.instr(t, "=")
        return F.struct(F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t).alias("name"), F.when(at > 0, F.substring(t, at + 1, F.length(t))).otherwise("").alias("value"))

    return F.transform(tokens, entry)


def vertices(params: Column, declared: Column) -> Column:
    """array<struct<x,y>> from X1, Y1, ... up to ``declared``, then EX, EY as EXTRALOCATIONCOUNT says, up to the first that is missing.

    Coordinates are whole units of 100,000 raw plus their ``_FRAC``; what is missing or unreadable counts as 0.
    """
    entry = lambda p: lambda k: F.struct(k.alias("k"), F.get(F.filter(p, lambda x: F.upper(x["name"]) == k), F.lit(0))["value"].alias("v"))
    named = lambda p: F.map_from_entries(F.transform(F.array_distinct(F.transform(p, lambda x: F.upper(x["name"]))), entry(p)))
    return let(params, lambda p: let(named(p), lambda m: _vertices(m, declared)))


def _vertices(named: Column, declared: Column) -> Column:
    """``vertices`` from a map of the first values by upper-case name, which is worked out once."""
    text = lambda k: F.try_element_at(named, k)
    number = lambda k: F.coalesce(F.trim(text(k)).try_cast("int"), F.lit(0))
    key = lambda prefix, i, end="": F.concat(F.lit(prefix), i.cast("string"), F.lit(end))

    def point(px: str, py: str, i: Column) -> Column:
        raw = lambda p: (number(key(p, i)).cast("bigint") * 100_000 + number(key(p, i, "_FRAC"))).cast("int")
        return F.struct(raw(px).alias("x"), raw(py).alias("y"))

    count = F.greatest(declared, F.lit(0))
    extra = F.greatest(number(F.lit("EXTRALOCATIONCOUNT")), F.lit(0))
    present = lambda i: text(key("EX", i)).isNotNull() | text(key("EY", i)).isNotNull()
    places = lambda a, n: F.filter(F.sequence(a, a + n), lambda i: i < a + n)
    first = F.transform(places(F.lit(1), count), lambda i: point("X", "Y", i))
    tail = F.aggregate(places(count + 1, extra), F.array().cast("array<int>"), lambda acc, i: F.when((F.size(acc) == i - count - 1) & present(i), F.concat(acc, F.array(i))).otherwise(acc))
    return F.concat(first, F.transform(tail, lambda i: point("EX", "EY", i)))


def token_text(pairs: Column) -> Column:
    """array<struct<name,value>> as comma-separated tokens ``name=value``, in quotes if they have a comma, a quote or white space."""
    token = lambda p: F.concat(p["name"], F.lit("="), p["value"])
    quoted = lambda t: F.when(t.rlike(r'[,"\s]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)
    return F.array_join(F.transform(F.transform(pairs, token), quoted), ",")
