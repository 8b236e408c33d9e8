"""Quoting and naming rules; the variants look alike and differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import let


def _doubled(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def quote_placement(text: Column) -> Column:
    """Quoted if it has a comma, a quote or a line feed."""
    return F.when(text.rlike('[,"\n]'), _doubled(text)).otherwise(text)


def quote_bom(text: Column, separator: str = ",") -> Column:
    """Quoted if it has the separator, a quote, a line feed or a carriage return."""
    hit = text.contains(separator) | text.rlike('["\n\r]')
    return F.when(hit, _doubled(text)).otherwise(text)


def plain_tsv(text: Column) -> Column:
    """Tabs and line breaks become spaces."""
    return F.translate(text, "\t\n\r", "   ")


def quote_sexpr(text: Column) -> Column:
    """In quotes, with backslashes, if it is empty or has white space, a parenthesis, a quote or a backslash."""
    inner = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when((text == "") | text.rlike(r'[\s()"\\]'), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(text)


def natural_key(text: Column) -> tuple[Column, Column]:
    """(upper-case prefix, trailing ASCII digits as a number up to 2**64 - 1, else 0)."""
    digits = F.regexp_extract(text, "([0-9]*)$", 1)
    number = F.coalesce(digits.try_cast("decimal(38,0)"), F.lit(0))
    return F.upper(F.regexp_extract(text, "^(.*?)[0-9]*$", 1)), F.when(number > F.lit("18446744073709551615").cast("decimal(38,0)"), F.lit(0)).otherwise(number)


def safe_path(path: Column) -> Column:
    """A relative path that stays below its root: backslashes become slashes, ``..`` becomes UNSAFE, empty parts and ``.`` go."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(F.transform(parts, lambda p: F.when(p == "..", "UNSAFE").otherwise(p)), "/")


def overline_runs(text: Column) -> Column:
    """array<struct<text,overline>>: a character before a backslash is overlined; neighbours of one kind are one run."""
    marked = F.regexp_extract_all(text, F.lit(r"([^\\]\\?)"), F.lit(1))
    none = F.array().cast("array<struct<text:string,overline:boolean>>")

    def add(runs: Column, piece: Column) -> Column:
        char, over = F.substring(piece, 1, 1), F.length(piece) == 2
        last = F.get(runs, F.size(runs) - 1)
        longer = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(F.concat(last["text"], char).alias("text"), over.alias("overline"))))
        return F.when((F.size(runs) > 0) & (last["overline"] == over), longer).otherwise(F.concat(runs, F.array(F.struct(char.alias("text"), over.alias("overline")))))

    return F.aggregate(marked, none, add)


def wrapped(text: Column, size: Column, width: Column) -> Column:
    """Lines of words, filled greedily: a character takes 0.6 of the size. Empty paragraphs stay as empty lines."""

    def fill(paragraph: Column) -> Column:
        words = F.filter(F.split(paragraph, r"\s+"), lambda w: w != "")
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

        def add(acc: Column, word: Column) -> Column:
            full = ((F.length(acc["line"]) + 1 + F.length(word)) * size * 0.6 > width) & (acc["line"] != "")
            line = F.when(full | (acc["line"] == ""), word).otherwise(F.concat(acc["line"], F.lit(" "), word))
            return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["line"]))).otherwise(acc["done"]).alias("done"), line.alias("line"))

        end = lambda acc: F.when(acc["line"] != "", F.concat(acc["done"], F.array(acc["line"]))).otherwise(acc["done"])
        return F.when(paragraph == "", F.array(F.lit(""))).otherwise(F.aggregate(words, start, add, end))

    return F.flatten(F.transform(F.split(text, "[\r\n]"), fill))


def section_key(name: Column) -> Column:
    """A schematic library's storage name: ten characters become ``_``, then at most 31 characters."""
    return F.substring(F.regexp_replace(name, r'[/\\:!*?"<>|]', "_"), 1, 31)


def footprint_key(name: Column) -> Column:
    """A footprint library's storage name: at most 31 bytes (of ASCII names), slashes become ``_``."""
    return F.replace(F.substring(name, 1, 31), F.lit("/"), F.lit("_"))


def guid_text(data: Column) -> Column:
    """``{8-4-4-4-12}`` from 16 bytes, of which the first three groups are little-endian."""
    h = lambda d, *places: F.concat(*(F.substring(d, 2 * i + 1, 2) for i in places))
    groups = lambda d: [h(d, 3, 2, 1, 0), h(d, 5, 4), h(d, 7, 6), h(d, 8, 9), h(d, 10, 11, 12, 13, 14, 15)]
    return let(F.hex(data), lambda d: F.when(F.length(d) == 32, F.concat(F.lit("{"), F.concat_ws("-", *groups(d)), F.lit("}"))))


def guid_bytes(text: Column) -> Column:
    """The 16 bytes of a GUID's text, with or without braces; null if it is none."""
    order = [3, 2, 1, 0, 5, 4, 7, 6, *range(8, 16)]
    joined = lambda h: F.unhex(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in order)))
    return let(F.upper(F.regexp_replace(F.trim(text), r"[{}-]", "")), lambda h: F.when(h.rlike("^[0-9A-F]{32}$"), joined(h)))


def exponent_text(value: Column) -> Column:
    """``5.384400E-011``: six decimals, a sign and three digits of exponent."""
    shown = F.format_string("%.6E", value.cast("double"))
    return F.concat(F.regexp_extract(shown, "^(.*E[+-])", 1), F.lpad(F.regexp_extract(shown, "([0-9]+)$", 1), 3, "0"))


def indirect(text: Column, parameters: Column) -> Column:
    """``=Name`` becomes the first parameter of that name in any case, or the bare name."""
    name = F.substring(text, F.lit(2), F.length(text))
    found = F.get(F.filter(parameters, lambda p: F.lower(p["name"]) == F.lower(name)), F.lit(0))["value"]
    return F.when(text.startswith("="), F.coalesce(found, name)).otherwise(text)


def quote_xml(text: Column) -> Column:
    """With the five characters that markup reserves written as entities."""
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = F.replace(text, F.lit(char), F.lit(f"&{name};"))
    return text


def code_points(encoded: Column) -> Column:
    """``72,105`` as ``Hi``: decimal code points between commas; what is no number, or no character, is left out."""
    number = lambda p: p.try_cast("int")
    fine = F.filter(F.split(encoded, ","), lambda p: p.rlike("^[0-9]+$") & (number(p) < 0x110000) & ~number(p).between(0xD800, 0xDFFF))
    char = lambda p: F.decode(F.unhex(F.lpad(F.hex(number(p)), 8, "0")), "UTF-32")
    return F.array_join(F.transform(fine, char), "")


def us_stamp(time: Column) -> tuple[Column, Column]:
    """Date as ``3/9/2024`` and time as ``1:05:09 PM``."""
    return F.date_format(time, "M/d/yyyy"), F.date_format(time, "h:mm:ss a")


def day_first_stamp(time: Column) -> tuple[Column, Column]:
    """Date as ``09/03/2024`` and time as ``13:05:09``."""
    return F.date_format(time, "dd/MM/yyyy"), F.date_format(time, "HH:mm:ss")


def config_entries(value: Column, prefix: str) -> Column:
    """array<struct<key,value>> of the entries ``KEY=VALUE`` between backquotes whose key begins with ``prefix``; the last of a key counts, keys in order."""
    parts = F.filter(F.split(value, "`"), lambda p: p.contains("=") & p.startswith(prefix))
    entry = lambda p: F.struct(F.substring(p, F.lit(1), F.instr(p, "=") - 1).alias("key"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("value"))
    entries = F.filter(F.transform(parts, entry), lambda e: e["key"].startswith(prefix))
    later = lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])
    return F.array_sort(F.filter(entries, later))


def layers_shown(toggles: Column) -> Column:
    """array<struct<layer,shown>> of the pairs ``<id>=<0 or 1>`` between commas and underlines; the last of a layer counts."""
    found = F.regexp_extract_all(F.concat(F.lit(","), F.replace(toggles, F.lit("_"), F.lit(",,")), F.lit(",")), F.lit(r",\s*([+-]?[0-9]+\s*=[01])(?=,)"), F.lit(1))
    pair = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).try_cast("bigint").alias("layer"), p.endswith("=1").alias("shown"))
    pairs = F.transform(found, pair)
    later = lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["layer"] == e["layer"])
    return F.array_sort(F.filter(pairs, later))
