"""Compound container files: each file's streams as rows, and the records that streams are made of.

The files are read by Spark's binaryFile source; a small parser walks the sector chains of one file inside its task.
Malformed files give a row with an error, not a failed job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF
KINDS = ("pcbdoc", "pcblib", "schdoc", "schlib", "intlib", "libpkg", "bomdoc")


def entries(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(storage path, name, content) of each stream; raises ValueError where the file is broken."""
    if data[:8] != MAGIC or len(data) < 512:
        raise ValueError("not a compound file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    n_fat, first_dir, _, cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
    if not 7 <= shift <= 16 or mini_shift >= shift:
        raise ValueError("bad sector size")
    size, mini_size = 1 << shift, 1 << mini_shift
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    numbers = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
    difat = list(struct.unpack_from("<109I", data, 76))
    for _ in range(n_difat):
        part = numbers(sector(first_difat))
        difat += part[:-1]
        first_difat = part[-1] if part else END
    fat = [x for s in difat[:n_fat] if s < END for x in numbers(sector(s))]

    def chain(start: int, table: list[int], read, what: str) -> bytes:
        out, seen = [], set()
        while start < len(table):
            if start in seen:
                raise ValueError(f"loop in {what}")
            seen.add(start)
            out.append(read(start))
            start = table[start]
        if start not in (END, FREE):
            raise ValueError(f"{what} leads out of the file")
        return b"".join(out)

    directory = chain(first_dir, fat, sector, "the directory")
    nodes = []
    for at in range(0, len(directory) - 127, 128):
        raw = directory[at : at + 128]
        n, kind = struct.unpack_from("<HB", raw, 64)
        left, right, child = struct.unpack_from("<III", raw, 68)
        start, length = struct.unpack_from("<IQ", raw, 116)
        nodes.append((raw[: max(0, n - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, length & 0xFFFFFFFF if shift == 9 else length))
    if not nodes:
        raise ValueError("empty directory")
    mini_fat = numbers(chain(first_mini, fat, sector, "the short table")) if first_mini < END else []
    mini = chain(nodes[0][5], fat, sector, "the short stream") if nodes[0][5] < END else b""
    short = lambda i: mini[i * mini_size : (i + 1) * mini_size]
    todo, seen = [("", nodes[0][4])], set()
    while todo:
        path, i = todo.pop()
        if i >= len(nodes):
            continue
        if i in seen:
            raise ValueError("loop in the directory")
        seen.add(i)
        name, kind, left, right, child, start, length = nodes[i]
        todo += [(path, left), (path, right)]
        if kind == 1:
            todo.append((f"{path}/{name}".lstrip("/"), child))
        elif kind == 2:
            body = b"" if not length else chain(start, mini_fat, short, name) if length < cutoff else chain(start, fat, sector, name)
            yield path, name, body[:length]


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, content): kind by the file's extension in any case, null if it is none of ``KINDS``."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return spark.read.format("binaryFile").load(path).select("path", F.when(extension.isin(*KINDS), extension).alias("kind"), "content")


def streams(found: DataFrame) -> DataFrame:
    """(path, storage, name, size, data, error) for ``found`` (path, content)."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows, error = [], None
                try:
                    rows = [(path, s, n, len(d), d, None) for s, n, d in entries(content)]
                except (ValueError, struct.error) as e:
                    error = str(e)
                if error:
                    rows.append((path, None, None, None, None, error))
                for row in rows:
                    yield pd.DataFrame([row], columns=["path", "storage", "name", "size", "data", "error"]).astype({"size": "Int64"})

    return found.select("path", "content").mapInPandas(walk, "path string, storage string, name string, size long, data binary, error string")


def blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(flags, payload) of length-prefixed blocks: the length's high byte holds flags; stops where the data ends early."""
    at = 0
    while at + 4 <= len(data):
        (head,) = struct.unpack_from("<I", data, at)
        size = head & 0xFFFFFF
        if at + 4 + size > len(data):
            return
        yield head >> 24, data[at + 4 : at + 4 + size]
        at += 4 + size


def block_rows(rows: DataFrame) -> DataFrame:
    """(path, storage, name, ord, flags, payload) of the blocks in each stream."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                got = list(blocks(r.data))
                if got:
                    yield pd.DataFrame({"path": r.path, "storage": r.storage, "name": r.name, "ord": range(len(got)), "flags": [f for f, _ in got], "payload": [p for _, p in got]})

    return rows.where("data is not null").select("path", "storage", F.col("name"), "data").mapInPandas(cut, "path string, storage string, name string, ord int, flags int, payload binary")
