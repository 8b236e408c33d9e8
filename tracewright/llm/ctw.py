"""Language-model scores by context-tree weighting over bytes.

A text is its UTF-8 bytes with A-Z small, then an end mark (byte 255, which UTF-8 never uses); before the text stand end
marks too. Each byte is eight binary decisions. For each decision (the bits so far of the byte) there is a tree of
contexts of 0 to ``DEPTH`` preceding bytes, whose nodes hold how often each bit followed in training. A node's
Krichevsky-Trofimov probability and the product of its children's weighted ones are mixed half and half, bottom up.
After training the counts are fixed: a bit's probability mixes the nodes' estimates along its path by their posterior
weights (a context never seen counts one half, as its empty node would), and a byte's is the product over its bits. The
score is the sum of log10 over the text and its end; ``bits_per_byte`` is the code length.

The base score is that of a unigram model over words, counted on the same training rows.

Texts are counted chunk by chunk where they are read. Counts meet by key in shuffles; the tree is cut at the two nearest
context bytes into at most 65,536 subtrees, each a group whose size depends on the alphabet and the depth and not on the
number of texts; the two top levels are at most 257 nodes. Each chunk gets the values of its own distinct words and byte
runs back by a join, so no table of all words is held anywhere. Words are told apart by 64-bit hashes: among n different
ones, two are expected to be mistaken for each other about n * n / 2**65 times.

Defined results: a null text counts as empty, and an empty text is its end alone; repeated rows are counted and scored
each; without training rows every bit has probability one half; an empty table gives none; columns other than those named
are not read. Chunks are told by values of the rows (in the query, by file and place in the file), so that tasks that run
again on other executors count and score the same ones.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, slices, small_batches, table, written
from .minhash import mixed

DEPTH, END = 5, 255
#: Characters that one chunk holds about.
CHUNK_CHARS = 24 << 20
#: Characters that a task works on at a time, and keys with counts that it holds before it adds up equal ones.
SLICE_CHARS, HELD_KEYS = 1 << 18, 500_000
U = np.uint64
LOG_HALF = math.log(0.5)
END_KEY = np.array([-1], dtype=np.int64)  # the end token's; a word's hash is even


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The small-cased bytes of all texts, each with its end mark after it, and where each text starts."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    flat = np.frombuffer(b"\xff".join([*raw, b""]), dtype=np.uint8)
    flat = flat + np.uint8(32) * ((flat >= 65) & (flat <= 90)).astype(np.uint8)
    size = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    return flat, np.cumsum(size) - size


def runs(flat: np.ndarray, start: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each byte: itself in the lowest place, above it its ``depth`` preceding ones, nearest lowest."""
    key = flat.astype(np.int64)
    for d in range(1, depth + 1):
        before = np.full(len(flat), END, dtype=np.int64)
        before[d:] = flat[:-d]
        for k in range(1, d):  # what precedes the text's start is end marks
            at = start + k
            at = at[at < len(flat)]
            before[at[np.searchsorted(start, at, side="right") - 1 == np.arange(len(at))]] = END
        before[start] = END
        key |= before << (8 * d)
    return key


def words(flat: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text's place) of each word."""
    space = (flat == 32) | ((flat >= 9) & (flat <= 13)) | (flat == END)
    inside = ~space
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, length = edge[::2], edge[1::2] - edge[::2]
    if not len(first):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(inside)
    offset = np.cumsum(length) - length
    place = np.arange(len(at)) - np.repeat(offset, length)
    term = mixed(flat[at].astype(U) * U(0x9E3779B97F4A7C15) + place.astype(U) * U(0xD1B54A32D192ED03))
    h = mixed(np.add.reduceat(term, offset) + length.astype(U)) << U(1)
    return h.view(np.int64), np.searchsorted(start, first, side="right") - 1


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, of = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(of, np.concatenate(counts), minlength=len(key)).astype(np.int64)


class Lookup:
    """Values by 64-bit key: a table by the key's hash, and a search for the few keys that lost their place in it."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]
        self.shift = U(64 - min(22, max(4, (4 * len(key)).bit_length())))
        self.place = np.full(1 << int(U(64) - self.shift), -1, dtype=np.int32)
        self.place[self.slot(self.key)] = np.arange(len(key), dtype=np.int32)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(U) * U(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = self.place[self.slot(key)]
        lost = np.flatnonzero(self.key[at] != key)
        if len(lost):
            found = np.minimum(np.searchsorted(self.key, key[lost]), len(self.key) - 1)
            if not (self.key[found] == key[lost]).all():
                raise ValueError("a text has words or bytes that were not counted: docs changed while they were scored")
            at[lost] = found
        return self.value[at]


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return gammaln(zeros + 0.5) + gammaln(ones + 0.5) - math.log(math.pi) - gammaln(zeros + ones + 1.0)


def gammaln(x: np.ndarray) -> np.ndarray:
    """For x of at least one half: moved up by eight, then Stirling's series."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - np.log(shift)


class Level:
    """The nodes of one depth: ``key`` = context << 8 | bits so far, with their counts and weights."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, below: Level | None, mask: int):
        key, zeros, ones = [], [], []
        for k in range(8):
            bit = (symbol >> (7 - k)) & 1
            key.append(context << 8 | (1 << k) | (symbol >> (8 - k)))
            ones.append(n * bit)
            zeros.append(n * (1 - bit))
        self.key, of = np.unique(np.concatenate(key), return_inverse=True)
        self.zeros, self.ones = (np.bincount(of, np.concatenate(x), minlength=len(self.key)) for x in (zeros, ones))
        own = log_kt(self.zeros, self.ones)
        if below is None:
            self.lw, self.stay = own, np.ones(len(own))
        else:
            parent = np.searchsorted(self.key, (below.key >> 8 & mask) << 8 | below.key & 255)
            split = np.bincount(parent, below.lw, minlength=len(self.key))
            self.lw, self.stay = weighted(own, split)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        return at, (self.key[at] == key if len(self.key) else np.zeros(len(key), dtype=bool))


def weighted(own: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mixture's logarithm, and the posterior weight of ``own`` in it."""
    return np.logaddexp(LOG_HALF + own, LOG_HALF + split), 1 / (1 + np.exp(np.clip(split - own, -700, 700)))


def levels(key: np.ndarray, n: np.ndarray, depth: int) -> list[Level]:
    """Depths 2 to ``depth`` of one subtree, from the counts of its byte runs."""
    out: list[Level] = []
    for d in range(depth, 1, -1):
        mask = (1 << 8 * d) - 1
        out.insert(0, Level(key >> 8 & mask, key & 255, n, out[0] if out else None, mask))
    return out


class Top:
    """The root and the nodes of one context byte, dense over the 256 places of bits so far."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, split: np.ndarray):
        own = log_kt(zeros, ones)
        lw, stay = weighted(own, split)
        unseen = zeros + ones == 0  # the weights of empty nodes are log 1
        z, o = zeros.sum(0), ones.sum(0)
        _, stay0 = weighted(log_kt(z, o), lw.sum(0))
        part = np.where(z + o > 0, stay0 * (o + 0.5) / (z + o + 1), 0.5)
        left = np.where(z + o > 0, 1 - stay0, 0)
        #: A bit one has probability given + left * (what the deeper nodes say), by context byte and bits so far.
        self.given = part[None] + left[None] * np.where(unseen, 0.5, stay * (ones + 0.5) / (zeros + ones + 1))
        self.left = left[None] * np.where(unseen, 0, 1 - stay)


def log10_of(key: np.ndarray, tree: list[Level], top: Top) -> np.ndarray:
    """log10 of the probability of each run's lowest byte after the bytes above it."""
    context, symbol = key >> 8, key & 255
    total = np.zeros(len(key))
    for k in range(8):
        bits, bit = (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1
        near = context & 255
        p, left = top.given[near, bits].copy(), top.left[near, bits].copy()
        for i, level in enumerate(tree):
            at, seen = level.find((context & (1 << 8 * (i + 2)) - 1) << 8 | bits)
            if not len(level.key):
                break
            kt = (level.ones[at] + 0.5) / (level.zeros[at] + level.ones[at] + 1)
            p += left * np.where(seen, level.stay[at] * kt, 0.5)
            left *= np.where(seen, 1 - level.stay[at], 0)
        p += left * 0.5
        total += np.log10(np.where(bit == 1, p, 1 - p))
    return total


def score(docs: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, chunk: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``train`` names a boolean column: the rows to learn from. ``chunk`` names a column of whole numbers that says which
    rows are counted together, best rows that are read together; without it rows are dealt out by a hash.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()  # ids travel as strings: a null beside them would make numbers inexact
    if chunk is None:
        size = docs.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0
        of_chunk = F.pmod(F.xxhash64(id_col, F.length(text_col)), F.lit(size // CHUNK_CHARS + 1))
    else:
        of_chunk = F.col(chunk)
    rows = docs.select(of_chunk.cast("long").alias("chunk"), F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))

    def emit(chunk: int, found: dict[int, tuple[list, list]]) -> Iterator[pd.DataFrame]:
        for what, (keys, counts) in found.items():
            key, n = summed(keys, counts)
            for i in range(0, len(key), 1 << 17):
                yield pd.DataFrame({"chunk": np.int64(chunk), "word": what == 0, "key": key[i : i + (1 << 17)], "n": n[i : i + (1 << 17)]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The distinct words and byte runs of each chunk, with their counts in training rows."""
        held: dict[int, dict[int, tuple[list, list]]] = {}
        sizes: dict[int, int] = {}
        for b in slices(batches, chars=SLICE_CHARS):
            for c, part in b.groupby("chunk"):
                found = held.setdefault(c, {0: ([], []), 1: ([], [])})
                flat, start = joined(list(part["text"]))
                learn = part["train"].to_numpy(bool)
                word, owner = words(flat, start)
                run = runs(flat, start, depth)
                by_text = np.repeat(learn, np.diff(np.append(start, len(flat))))
                word, by_word = np.concatenate([word, END_KEY.repeat(len(part))]), np.concatenate([learn[owner], learn])
                for what, all_keys, learned in ((0, word, by_word), (1, run, by_text)):
                    for times, some in ((1, all_keys[learned]), (0, all_keys[~learned])):
                        key, n = np.unique(some, return_counts=True)
                        found[what][0].append(key)
                        found[what][1].append(n * times)
                        sizes[c] = sizes.get(c, 0) + len(key)
                if sizes[c] > HELD_KEYS + sum(len(k[0]) for k, _ in found.values()):  # keep what is held small
                    for what in found:
                        key, n = summed(*found[what])
                        found[what] = ([key], [n])
                    sizes[c] = sum(len(found[what][0][0]) for what in found)
                if sum(sizes.values()) > 4 * HELD_KEYS:  # the same key may then come again from a chunk
                    for other in list(held):
                        yield from emit(other, held.pop(other))
                    sizes.clear()
        for c, found in held.items():
            yield from emit(c, found)

    counted = rows.mapInPandas(count, "chunk long, word boolean, key long, n long")
    totals = written(counted.groupBy("word", "key").agg(F.sum("n").alias("n"), F.collect_set("chunk").alias("chunks")), "totals")
    size = totals.where("word and n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = size["n"], size["v"]

    by_subtree = totals.where("not word").select(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("subtree"), "key", "n")

    def up(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["n"] > 0]
        if not len(group):
            return pd.DataFrame({"near": pd.Series(dtype="int32"), "bits": pd.Series(dtype="int32"), "zeros": [], "ones": [], "lw": []})
        root = levels(group["key"].to_numpy(np.int64), group["n"].to_numpy(np.int64), depth)[0]
        return pd.DataFrame({"near": np.int32(key[0] & 255), "bits": (root.key & 255).astype(np.int32), "zeros": root.zeros, "ones": root.ones, "lw": root.lw})

    near = by_subtree.groupBy("subtree").applyInPandas(up, "near int, bits int, zeros double, ones double, lw double").groupBy("near", "bits").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "lw"))).collect()
    zeros, ones, split = (np.zeros((256, 256)) for _ in range(3))
    for r in near:  # at most 256 * 255
        zeros[r["near"], r["bits"]], ones[r["near"], r["bits"]], split[r["near"], r["bits"]] = r["zeros"], r["ones"], r["lw"]
    top = Top(zeros, ones, split)

    def down(group: pd.DataFrame) -> pd.DataFrame:
        key, n = group["key"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        seen = n > 0
        return pd.DataFrame({"word": False, "key": key, "value": log10_of(key, levels(key[seen], n[seen], depth), top)})

    run_values = by_subtree.groupBy("subtree").applyInPandas(down, "word boolean, key long, value double")
    word_values = totals.where("word").select("word", "key", F.col("n").cast("double").alias("value"), "chunks")
    run_values = run_values.join(totals.where("not word").select("key", "chunks"), "key")
    values = run_values.select("word", "key", "value", "chunks").unionByName(word_values).select(F.explode("chunks").alias("chunk"), "word", "key", "value")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Texts travel compressed, some million characters together."""
        for b in slices(batches, chars=SLICE_CHARS):
            for c, part in b.groupby("chunk"):
                yield pd.DataFrame({"chunk": np.int64(c), "ids": [part["id"].tolist()], "texts": [zstandard.compress(pickle.dumps(part["text"].tolist()))]})

    def scored(packed: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        is_word = known["word"].to_numpy(bool)
        key, value = known["key"].to_numpy(np.int64), known["value"].to_numpy(np.float64)
        counted, priced = Lookup(key[is_word], value[is_word]), Lookup(key[~is_word], value[~is_word])
        out = []
        for ids, blob in zip(packed["ids"], packed["texts"]):
            flat, start = joined(pickle.loads(zstandard.decompress(blob)))
            word, owner = words(flat, start)
            c, c_end = counted(word), counted(END_KEY)[0]
            log = lambda c: np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
            n, size = len(ids), np.diff(np.append(start, len(flat)))
            total = np.add.reduceat(priced(runs(flat, start, depth)), start)
            out.append(
                pd.DataFrame({
                    "id": pd.Series(list(ids), dtype=object), "n_tokens": np.bincount(owner, minlength=n) + 1, "n_known": np.bincount(owner, c > 0, minlength=n).astype(np.int64) + int(c_end > 0),
                    "train_tokens": tokens, "base_score": np.bincount(owner, log(c), minlength=n) + log(c_end), "score": total, "bits_per_byte": -total / math.log10(2) / size,
                })
            )
        return pd.concat(out)

    out = "id string, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    packed = rows.select("chunk", "id", "text").mapInPandas(pack, "chunk long, ids array<string>, texts binary")
    found = packed.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInPandas(scored, out)
    return found.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).first()
    each = max(1, CHUNK_CHARS * size["rows"] // max(1, size["chars"] or 0))  # rows of a chunk, in the order of their file
    chunk = F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / each))
    docs = docs.select("doc_id", "text", (remainder("doc_id", 5) != 1).alias("train"), chunk.alias("chunk"))
    found = score(docs, "train", chunk="chunk")
    return found.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
