"""Byte-pair encoding and decoding of whole texts by tree concatenation.

Texts of up to ``leaf_chars`` code points are one leaf and are encoded where they lie. A longer text is cut into leaves
that are dealt out and encoded in parallel; neighbouring halves are then joined level by level. At each join the tokens
around it are encoded again in a window that doubles until its outermost tokens are those that both sides had, so that
every adjacent pair of tokens is one that the encoder itself produced.

Defined results: a null text counts as empty; an empty text has no tokens; repeated rows give repeated rows; an empty
table gives none; only the named columns are read, so other columns and their names do not matter.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, small_batches, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = {"<|endoftext|>": 50256}
LEAF_CHARS = 1 << 13
#: Tokens that a window must share with each side, and tokens that the first window takes from each side.
AGREE, WINDOW = 4, 16


class Codec:
    """The encoder over one vocabulary of ranks; a special token's string counts as that token."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in SPECIAL):
            return self._encoding.encode(text, allowed_special="all")
        return self._encoding.encode_ordinary(text)

    def raw(self, ids: list[int]) -> bytes:
        return self._encoding.decode_bytes(ids)

    def decode(self, ids: list[int]) -> str:
        return self.raw(ids).decode("utf-8", errors="replace")

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of the two texts written one after the other."""
        if not left or not right:
            return left + right
        width = WINDOW
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            try:
                text = self.raw(left[i:] + right[:j]).decode("utf-8")
            except UnicodeDecodeError:  # a code point that lies in two tokens, at either end
                width += 1
                continue
            ids = self.encode(text)
            if (i == 0 or ids[:AGREE] == left[i : i + AGREE]) and (j == len(right) or ids[-AGREE:] == right[j - AGREE : j]):
                return left[:i] + ids + right[j:]
            width *= 2

    def tree(self, leaves: list[list[int]]) -> list[int]:
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []


@functools.lru_cache(maxsize=4)
def codec(ranks_path: str) -> Codec:
    return Codec(ranks_path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """One row for each row of ``docs``: the id, ``ids`` array<int> and ``decoded`` string."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @F.pandas_udf("ids array<int>, decoded string")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(ranks_path)
        for texts in batches:
            ids = [c.encode(t) for t in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [c.decode(x) for x in ids]})

    @F.pandas_udf("array<int>")
    def leaf_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(ranks_path)
        for texts in batches:
            yield pd.Series([c.encode(t) for t in texts])

    @F.pandas_udf("ids array<int>, decoded string")
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(ranks_path)
        for leaves in batches:
            ids = [c.tree([list(map(int, leaf["ids"])) for leaf in x]) for x in leaves]
            yield pd.DataFrame({"ids": ids, "decoded": [c.decode(x) for x in ids]})

    short = rows.where(F.length("text") <= leaf_chars).select("id", whole("text").alias("s"))
    long = rows.where(F.length("text") > leaf_chars).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    cuts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / leaf_chars).cast("int"))
    leaves = long.select("row", "id", F.explode(F.transform(cuts, lambda k: F.struct(k.alias("leaf"), F.substring(F.col("text"), k * leaf_chars + 1, F.lit(leaf_chars)).alias("text")))).alias("cut"))
    leaves = leaves.select("row", "id", "cut.leaf", "cut.text").repartition(parts(docs), "row", "leaf").select("row", "id", "leaf", leaf_ids("text").alias("ids"))
    trees = leaves.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("leaf", "ids"))).alias("leaves"))  # the tokens of one text
    long = trees.select("id", joined("leaves").alias("s"))
    return short.unionByName(long).select(F.col("id").alias(id_col), "s.ids", "s.decoded")


def ids_sha256(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: each document's integer id with its tokens."""
    found = encode(docs)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", ids_sha256(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
