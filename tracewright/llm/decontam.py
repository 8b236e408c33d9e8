"""Benchmark decontamination: test items in a BM25 inverted index, searched by every passage of the training texts.

A training text's passages are windows of twice ``stride`` words at every ``stride`` words, with ``stride`` the longest
item (at least 64 words), so that each place where an item can stand lies whole in one passage. An item of more than
``LONG`` words is several entries of the index, even pieces of it, so that no item makes the passages longer than that. The passage's distinct
words query the index; impacts are divided by what the item scores against itself, and all items at ``THRESHOLD`` or
above are retrieved by block-max WAND. Most passages cannot reach any item: of each item the commonest words, up to half
of the threshold in impact, are set aside, and a passage whose other words cannot make up the rest is ruled out for all
passages of a batch at once, before the search proper.

A retrieved item counts when the passage holds ``OVERLAP`` of its word 5-grams, and ``PART`` of those of its question
and of its answer: the question ends with the first '?', or else with the first half of the words. An item or part of fewer
than 5 words is one k-mer of its own length, looked for among the passage's k-mers of that length. Of an item in pieces,
pieces found count with their overlaps, pieces not found with none, and the item's three shares are the means over its
pieces, over those that begin in its question, and over the others.

The index is held by every task, so its size is bounded: about ``SHARD_ITEMS`` items or ``SHARD_CHARS`` characters at a
time, and a larger benchmark takes a pass over the texts for each such part. Word frequencies and lengths are those of all items either way.

Defined results: null texts, empty texts and texts without words match nothing; items without words are left out;
repeated items and repeated rows are each reported; a null item id is reported as null; an empty table gives no rows; columns other than those named are not
read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, table, written
from .minhash import SHINGLE, kmers, word_hashes

THRESHOLD, OVERLAP, PART = 0.6, 0.8, 0.5
K1, B, BLOCK, SHARD_ITEMS, SHARD_CHARS, LEAST_STRIDE, LONG = 1.2, 0.75, 32, 20_000, 20_000_000, 64, 256
U = np.uint64


def sized(words: np.ndarray) -> tuple[int, np.ndarray]:
    """The k-mers and their length, which is that of the words if they are few."""
    return min(SHINGLE, len(words)), kmers(words)


def entries(text: str) -> list[tuple[np.ndarray, bool, int]]:
    """Of an item: the words of each piece, whether the piece begins in the question, and how many of its words are the question's."""
    words = word_hashes(text)
    cut = len(word_hashes(text[: text.index("?") + 1])) if "?" in text else (len(words) + 1) // 2
    n = -(-len(words) // LONG)
    edges = [len(words) * k // n for k in range(n + 1)] if n else []
    return [(words[a:b], a < cut, min(max(cut - a, 0), b - a)) for a, b in zip(edges, edges[1:])]


class Index:
    """Postings of the items by word, with normalised impacts and their maxima by block."""

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int], n_items: int, mean_len: float, stride: int):
        self.stride = stride
        self.ids, self.grams, self.parts, self.item, self.asks, kept = [], [], [], [], [], []
        for i, text in items:
            found = entries(text)
            for words, asks, cut in found:
                kept.append(words)
                self.item.append(len(self.ids))
                self.asks.append(asks)
                self.grams.append(sized(words))
                self.parts.append((sized(words[:cut]), sized(words[cut:])))
            if found:
                self.ids.append(i)
        #: Of each item: its pieces, and those that begin in its question.
        self.pieces = np.bincount(self.item, minlength=len(self.ids)) if self.item else np.zeros(0, dtype=int)
        self.asking = np.bincount(self.item, self.asks, minlength=len(self.ids)) if self.item else np.zeros(0)
        rows, cols, impact = [], [], []
        for col, words in enumerate(kept):
            term, tf = np.unique(words, return_counts=True)
            n = np.array([df[int(x)] for x in term.view(np.int64)], dtype=float)
            w = np.log1p((n_items - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_len))
            rows.append(term)
            cols.append(np.full(len(term), col))
            impact.append(w / w.sum())
        rows_, self.col, self.impact = (np.concatenate(x) if x else np.zeros(0) for x in (rows, cols, impact))
        rows_ = rows_.astype(U)
        self.terms, term_of = np.unique(rows_, return_inverse=True)
        order = np.lexsort((self.col, term_of))
        self.col, self.impact, term_of = self.col[order].astype(np.int64), self.impact[order], term_of[order]
        self.start = np.searchsorted(term_of, np.arange(len(self.terms) + 1))
        self.max = np.maximum.reduceat(self.impact, self.start[:-1]) if len(self.terms) else np.zeros(0)
        self.block_max = [np.maximum.reduceat(self.impact[a:b], np.arange(0, b - a, BLOCK)) for a, b in zip(self.start[:-1], self.start[1:])]
        # Of each item, the commonest words up to half of the threshold are not essential.
        count = np.diff(self.start)[term_of]
        order = np.lexsort((-self.impact, -count, self.col))
        first = np.searchsorted(self.col[order], np.arange(len(kept)))
        run = np.cumsum(self.impact[order])
        run -= np.repeat(np.concatenate([[0], run])[first], np.diff(np.append(first, len(order))))
        essential = np.zeros(len(order), dtype=bool)
        essential[order] = run > THRESHOLD / 2
        self.need = THRESHOLD - np.bincount(self.col[~essential], self.impact[~essential], minlength=len(kept)) - 1e-9
        self.e_col, self.e_impact = self.col[essential], self.impact[essential]
        self.e_start = np.searchsorted(term_of[essential], np.arange(len(self.terms) + 1))
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.terms & U((1 << 20) - 1)).astype(np.int64)] = True

    def term_ids(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that the index has, and their terms."""
        at = np.flatnonzero(self.maybe[(words & U((1 << 20) - 1)).astype(np.int64)])
        t = np.minimum(np.searchsorted(self.terms, words[at]), len(self.terms) - 1)
        known = self.terms[t] == words[at]
        return at[known], t[known]

    def passages(self, half: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Of the half passages, numbered so that a text's follow each other, the first halves of passages that can reach an item."""
        n = len(self.item)
        pair = np.unique(half * len(self.terms) + term)
        half, term = pair // len(self.terms), pair % len(self.terms)
        reach = self.e_start[term + 1] - self.e_start[term]
        at = np.repeat(self.e_start[term] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum())
        key, of = np.unique(np.repeat(half, reach) * n + self.e_col[at], return_inverse=True)
        score = np.bincount(of, self.e_impact[at], minlength=len(key))

        def beside(step: int) -> np.ndarray:
            k = np.minimum(np.searchsorted(key, key + step * n), max(len(key) - 1, 0))
            return np.where(key[k] == key + step * n, score[k], 0) if len(key) else score

        need = self.need[key % n] if n else score
        return np.unique(np.concatenate([(key // n)[score + beside(1) >= need], (key // n)[score + beside(-1) >= need] - 1]))

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: all (column, score) of at least ``THRESHOLD`` for the distinct ``terms``."""
        lists = [(int(t), int(self.start[t]), int(self.start[t + 1])) for t in terms]
        place = {t: a for t, a, _ in lists}
        live, found = [(int(self.col[a]), t, a, b) for t, a, b in lists], []
        while live:
            live.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _, _) in enumerate(live):
                bound += self.max[t]
                if bound >= THRESHOLD - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == doc:
                pivot += 1
            # The blocks in which the pivot would lie bound its score more tightly.
            blocks = 0.0
            for _, t, a, b in live[: pivot + 1]:
                at = place[t] + int(np.searchsorted(self.col[place[t] : b], doc))
                place[t] = at
                blocks += self.block_max[t][(at - a) // BLOCK] if at < b else 0.0
            if blocks >= THRESHOLD - 1e-9:
                score = sum(self.impact[place[t]] for _, t, _, b in live[: pivot + 1] if place[t] < b and self.col[place[t]] == doc)
                if score >= THRESHOLD - 1e-9:
                    found.append((doc, float(score)))
            moved = []
            for k, (c, t, a, b) in enumerate(live):
                if k <= pivot:
                    if place[t] < b and self.col[place[t]] == doc:
                        place[t] += 1
                    if place[t] >= b:
                        continue
                    c = int(self.col[place[t]])
                moved.append((c, t, a, b))
            live = moved
        return found

    def overlaps(self, col: int, grams: Callable[[int], np.ndarray]) -> tuple[float, float, float]:
        share = lambda k, g: float(np.isin(g, grams(k)).mean()) if k else 1.0
        return share(*self.grams[col]), share(*self.parts[col][0]), share(*self.parts[col][1])

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float, float]]]:
        """For each text its verified (item, score, overlap, question, answer), the best passage of each item."""
        out: list[list] = [[] for _ in texts]
        if not self.ids:
            return out
        words = [word_hashes(t or "") for t in texts]
        halves = np.array([len(w) // self.stride + 2 for w in words])
        base = np.cumsum(halves) - halves + 1
        flat = np.concatenate(words)
        half = np.repeat(base, [len(w) for w in words]) + np.concatenate([np.arange(len(w)) // self.stride for w in words])
        at, term = self.term_ids(flat)
        if not len(at):
            return out
        best: dict[tuple[int, int], tuple] = {}
        for h in self.passages(half[at], term):
            i = int(np.searchsorted(base, max(h, 1), side="right")) - 1
            first = max(0, int(h - base[i])) * self.stride
            passage = words[i][first : first + 2 * self.stride]
            if not len(passage):
                continue
            grams = functools.lru_cache(maxsize=None)(functools.partial(kmers, passage))
            for col, score in self.search(np.unique(self.term_ids(passage)[1])):
                whole, question, answer = self.overlaps(col, grams)
                if whole >= OVERLAP and question >= PART and answer >= PART:
                    best[i, col] = max(best.get((i, col), (0.0,)), (whole, score, question, answer))
        joint: dict[tuple[int, int], list[tuple]] = {}
        for (i, col), shares in sorted(best.items()):
            joint.setdefault((i, self.item[col]), []).append((col, *shares))
        for (i, item), found in joint.items():
            n, asking = self.pieces[item], self.asking[item]
            whole, score = (sum(x[k] for x in found) / n for k in (1, 2))
            question, answer = found[0][3:]
            if n > 1:
                question = sum(x[1] for x in found if self.asks[x[0]]) / max(asking, 1)
                answer = sum(x[1] for x in found if not self.asks[x[0]]) / (n - asking) if n > asking else 1.0
            if whole >= OVERLAP and question >= PART and answer >= PART:
                out[i].append((self.ids[item], float(score), float(whole), float(question), float(answer)))
        return out


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_items: int = SHARD_ITEMS) -> Iterator[Index]:
    """The index of all items, in as many parts as its bound asks for."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            for t in b["text"]:
                yield pd.DataFrame({"term": np.concatenate([np.unique(w) for w, *_ in entries(t)] or [np.zeros(0, dtype=U)]).view(np.int64), "items": 1})

    by_term = written(rows.select("text").mapInPandas(count, "term long, items long").groupBy("term").agg(F.sum("items").alias("df")), "terms")
    total = rows.select("text").mapInPandas(lambda it: (pd.DataFrame({"n": [len(w) for w, *_ in p], "item": [1] + [0] * (len(p) - 1)}) for b in it for t in b["text"] if (p := entries(t))), "n long, item long")
    total = total.agg(F.count("*").alias("n"), F.sum("n").alias("words"), F.max("n").alias("longest")).first()
    if not total["n"]:
        return
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    shards = max(-(-size["n"] // shard_items), -(-size["chars"] // SHARD_CHARS))
    stride = max(LEAST_STRIDE, total["longest"])
    for k in range(shards):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k) if shards > 1 else rows
        got = sorted(((r["id"], r["text"]) for r in own.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        known = by_term
        if shards > 1:
            terms = own.select("text").mapInPandas(lambda it: (pd.DataFrame({"term": np.unique(word_hashes(t)).view(np.int64)}) for b in it for t in b["text"]), "term long").distinct()
            known = by_term.join(terms, "term", "left_semi")
        yield Index(got, {r["term"]: r["df"] for r in known.collect()}, total["n"], total["words"] / total["n"], stride)


FOUND = (("item_id", "long"), ("score", "double"), ("overlap", "double"), ("question_overlap", "double"), ("answer_overlap", "double"))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(id, item_id, score, overlap, question_overlap, answer_overlap) for each row and item that match."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.limit(0).select("id", *(F.lit(None).cast(kind).alias(c) for c, kind in FOUND))
    for index in indexes(items, shard_items=shard_items):
        udf = found_by(spark.sparkContext.broadcast(index))
        found = found.unionByName(rows.select("id", F.explode(udf("text")).alias("m")).select("id", "m.*"))
    return found.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def found_by(held: Broadcast):
    """A column function: the items that a text holds."""

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip((c for c, _ in FOUND), m)) for m in ms] for part in slices([texts.to_frame("text")]) for ms in held.value.matches(list(part["text"]))])

    return F.pandas_udf(search, "array<struct<" + ",".join(f"{c}:{kind}" for c, kind in FOUND) + ">>")


def free_of(held: Broadcast):
    """A column function: whether a text holds none of the index's items."""

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not m for part in slices([texts.to_frame("text")]) for m in held.value.matches(list(part["text"]))], dtype=bool)

    return F.pandas_udf(clean, "boolean")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item was found."""
    small_batches(spark)
    kept = docs
    for index in indexes(table(spark, sf_dir, "benchmark")):
        kept = kept.where(free_of(spark.sparkContext.broadcast(index))("text"))
    return kept
