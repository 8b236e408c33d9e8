"""Near-duplicate classes by order min-hash over word 5-grams, verified by banded alignment.

A text is its sequence of words (runs of letters, digits and ``_``, small-cased); its k-mers are the runs of
``SHINGLE`` words, each labelled with how often it has occurred before in the text. Each of ``SKETCHES`` hash functions
picks the three least labelled k-mers and keeps them in text order; texts that agree in one such tuple are candidates.
Candidates are aligned word by word: their similarity is m / (n1 + n2 - m), with m the longest common
subsequence of their n1 and n2 words. It is 0.8 where one word in nine is another, or one in five is left out; moved text
lowers it. One minus it is a metric, which is used below. Pairs of ``SIMILARITY`` or more are links; classes are the
connected components of the links and of equal texts.

Short texts have too few k-mers to be sure to share a tuple, so they have keys that find all pairs: of two linked texts
with n1 and n2 >= n1 words, n1 up to ``SHORT``, at least 0.8 n2 labelled words are common to both, hence the first
n - ceil(0.8 n) + t of each in one order of hashes have t in common, and each set of t of those is a key.

Candidates are never paired all with all. Equal texts are one item from the start. In each bucket every member is
compared with the bucket's least member (the pivot), which settles buckets of true copies with one comparison each. What
is left are buckets whose members are then still in several classes: there, members that failed are compared with all
those that can be near to them by the metric's bounds and by counts of their words in hashed places, both of which lose
nothing. A bucket of more than ``CELL_WORDS`` words is dealt to cells for that: linked texts lie in the same or
in neighbouring classes of length, and each pair of blocks of such classes is one cell, so that every pair of the bucket
meets in one cell and no task holds more than two blocks.

Where more than ``CROWD`` texts agree, as a passage that many share makes them, pivots would only part them by that
passage. Those that also agree in a tuple of twice the size (and then four times) meet in buckets of those. When these are
settled, all of the crowd is gone through once more, as counts of words in hashed places, some quarter of a byte a word,
in cells as above, once for all crowds of mostly the same members: members of a crowd that are still of different classes and whose counts allow a link are settled as
what is left of a bucket is, with their texts. So no link of a crowd is lost, and its other texts are not moved.

Defined results: a null text is a class of its own (its row's id); empty texts, and texts without words, are classes by
equal text; a text under ``SHINGLE`` words is one k-mer; repeated rows give repeated rows in one class; where ids repeat
with other texts, the class's first row is the least id's with the least hash; an empty table gives none; columns other
than those named are not read. Ids and item numbers never pass through Python.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import scratch, small_batches, table, written

SHINGLE, SIMILARITY, SKETCHES = 5, 0.8, 40
#: K-mers of a tuple; the longer ones part the buckets of more than ``CROWD`` texts that agree in the shorter.
PICK, CROWD = (3, 6, 12), 256
#: Rows of a side that may be broadcast: some 30 MB of keys; above it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Words of what is left of a bucket, up to which one task settles it; beyond, of a block of a class of length.
CELL_WORDS = 200_000
#: Bytes of word counts in a block of a class of length of a crowd, and the least and most of one text.
CELL_BYTES, PLACES = 1 << 20, (64, 4096)
#: Members compared with one pivot in one task.
SALT_ROWS = 2_000
#: Words of the shorter text up to which candidates are complete, and the size of the sets that are their keys.
SHORT, SUBSET = 40, 4

U = np.uint64


@functools.lru_cache(maxsize=1)
def word_chars() -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    for cp in range(0x30000):
        out[cp] = not 0xD800 <= cp < 0xE000 and (chr(cp).isalnum() or cp == 95)
    out[0x30000:0x40000] = True
    return out


@functools.lru_cache(maxsize=1)
def seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, SKETCHES, dtype=U) * U(2) + U(1), rng.integers(0, 1 << 63, SKETCHES, dtype=U)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the text, in order."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(code):
        return np.zeros(0, dtype=U)
    inside = word_chars()[code]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=U)
    at = np.flatnonzero(inside)
    length = end - start
    place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    term = mixed(code[at].astype(U) * U(0x9E3779B97F4A7C15) + place.astype(U) * U(0xD1B54A32D192ED03))
    return mixed(np.add.reduceat(term, np.cumsum(length) - length) + length.astype(U))


def kmers(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    if len(words) == 0:
        return words
    k = min(size, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, dtype=U)
    for j in range(k):
        h = h * U(0x9E3779B97F4A7C15) + words[j : j + n]
    return mixed(h)


def labelled(grams: np.ndarray) -> np.ndarray:
    """Each k-mer mixed with the number of its earlier occurrences."""
    order = np.argsort(grams, kind="stable")
    run = grams[order]
    first = np.concatenate([[True], run[1:] != run[:-1]])
    if first.all():
        return grams
    at = np.arange(len(run))
    nth = np.empty(len(run), dtype=U)
    nth[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(U)
    return np.where(nth > 0, mixed(grams + nth * U(0xA24BAED4963EE407)), grams)


def least_common(n: int) -> int:
    """Labelled words that a text of ``n`` words has in common with each that it is linked to."""
    return -int((1e-9 - n * SIMILARITY) // 1)


@functools.lru_cache(maxsize=None)
def subsets(n: int, size: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), size)), dtype=np.int64)


def short_keys(words: np.ndarray) -> list[int]:
    """Keys of which any two linked texts share one if the shorter has up to ``SHORT`` words."""
    n = len(words)
    if least_common(n) > SHORT:
        return []
    size = min(SUBSET, least_common(n))  # the same for any two that can be linked
    picked = np.sort(mixed(labelled(words) ^ U(0x5851F42D4C957F2D)))[: n - least_common(n) + size]
    picked = picked[subsets(len(picked), size)]
    h = np.full(len(picked), (size + 16) * 0x632BE59BD9B4E019 & (1 << 64) - 1, dtype=U)
    for j in range(size):
        h = mixed(h * U(0x9E3779B97F4A7C15) + picked[:, j])
    return h.view(np.int64).tolist()


def counted(words: np.ndarray) -> bytes:
    """How many words each hashed place has, up to 255; more places for longer texts."""
    places = min(max(1 << (len(words) // 4).bit_length(), PLACES[0]), PLACES[1])
    return np.minimum(np.bincount((words & U(places - 1)).astype(np.int64), minlength=places), 255).astype(np.uint8).tobytes()


def sketch(text: str) -> tuple[int, list[int], list[list[int]]]:
    """The number of words, the keys of a short text, and for each size of tuple the hashes of its tuples; none for a text without words."""
    words = word_hashes(text)
    none: list[list[int]] = [[] for _ in PICK]
    if not len(words):
        return 0, [], none
    if len(words) <= least_common(SHORT):  # all that it can be linked to have such keys
        return len(words), short_keys(words), none
    return len(words), short_keys(words), tuples(labelled(kmers(words)))


def tuples(x: np.ndarray) -> list[list[int]]:
    """For each size of tuple a row of ``SKETCHES`` hashes; a longer tuple holds the shorter ones' k-mers."""
    a, b = seeds()
    most = min(PICK[-1], len(x))
    # The place of a k-mer takes the low bits of its hash, so that the least hashes bring their places along.
    low = U((1 << len(x).bit_length()) - 1)
    place, at = np.arange(len(x), dtype=U), []
    for i in range(0, SKETCHES, step := max(1, (1 << 20) // len(x))):
        v = x[None] * a[i : i + step, None] + b[i : i + step, None]
        v = v & ~low | place
        v.partition(most - 1, axis=1)
        at.append((np.sort(v[:, :most], axis=1) & low).astype(np.int64))
    at, out = np.concatenate(at), []
    for size in PICK:
        picked = x[np.sort(at[:, :size], axis=1)]
        h = np.arange(1, SKETCHES + 1, dtype=U) * U(0x2545F4914F6CDD1D)
        for j in range(picked.shape[1]):
            h = mixed(h * U(0x9E3779B97F4A7C15) + picked[:, j])
        out.append(h.view(np.int64))
    # Longer tuples only part what agrees in the shorter ones: half of their hashes' bits are enough.
    return [out[0].tolist()] + [h.astype(np.int32).tolist() for h in out[1:]]


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Words common to both, each as often as it is in both: no less than the alignment has."""
    (v, n), (w, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(v, w, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def aligned(x: list[int], y: list[int], band: int) -> int:
    """The longest common subsequence within ``band`` of the diagonal; a bit of ``free`` for each place of y."""
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    free, window = full, (1 << 2 * band + 1) - 1
    for i, v in enumerate(x):
        if v in where:
            near = i - band
            hit = free & where[v] & (window << near if near >= 0 else window >> -near)
            free = (free + hit | free - hit) & full
    return len(y) - free.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY - 1e-9) -> float:
    """Of two word sequences: exact where it is at least ``least``; below it, a bound that it does not exceed."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return min(n, m) / max(n, m, 1)
    k = min(n, m)
    same = a[:k] == b[:k]
    head = k if same.all() else int(same.argmin())
    k -= head
    same = a[n - k :][::-1] == b[m - k :][::-1]
    tail = k if k == 0 or same.all() else int(same.argmin())
    x, y = a[head : n - tail], b[head : m - tail]
    common = head + tail
    most = common + (in_common(x, y) if len(x) and len(y) else 0)
    if most / (n + m - most) < least:
        return most / (n + m - most)
    if len(x) and len(y):
        common += aligned(x.tolist(), y.tolist(), int((n + m) * (1 - least) / (1 + least)) + 1)
    found = common / (n + m - common)
    return found if found >= least else least - 1e-9


def compare(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Distances: exact up to that of a link, else a bound that the distance is not under."""
    words = functools.lru_cache(maxsize=256)(word_hashes)
    for a, b in batches:
        yield pd.Series([1 - similarity(words(x), words(y)) for x, y in zip(a, b)], dtype=float)


def settle(group: pd.DataFrame) -> pd.DataFrame:
    """Links between the classes in one cell of a bucket: members that failed against the pivot, each with all that can be near.

    In a cell of two blocks (``side`` 0 and 1) only members of different blocks are compared; ``side`` is -1 where all are.
    Two members that meet in several buckets (``bands``) are compared in the least of them.
    """
    near = 1 - SIMILARITY + 1e-9
    group = group.sort_values(["d", "item"], ignore_index=True)
    d, failed, item, side, n = group["d"].to_numpy(), group["failed"].to_numpy(bool), group["item"].to_numpy(np.int64), group["side"].to_numpy(), group["n"].to_numpy()
    texts, bands, band = list(group["text"]), [set(x.tolist()) for x in group["bands"]], int(group["band"].iloc[0])
    # The commonest buckets that come before this one, as bits: members that share one meet there.
    before = Counter(x for b in bands for x in b if x < band)
    bit = {x: 1 << k for k, (x, times) in enumerate(before.most_common(63)) if times > 1}
    met = np.array([sum(bit.get(x, 0) for x in b) for b in bands], dtype=np.int64)
    root = np.unique(group["root"], return_inverse=True)[1]
    at, links = np.arange(len(d)), []
    words: list[np.ndarray | None] = [None] * len(d)
    fine, rough = np.zeros((len(d), 1024), dtype=np.int32), np.zeros((len(d), 64), dtype=np.int32)
    for f in np.flatnonzero(failed):
        can = np.where(failed, at > f, d[f] - d <= near) & ((side < 0) | (side != side[f])) & (met & met[f] == 0) & (root != root[f])
        some = np.flatnonzero(can & (np.minimum(n, n[f]) >= (SIMILARITY - 1e-9) * np.maximum(n, n[f])))
        for i in (*some, f) if len(some) else ():
            if words[i] is None:
                words[i] = word_hashes(texts[i])
                fine[i] = np.bincount((words[i] & U(1023)).astype(np.int64), minlength=1024)
                rough[i] = fine[i].reshape(64, 16).sum(1)
        for counts in (rough, fine):
            some = some[np.abs(counts[some] - counts[f]).sum(1) <= (n[some] + n[f]) * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-6]
        for i in some:
            if root[i] != root[f] and min(bands[f] & bands[i]) == band and similarity(words[f], words[i]) >= SIMILARITY - 1e-9:
                root[root == root[i]] = root[f]
                links.append((item[f], item[i]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def alike(group: pd.DataFrame) -> pd.DataFrame:
    """Members of one cell of a crowd that can be near to one of another class, by their lengths and their counts of words."""
    group = group.sort_values(["n", "item"], ignore_index=True)
    item, n, side = group["item"].to_numpy(np.int64), group["n"].to_numpy(np.int64), group["side"].to_numpy()
    root = np.unique(group["root"], return_inverse=True)[1]
    end = np.searchsorted(n, n / (SIMILARITY - 1e-9), side="right")
    rows = [np.frombuffer(c, dtype=np.uint8) for c in group["counts"]]
    found, places, counts = np.zeros(len(item), dtype=bool), 0, np.zeros((0, 0), dtype=np.int16)
    for f in range(len(item) - 1):
        if places != len(rows[f]):  # of more places some are put together: differences do not grow
            places, first = len(rows[f]), f
            last = end[np.searchsorted([len(r) for r in rows], places, side="right") - 1]
            counts = np.stack([r.reshape(-1, places).sum(0, dtype=np.int16) for r in rows[f:last]])
        at = slice(f + 1, end[f])
        can = (root[at] != root[f]) & ((side[at] < 0) | (side[at] != side[f]))
        some = f + 1 + np.flatnonzero(can & ~found[at] if found[f] else can)
        apart = np.abs(counts[some - first] - counts[f - first]).sum(1, dtype=np.int32)
        some = some[apart <= (n[some] + n[f]) * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-6]
        found[some] = True
        found[f] |= len(some) > 0
    return pd.DataFrame({"band": group["band"][found], "item": item[found]})


def salted(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with both texts. A pivot b with many partners is copied to several partitions, each with a part of them."""
    hot = pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > SALT_ROWS).select("b", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    hot = written(hot, "hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    salts = F.coalesce("salts", F.lit(1))
    pivots = pairs.select("b").distinct().join(hot, "b", "left").join(texts.select(F.col("item").alias("b"), F.col("text").alias("text_b")), "b")
    pivots = pivots.select("b", "text_b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), salts).cast("int").alias("salt"))
    sided = dealt.join(texts.select(F.col("item").alias("a"), F.col("text").alias("text_a")), "a")
    return sided.join(pivots, ["b", "salt"]).select("a", "b", "text_a", "text_b")


def rooted(df: DataFrame, label: DataFrame, key: str, root: str) -> DataFrame:
    """``df`` with the class that each ``key`` has so far; a key without links is its own."""
    found = df.join(label.select(F.col("node").alias(key), F.col("root").alias(root)), key, "left")
    return found.withColumn(root, F.coalesce(root, key))


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (node, root) once ``links`` (a, b) are added to those of ``label``."""
    if links.isEmpty():
        return label
    roots = rooted(rooted(links, label, "a", "x"), label, "b", "y").where("x <> y").select("x", "y")
    new = written(components(roots, "x", "y"), "roots")
    moved = label.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(new.join(label.select("node"), "node", "left_anti"))


def cells(left: DataFrame, weight: str = "n", most: int | None = None) -> DataFrame:
    """``left`` (band, item, n, size, ...) with ``cell`` and ``side``: the cells in which what is left of a bucket is settled, of ``CELL_WORDS`` or of at ``most`` so much weight."""
    most = CELL_WORDS if most is None else most
    words = left.groupBy("band").agg(F.sum(weight).alias("words"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("band", "words")
    left = left.join(words, "band")
    none = F.array(F.lit(-1), F.lit(-1), F.lit(-1), F.lit(-1))
    small = left.where(F.col("words") <= most).drop("words", "size").withColumn("cell", none).withColumn("side", F.lit(-1))
    large = left.where(F.col("words") > most).drop("words")
    blocks = large.groupBy("band", "size").agg(F.ceil(F.sum(weight) / most).cast("int").alias("blocks"))
    beside = lambda step, name: blocks.select("band", (F.col("size") - step).alias("size"), F.col("blocks").alias(name))
    large = large.join(blocks, ["band", "size"]).join(beside(1, "above"), ["band", "size"], "left").join(beside(-1, "below"), ["band", "size"], "left")
    large = large.withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    size, block = F.col("size"), F.col("block")
    met = F.concat(
        F.transform(upto("blocks"), lambda j: F.array(size, F.least(block, j), size, F.greatest(block, j))),
        F.transform(upto("above"), lambda j: F.array(size, block, size + 1, j)),
        F.transform(upto("below"), lambda j: F.array(size - 1, j, size, block)),
    )
    large = large.withColumn("cell", F.explode(met))
    first = (F.col("cell")[0] == size) & (F.col("cell")[1] == block)
    alone = (F.col("cell")[0] == F.col("cell")[2]) & (F.col("cell")[1] == F.col("cell")[3])
    large = large.withColumn("side", F.when(alone, -1).when(first, 0).otherwise(1))
    return small.unionByName(large.select(*small.columns))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, ``key`` (of the text, null for a null text), ``class_id``, the least id of its class, and ``first``, whether its id and text are those that stand for the class."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.unhex(F.md5(text_col)).alias("key"))
    with scratch(docs.sparkSession):
        of_key = written(firsts(rows), "firsts", keep=True)
    return rows.select("id", "key").join(of_key, "key", "left").select(
        F.col("id").alias(id_col), "key", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        (F.col("key").isNull() | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key")))).alias("first"),
    )


def buckets(items: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(band, a, b): the members of each bucket with its pivot; and (band, item) of the crowds, if there are any."""

    def met(members: DataFrame) -> DataFrame:
        return members.groupBy("band").agg(F.min("item").alias("b"), F.count("*").alias("members")).where("members > 1")

    def with_pivot(members: DataFrame, pivots: DataFrame) -> DataFrame:
        pivots = F.broadcast(pivots) if pivots.count() <= BROADCAST_ROWS else pivots
        return members.join(pivots.select("band", "b"), "band").select("band", F.col("item").alias("a"), "b")

    short = items.select(F.explode("short").alias("band"), "item")
    star = with_pivot(short, written(met(short), "buckets"))
    each, crowded, crowd_items = items.select(F.explode("level0").alias("band"), "item"), None, None
    for k in range(len(PICK)):
        if k:  # of the crowded ones: the next longer tuples of the same sketches
            zipped = items.select("item", F.explode(F.arrays_zip(*(f"level{j}" for j in range(k + 1)))).alias("z"))
            crowd = F.col("z.level0")
            for j in range(1, k):
                crowd = F.xxhash64(crowd, f"z.level{j}")
            each = zipped.select("item", crowd.alias("crowd"), F.col(f"z.level{k}").alias("longer")).join(crowded, "crowd").select(F.xxhash64("crowd", "longer").alias("band"), "item")
        found = written(met(each), "buckets")
        last = k + 1 == len(PICK)
        star = star.unionByName(with_pivot(each, found if last else found.where(F.col("members") <= CROWD)))
        crowded = found.where(F.col("members") > CROWD).select(F.col("band").alias("crowd"))
        n = crowded.count()
        if last or not n:
            return written(star, "star", keep=True), crowd_items
        crowded = F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded
        if not k:
            crowd_items = written(each.join(crowded.withColumnRenamed("crowd", "band"), "band"), "crowds", keep=True)


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def size_class() -> Column:
    return F.floor(F.log(F.col("n")) / math.log(1.01 / SIMILARITY)).cast("int")


def with_other_class(left: DataFrame) -> DataFrame:
    """Of ``left`` (band, item, root, size, ...) the members with another of a length that can be near, and of another class so far."""
    left = written(left, "left")  # it is read twice
    near_sizes = left.select("band", "root", "size").distinct().select("band", "root", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
    met = near_sizes.groupBy("band", "size").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("band", "size")
    return written(left.join(met, ["band", "size"]), "left")


def texts_of(items: DataFrame, rows: DataFrame) -> DataFrame:
    """(item, n, text) of ``items`` (item, n, key, id), where repeated rows are repeated."""
    hit = few(items).select(F.col("key").alias("k"), F.col("id").alias("i"), "item", "n")
    return rows.join(hit, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i"))).select("item", "n", "text")


def settled(left: DataFrame, texts: DataFrame) -> DataFrame:
    """The links between classes in what is ``left`` of the buckets (band, item, d, failed, root, n, size)."""
    left = written(left.join(left.groupBy("item").agg(F.collect_list("band").alias("bands")), "item"), "left")  # at most as many as keys of a text
    links = cells(left).join(texts.select("item", "text"), "item").groupBy("band", "cell").applyInPandas(settle, "a long, b long")
    return written(links, "settled")


def gathered(crowd: DataFrame) -> DataFrame:
    """The crowds (band, item) of mostly the same members put together: all that met in one meet still, and a group has no more pairs than its crowds had.

    The sketches of one passage give as many crowds of those that have it. A crowd goes to the largest one of most of its members.
    """
    sizes = written(crowd.groupBy("band").agg(F.count("*").alias("rows")), "sizes")
    bands = crowd.join(few(sizes), "band").groupBy("item").agg(F.collect_list(F.struct("rows", "band")).alias("bands"))  # at most ``SKETCHES``
    homes = bands.select(F.array_max("bands")["band"].alias("home"), F.explode("bands").alias("b")).groupBy("b.band", "b.rows", "home").agg(F.count("*").alias("n")).where("2 * n > rows")
    groups = written(sizes.join(homes.select("band", "home"), "band", "left").select("band", "rows", F.xxhash64(F.coalesce("home", "band")).alias("to")), "groups")
    members = crowd.join(few(groups), "band").select("to", "item").distinct().groupBy("to").agg(F.count("*").alias("members"))
    fewer = groups.groupBy("to").agg(F.sum(F.col("rows") * F.col("rows")).alias("pairs")).join(members, "to").where("members * members <= pairs").select("to", F.lit(True).alias("fewer"))
    groups = written(groups.join(fewer, "to", "left").select("band", F.when(F.col("fewer"), F.col("to")).otherwise(F.col("band")).alias("to")), "groups")
    return written(crowd.join(few(groups), "band").select(F.col("to").alias("band"), "item").distinct(), "gathered")


def crowd_links(crowd: DataFrame, items: DataFrame, rows: DataFrame, label: DataFrame) -> DataFrame | None:
    """The links between classes in the crowds (band, item)."""

    @F.pandas_udf("binary")
    def counted_(texts: pd.Series) -> pd.Series:
        return pd.Series([counted(word_hashes(t)) for t in texts], dtype=object)

    crowd = gathered(crowd)
    members = items.join(few(crowd.select("item").distinct()), "item").select("item", "n", "key", "id")
    counts = written(texts_of(members, rows).select("item", "n", counted_("text").alias("counts")).dropDuplicates(["item"]), "counts")
    left = rooted(crowd.join(few(counts.select("item", "n", F.octet_length("counts").alias("bytes"))), "item"), label, "item", "root").withColumn("size", size_class())
    left = with_other_class(left)
    dealt = cells(left, "bytes", CELL_BYTES).join(counts.select("item", "counts"), "item")
    found = written(dealt.groupBy("band", "cell").applyInPandas(alike, "band long, item long").distinct(), "alike")
    if found.isEmpty():
        return None
    left = written(left.join(found, ["band", "item"]).select("band", "item", F.lit(0.0).alias("d"), F.lit(True).alias("failed"), "root", "n", "size"), "left")
    texts = texts_of(members.join(few(found.select("item").distinct()), "item"), rows).dropDuplicates(["item"])
    return settled(left, written(texts, "texts"))


def firsts(rows: DataFrame) -> DataFrame:
    """(key, first): of each text of ``rows`` (id, text, key) the id and key of the row that stands for its class."""
    near = 1 - SIMILARITY + 1e-9

    @F.pandas_udf("n int, short array<bigint>," + ",".join(f"level{k} array<{'int' if k else 'bigint'}>" for k in range(len(PICK))))
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [sketch(t) for t in texts]
            yield pd.DataFrame({"n": [x[0] for x in found], "short": [x[1] for x in found]} | {f"level{k}": [x[2][k] for x in found] for k in range(len(PICK))})

    # One item for each text: the row with the least id that has it.
    rows = rows.where("text is not null")
    with scratch(rows.sparkSession):  # the sketches, most of what is written, go once the buckets are made
        copies = rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
        copies = written(copies.where("copies > 1"), "copies")
        first = rows.join(few(copies), "key", "left").where(F.col("copies").isNull() | F.col("id").eqNullSafe(F.col("least")))
        items = first.select("id", "key", sketched("text").alias("s")).select(F.monotonically_increasing_id().alias("item"), "id", "key", "s.*")
        items = written(items, "items")
        again = items.groupBy("key").agg(F.min("item").alias("item"), F.count("*").alias("rows")).where("rows > 1")
        if not again.isEmpty():  # rows that repeat an id and a text
            spare = items.select("item", "key").join(again.select("key", F.col("item").alias("kept")), "key").where("item <> kept").select("item")
            items = written(items.join(spare, "item", "left_anti"), "items")
        star, crowd = buckets(items)
        items = written(items.select("item", "id", "key", "n"), "items", keep=True)

    pairs = written(star.where("a <> b").select("a", "b").distinct(), "pairs")
    size = few(items.select("item", "n"))
    sized = pairs.join(size.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    like = F.least("na", "nb") / F.greatest("na", "nb")  # no similarity is greater
    sized = written(sized.select("a", "b", (1 - like).alias("d")), "sized")
    pairs = sized.where(F.col("d") <= near).select("a", "b")
    needed = written(pairs.select(F.col("a").alias("item")).unionByName(star.where("a <> b").select(F.col("a").alias("item"))).unionByName(star.where("a <> b").select(F.col("b").alias("item"))).distinct().join(items.select("item", "key", "id", "n"), "item"), "needed")
    texts = written(texts_of(needed, rows).dropDuplicates(["item"]), "texts")
    found = salted(pairs, texts).select("a", "b", F.pandas_udf(compare, "double")("text_a", "text_b").alias("d"))
    found = written(found.unionByName(sized.where(F.col("d") > near)), "compared")
    label = written(components(found.where(F.col("d") <= near)), "classes")

    # Buckets of more than one class: members that failed, and those that passed and can be near to one that failed.
    judged = star.join(found, ["a", "b"], "left").select("band", F.col("a").alias("item"), F.coalesce("d", F.lit(0.0)).alias("d"))
    judged = rooted(judged, label, "item", "root").withColumn("failed", F.col("d") > near)
    mixed_ = judged.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.min(F.when(F.col("failed"), F.col("d"))).alias("nearest")).where("r <> s").select("band", "nearest")
    left = judged.join(mixed_, "band").where(F.col("failed") | (F.col("d") >= F.col("nearest") - near)).select("band", "item", "d", "failed", "root")
    left = with_other_class(left.join(size, "item").withColumn("size", size_class()))
    label = merged(label, settled(left, texts))
    if crowd is not None and (links := crowd_links(crowd, items, rows, label)) is not None:
        label = merged(label, links)

    ids = items.select("item", "id", "key").join(label.withColumnRenamed("node", "item"), "item", "left").withColumn("root", F.coalesce("root", "item"))
    least = ids.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    return ids.join(least, "root").select("key", "first")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the row that stands for it (one of them, if rows repeat)."""
    with scratch(spark):
        found = written(classes(docs), "found")
        gone = written(found.where("not first").select(F.col("doc_id").alias("__gone_id"), F.col("key").alias("__gone_key")).distinct(), "gone", keep=True)
        again = not found.where("key is not null and first").groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    few = gone.count() <= BROADCAST_ROWS
    kept = docs.withColumn("__key", F.unhex(F.md5("text")))
    kept = kept.join(F.broadcast(gone) if few else gone, kept["doc_id"].eqNullSafe(F.col("__gone_id")) & kept["__key"].eqNullSafe(F.col("__gone_key")), "left_anti")
    if again:  # rows that repeat an id and a text: one of them stays
        null_text = kept.where("__key is null")
        kept = kept.where("__key is not null").dropDuplicates(["doc_id", "__key"]).unionByName(null_text)
    return kept.select(*docs.columns)
