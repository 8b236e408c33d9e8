"""Language identification in two levels: first the family, then the language within it.

Features are letter 1- to 3-grams of the whole small-cased text (runs of other characters count as one space), hashed
into ``BUCKETS`` and taken as shares of all n-grams. A linear support vector machine for each family, against the
others, picks the family; within it, one machine for each pair of languages votes. Margins become probabilities by Platt
scaling on rows held back from fitting; the score is the family's probability times the least of the winner's pairwise ones.

The machines are fitted on at most ``SAMPLE`` labelled rows in all, an equal bound for each label, taken by the order of
a hash of the id. That bound is the only one; every row is predicted from its whole text.

A text whose n-grams are on the whole much rarer than those of any sampled row belongs to no learned language: its score
is 0, and the pipeline's first stage rejects it.

Defined results: ``und`` with score 0 for a null text, a text without letters, and where nothing was learned; repeated
rows give repeated rows; equal texts get equal results; an empty table gives none; labels of one language only predict
that language; columns other than those named are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, small_batches, table

SAMPLE, BUCKETS, PIECE = 1600, 1 << 13, 1 << 17
#: How far under the lowest of the sample, in distances of that from the sample's median, a text's mean must lie to be strange.
STRANGE = 1.0
UND = "und"
#: Family of a language by its ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl", "be", "mk", "bs"),
    "uralic": ("fi", "et", "hu"), "turkic": ("tr", "az", "kk", "uz"), "semitic": ("ar", "he", "mt"), "indic": ("hi", "bn", "mr", "ne", "ur", "pa"),
}


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes), code)


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x30000):
        if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
            out[cp] = cp
    out[0x30000:0x40000] = np.arange(0x30000, 0x40000, dtype=np.uint32)  # rare ideographs
    return out


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each n-gram, index of its text) for all n-grams, each once, some ``PIECE`` characters at a time."""
    code, owner, size = [np.zeros(2, np.uint32)], [np.zeros(2, np.int64)], 0
    for i, t in enumerate(texts):
        low = (t or "").lower()
        for start in range(0, len(low) + 1, PIECE):
            part = letters()[np.frombuffer((low[start : start + PIECE]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            if start + PIECE > len(low):
                part = np.append(part, np.uint32(0))
            code.append(part)
            owner.append(np.full(len(part), i))
            size += len(part)
            if size >= PIECE:
                found, rest = grams(np.concatenate(code), np.concatenate(owner))
                yield found
                code, owner, size = [rest[0]], [rest[1]], 0
    if size:
        yield grams(np.concatenate(code), np.concatenate(owner))[0]


def grams(code: np.ndarray, owner: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The n-grams around all code points but the first and the last, and the last two, with which the next piece begins."""
    keep = np.concatenate([[True, True], (code[2:] != 0) | (code[1:-1] != 0)])  # a run of other characters is one
    code, owner = code[keep], owner[keep]
    a, b, c = (code[k : len(code) - 2 + k] for k in range(3))
    own, after = owner[1:-1], owner[2:]
    mix = lambda *x: functools.reduce(lambda h, v: (h ^ v) * np.uint32(0x9E3779B1) ^ (h >> np.uint32(15)), x, np.full(len(a), len(x), np.uint32)) >> np.uint32(19)
    whole, two = b != 0, (b != 0) | (c != 0)
    ids = np.concatenate([mix(b)[whole], mix(b, c)[two], mix(a, b, c)[whole]])
    found = (ids % np.uint32(BUCKETS)).astype(np.int64), np.concatenate([own[whole], np.where(b != 0, own, after)[two], own[whole]])
    return found, (code[-2:], owner[-2:])


def vectors(texts: list[str | None]) -> np.ndarray:
    """Shares of the n-grams, a row for each text; of texts without letters all 0."""
    out = np.zeros(len(texts) * BUCKETS, dtype=np.float32)
    for ids, own in pieces(texts):
        out += np.bincount(own * BUCKETS + ids, minlength=len(out))
    out = out.reshape(len(texts), BUCKETS)
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights and bias of the squared-hinge machine by accelerated gradient steps; y is 1 or -1, the classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    rate = np.float32(1 / (2 * c * float((weight * (np.einsum("ij,ij->i", x, x) + 1)).sum()) + 0.01))
    w = look = np.zeros(x.shape[1] + 1, dtype=np.float32)  # the bias comes last
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look[:-1] + look[-1]))
        pull = weight * y * slack
        new = look - rate * (np.float32(0.01) * look - np.float32(2 * c) * np.append(pull @ x, pull.sum()))
        look, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b, t = 1.0, 0.0, (y > 0).astype(float)
    for _ in range(300):
        d = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - t
        a, b = a - 0.3 * float((d * z).mean() + 0.001 * (a - 1)), b - 0.3 * float(d.mean())
    return a, b


class Model:
    """All machines as columns of one table of weights by bucket."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs))
        self.families = sorted({family(v) for v in self.langs})
        self.columns: list[tuple[str, str, str]] = [("family", f, "") for f in self.families if len(self.families) > 1]
        self.columns += [("pair", a, b) for i, a in enumerate(self.langs) for b in self.langs[i + 1 :] if family(a) == family(b)]
        #: Of each n-gram, the logarithm of its share in the sample; of a text their mean, which is low for what no language here has.
        self.common = np.log(x.mean(0, dtype=np.float64) + 1e-6).astype(np.float32) if len(x) else np.zeros(BUCKETS, np.float32)
        known = np.sort((x @ self.common) / np.maximum(x.sum(1), 1e-9)) if len(x) else np.zeros(1)
        self.least = float(known[0] - STRANGE * (known[len(known) // 2] - known[0]))
        spread = x.std(0) + 1e-4 if len(x) else np.ones(BUCKETS)
        scaled = (x / spread / 30).astype(np.float32) if len(x) else x
        back = np.arange(len(langs)) % 5 == 0
        fam = np.array([family(v) for v in langs])
        self.w, self.bias, self.platt = np.zeros((BUCKETS, len(self.columns)), dtype=np.float32), np.zeros(len(self.columns)), []
        for k, (kind, a, b) in enumerate(self.columns):
            use = np.ones(len(langs), dtype=bool) if kind == "family" else (langs == a) | (langs == b)
            y = np.where((fam if kind == "family" else langs) == a, 1, -1).astype(np.float32)
            w = fit_svm(scaled[use & ~back], y[use & ~back])
            held = use & back if len(set(y[use & back])) == 2 else use
            self.platt.append(platt(scaled[held] @ w[:-1] + w[-1], y[held]))
            self.w[:, k], self.bias[k] = w[:-1] / spread / 30, w[-1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        total, count, common = np.zeros((n, len(self.columns))), np.zeros(n), np.zeros(n)
        for ids, own in pieces(texts):
            order = np.argsort(own, kind="stable")
            ids, own = ids[order], own[order]
            if len(own):
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                count[own[first]] += np.diff(np.r_[first, len(own)])
                common[own[first]] += np.add.reduceat(self.common[ids].astype(np.float64), first)
                if self.columns:
                    total[own[first]] += np.add.reduceat(self.w[ids], first, axis=0)
        p = total / np.maximum(count, 1)[:, None] + self.bias
        for k, (a, b) in enumerate(self.platt):
            p[:, k] = 1 / (1 + np.exp(-np.clip(a * p[:, k] + b, -30, 30)))
        if len(self.families) > 1:
            fam_p = p[:, : len(self.families)] / np.maximum(p[:, : len(self.families)].sum(1, keepdims=True), 1e-12)
        else:
            fam_p = np.ones((n, len(self.families)))
        lang_out, score = np.full(n, UND, dtype=object), np.zeros(n)
        if not self.langs:
            return list(lang_out), score
        chosen = fam_p.argmax(1)
        for f, name in enumerate(self.families):
            at = np.flatnonzero((chosen == f) & (count > 0))
            own = [v for v in self.langs if family(v) == name]
            votes, least = np.zeros((len(at), len(own))), np.ones((len(at), len(own)))
            for k, (kind, a, b) in enumerate(self.columns):
                if kind == "pair" and a in own:
                    q = p[at, k]
                    for v, r in ((own.index(a), q), (own.index(b), 1 - q)):
                        votes[:, v] += r
                        least[:, v] = np.minimum(least[:, v], r)
            best = votes.argmax(1)
            lang_out[at] = np.array(own, dtype=object)[best]
            score[at] = fam_p[at, f] * least[np.arange(len(at)), best]
        strange = common / np.maximum(count, 1) < self.least
        return list(lang_out), np.clip(np.where(strange, 0, score), 0, 1)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` rows; null labels and null texts are left out."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not counts:
        return Model(np.zeros((0, BUCKETS), dtype=np.float32), np.array([], dtype=object))
    each = max(1, sample // len(counts))
    # First a share of each label by hash, a little more than is wanted; then its first rows by that hash.
    share = F.lit(1.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (1.3 * each + 50) / n))).otherwise(share)
    rank = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_003)) / 1_000_003
    some = rows.withColumn("rank", rank).where(F.col("rank") < share)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), 64):
                b = whole.iloc[i : i + 64]
                x = vectors(list(b["text"])).astype(np.float16)
                yield pd.DataFrame({"rank": b["rank"], "id": b["id"], "lang": b["lang"], "x": [v.tobytes() for v in x]})

    schema = T.StructType.fromDDL("rank double, id string, lang string, x binary")
    got = some.mapInPandas(count, schema).collect()
    kept: dict[str, int] = {}
    use = []
    for r in sorted(got, key=lambda r: (r["lang"], r["rank"], r["id"] or "")):
        kept[r["lang"]] = kept.get(r["lang"], 0) + 1
        if kept[r["lang"]] <= each:
            use.append(r)
    use.sort(key=lambda r: (r["rank"], r["id"] or "", r["lang"]))
    x = np.stack([np.frombuffer(r["x"], dtype=np.float16) for r in use]).astype(np.float32)
    return Model(x, np.array([r["lang"] for r in use], dtype=object))


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score, under ``names`` (columns of these names are replaced)."""
    small_batches(docs.sparkSession)

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = model.predict(list(texts))
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    udf = F.pandas_udf(found, "lang_pred string, score double")
    keep = [c for c in docs.columns if c not in names]
    return docs.select(*keep, udf(text_col).alias("__found")).select(*keep, F.col("__found.lang_pred").alias(names[0]), F.col("__found.score").alias(names[1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    model = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a language that was learned: ``und`` goes, and what is strange to all languages (score 0)."""
    model = fit(docs.where(remainder("doc_id", 3) != 1))
    found = predict(docs, model, names=("__lang_pred", "__score"))
    return found.where((F.col("__lang_pred") != UND) & (F.col("__score") > 0)).select(*docs.columns)
