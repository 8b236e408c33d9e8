"""Secret scan: patterns propose candidates, and a character convolutional network scores every one of them.

The base kinds ``assign``, ``access`` and ``hex`` are fixed patterns, and what they match is always kept, with the
network's probability as its score. Further candidates (``pem``, ``jwt``, ``url``, ``generic``) are kept when the network
gives at least the threshold that keeps ``recall`` of the calibration positives. It reads the whole candidate, of any
length, and its surroundings, whose characters have embeddings of their own. Only what lies wholly inside a kept span is
dropped; spans that overlap in part are both given.

The network is trained on labelled findings drawn by a seeded generator (``labelled``): keys, passwords and tokens in
code, configuration and prose against words, names, paths, versions and repeated characters. Its size and the number of
findings are parameters; nothing of the corpus is needed for training. Tests train without some kinds of secret and
measure recall and precision on those.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated rows; an empty table gives
none; texts of any length are scanned whole; columns other than the two named are not read.
"""

from __future__ import annotations

import functools
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

KINDS = ("assign", "access", "hex", "pem", "jwt", "url", "generic")
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
GENERIC = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]+:[^\s/@]{3,}@")
#: One of these is in every text in which ASSIGN can match, once ASCII letters are small.
CUES = ("passw", "secret", "token", "api_key", "apikey")

#: Characters before and behind a candidate that the network reads with it, and those of one window of its convolution.
LEFT, RIGHT, WIDTH = 24, 8, 72
FINDINGS, RECALL = 4000, 0.99


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, each leftmost and without overlaps within its kind."""
    found = []
    small = text.lower()
    if any(cue in small for cue in CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    for run in RUN.finditer(text):  # a run of 24 hex digits lies in one of these
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end())]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further (start, kind, end) that do not lie wholly in a span of ``base``."""
    found = []
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), 3, m.end()) for m in PEM.finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), 4, m.end()) for m in JWT.finditer(text)]
    if "://" in text:
        found += [(m.start(), 5, m.end()) for m in URL.finditer(text)]
    found += [(m.start(), 6, m.end()) for m in GENERIC.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return outside(found, base)


def outside(found: list, spans: list) -> list:
    """Of ``found`` (start, kind, end, ...), in order, what does not lie wholly in one of ``spans``."""
    out, ends, i, reach = [], sorted((s[0], s[2]) for s in spans), 0, -1
    for x in sorted(found):
        while i < len(ends) and ends[i][0] <= x[0]:
            reach, i = max(reach, ends[i][1]), i + 1
        if x[2] > reach:
            out.append(x)
    return out


def kept(more: list[tuple[int, int, int]], p, threshold: float) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score) of the candidates that the network keeps, without those inside one of an earlier kind."""
    out: list[tuple[int, int, int, float]] = []
    passed = [(*x, float(q)) for x, q in zip(more, p) if q >= threshold]
    for kind in sorted({x[1] for x in passed}):
        out += outside([x for x in passed if x[1] == kind], out)
    return out


def view(text: str, start: int, end: int) -> np.ndarray:
    """What the network sees: codes of the text before, the candidate and the text behind; the surroundings' lie 128 higher."""
    lead = max(0, start - LEFT)
    flat = np.frombuffer(text[lead : end + RIGHT].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.where(flat < 127, flat, 127).astype(np.int64)
    code[: start - lead] += 128
    code[end - lead :] += 128
    return code


def windows(views: list[np.ndarray], overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All views cut into rows of ``WIDTH`` codes that overlap so that none of the convolution's places is lost: rows, their lengths, and each view's first row."""
    rows, size, first = [], [], []
    for v in views:
        first.append(len(rows))
        for at in range(0, max(1, len(v) - overlap), WIDTH - overlap):
            part = v[at : at + WIDTH]
            rows.append(np.pad(part, (0, WIDTH - len(part))))
            size.append(len(part))
    return np.stack(rows), np.array(size), np.array(first)


class CharCNN:
    """Embedding, one convolution with ReLU, maximum over positions, logistic output; Adam on the log loss."""

    def __init__(self, filters: int = 24, width: int = 5, dim: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.width, self.dim = width, dim
        self.p = {
            "e": rng.normal(0, 0.3, (256, dim)), "w": rng.normal(0, 0.2, (width * dim, filters)), "b": np.zeros(filters),
            "u": rng.normal(0, 0.3, filters), "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, views: list[np.ndarray]):
        """Of each view: the codes under each filter's best place, that place's activation, and the margin."""
        x, size, first = windows(views, self.width - 1)
        cols = np.lib.stride_tricks.sliding_window_view(x, self.width, axis=1)
        n, places, _ = cols.shape
        act = np.zeros((n, places, self.p["w"].shape[1]))
        for k in range(self.width):  # a code's part in each filter, looked up place by place
            act += (self.p["e"] @ self.p["w"][k * self.dim : (k + 1) * self.dim])[cols[:, :, k]]
        act += self.p["b"]
        act[np.arange(places)[None] > np.maximum(size - self.width, 0)[:, None]] = -np.inf
        at = act.argmax(1)
        top = np.take_along_axis(act, at[:, None, :], 1)[:, 0]
        best = np.maximum.reduceat(top, first, axis=0)
        row = np.repeat(np.arange(len(views)), np.diff(np.append(first, n)))
        hit = np.where(top == best[row], np.arange(n)[:, None], n)
        hit = np.minimum.reduceat(hit, first, axis=0)  # the row that holds the best place
        codes = cols[hit, np.take_along_axis(at, hit, 0)]  # views, filters, width
        hidden = np.maximum(best, 0)
        return codes, best, hidden, hidden @ self.p["u"] + self.p["c"][0]

    def margin(self, views: list[np.ndarray]) -> np.ndarray:
        """In lots of some length, so that neither many candidates nor a long one take much room."""
        out, lot, size = [], [], 0
        for v in views:
            lot.append(v)
            size += len(v) + WIDTH
            if size > 1 << 15:
                out.append(self._forward(lot)[-1])
                lot, size = [], 0
        return np.concatenate([*out, self._forward(lot)[-1]] if lot else out) if len(views) else np.zeros(0)

    def fit(self, views: list[np.ndarray], y: np.ndarray, epochs: int = 6, rate: float = 0.01, batch: int = 64) -> CharCNN:
        rng, t = np.random.default_rng(1), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(views))
            for i in range(0, len(views), batch):
                part = order[i : i + batch]
                codes, best, hidden, z = self._forward([views[j] for j in part])
                d = (1 / (1 + np.exp(-z)) - y[part]) / len(part)
                d_top = np.outer(d, self.p["u"]) * (best > 0)
                seen = self.p["e"][codes].reshape(*codes.shape[:2], -1)  # views, filters, width * dim
                g = {"u": hidden.T @ d, "c": d.sum(keepdims=True), "b": d_top.sum(0), "w": np.einsum("nf,nfk->kf", d_top, seen)}
                g["e"] = np.zeros_like(self.p["e"])
                np.add.at(g["e"], codes.ravel(), (d_top[:, :, None] * self.p["w"].T[None]).reshape(-1, self.dim))
                t += 1
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] ** 2 - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def calibrate(self, views: list[np.ndarray], y: np.ndarray, recall: float) -> CharCNN:
        """Platt scaling, then the largest threshold that keeps ``recall`` of the positives."""
        z = self.margin(views)
        a, b = 1.0, 0.0
        for _ in range(200):
            d = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - y
            a, b = a - 0.05 * float((d * z).mean()), b - 0.05 * float(d.mean())
        self.scale, self.shift = a, b
        self.threshold = float(np.quantile(self.probability([v for v, k in zip(views, y) if k > 0]), 1 - recall, method="lower"))
        return self

    def probability(self, views: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(views) + self.shift, -30, 30)))


SECRETS = ("alnum", "base64", "hex", "prefixed", "jwt", "url", "pem", "assigned", "access")


def labelled(n: int, seed: int, kinds: tuple[str, ...] = SECRETS) -> tuple[list[np.ndarray], np.ndarray]:
    """Findings as the network sees them, with 1 for a secret (of one of ``kinds``) and 0 for none."""
    r = random.Random(seed)
    alnum, hexd = string.ascii_letters + string.digits, "0123456789abcdef"
    some = lambda chars, low, high: "".join(r.choice(chars) for _ in range(r.randint(low, high)))
    word = lambda: some(string.ascii_lowercase, 2, 9)
    prose = lambda k: " ".join(word() for _ in range(k))
    name = lambda: r.choice(["password", "passwd", "secret", "token", "api_key", "apikey"]) + r.choice(["=", ": ", ' = "'])
    secret = {
        "alnum": lambda: some(alnum, 16, 48), "base64": lambda: some(alnum + "+/", 28, 64) + "=" * r.randint(0, 2), "hex": lambda: some(hexd, 24, 64),
        "prefixed": lambda: r.choice(["sk_live_", "ghp_", "xoxb-", "glpat-", "AIza"]) + some(alnum, 20, 40),
        "jwt": lambda: "eyJ" + some(alnum, 12, 30) + "." + some(alnum, 12, 40) + "." + some(alnum + "_-", 20, 43),
        "url": lambda: f"{r.choice(['postgres', 'https', 'mysql', 'amqp'])}://{word()}:{some(alnum + '!$', 6, 20)}@", "pem": lambda: "-----BEGIN RSA PRIVATE KEY-----" + some(alnum + "+/", 64, 900),
        "assigned": lambda: name() + some(alnum, 6, 30), "access": lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16, 16),
    }
    plain = [
        lambda: "-".join([word(), str(r.randint(1, 99)), word(), word(), word()]), lambda: "/".join([word() for _ in range(4)] + [f"v{r.randint(1, 20)}"]),
        lambda: "_".join([word() for _ in range(4)] + [str(r.randint(0, 2030))]), lambda: r.choice("=-_") * r.randint(20, 60) + str(r.randint(0, 9)) + word(),
        lambda: word() * r.randint(4, 7) + str(r.randint(1, 999)), lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}-{word()}-{word()}-{word()}",
        lambda: f"{word()}://{word()}:{r.randint(1, 9999)}@", lambda: "".join(word().title() for _ in range(4)) + str(r.randint(1, 99)), lambda: name() + r.choice(["required", "missing", "optional", "changed"]),
    ]
    keyed = lambda: r.choice(["key", "auth", "bearer", "credential", "secret", "pwd", "access"]) + r.choice(["=", ": ", ' = "', " "])
    views, y = [], []
    for i in range(n):
        body = secret[r.choice(kinds)]() if i % 2 else r.choice(plain)()
        before = prose(r.randint(0, 8)) + " " + (keyed() if r.random() < (0.4 if i % 2 else 0.1) else "")
        text = f"{before}{body} {prose(2)}"
        views.append(view(text, len(before), len(before) + len(body)))
        y.append(i % 2)
    return views, np.array(y, dtype=float)


@functools.lru_cache(maxsize=4)
def trained(findings: int = FINDINGS, recall: float = RECALL, kinds: tuple[str, ...] = SECRETS) -> CharCNN:
    return CharCNN().fit(*labelled(findings, 1, kinds)).calibrate(*labelled(findings // 4, 2, kinds), recall)


def found_in(texts: list[str], model: CharCNN) -> tuple[list[list[tuple[int, int, int, float]]], list[int]]:
    """For each text its (start, kind, end, score) in order, and how many candidates the network scored."""
    base = [base_spans(t) if t else [] for t in texts]
    more = [candidates(t, b) if t else [] for t, b in zip(texts, base)]
    p, at, out = model.probability([view(t, s, e) for t, b, m in zip(texts, base, more) for s, _, e in b + m]), 0, []
    for b, m in zip(base, more):
        own = [(*x, float(q)) for x, q in zip(b, p[at : at + len(b)])]
        at += len(b)
        out.append(sorted(own + kept(m, p[at : at + len(m)], model.threshold)))
        at += len(m)
    return out, [len(b) + len(m) for b, m in zip(base, more)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: CharCNN | None = None) -> DataFrame:
    """One row for each row of ``docs``: the id, the text, ``found`` array<struct<kind,start,end,score>> in order, and ``n_scored``, the candidates that the network scored."""
    small_batches(docs.sparkSession)
    model = model or trained()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found, scored = found_in(list(texts), model)
            yield pd.DataFrame({"found": [[{"kind": KINDS[k], "start": s, "end": e, "score": q} for s, k, e, q in x] for x in found], "n_scored": scored})

    found = F.pandas_udf(spans, "found array<struct<kind:string,start:int,end:int,score:double>>, n_scored long")
    return rows.select("id", "text", found("text").alias("s")).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "s.found", "s.n_scored")


def joined(found, base: bool):
    some = F.filter(found, lambda x: x["kind"].isin(*KINDS[:3])) if base else found
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined(F.col("found"), True), 256).alias("base_sha256"), joined(F.col("found"), False).alias("spans"), "n_scored")


def redact(text: str | None, found: list | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, and spans that overlap taken together, replaced by ``mark``."""
    if text is None or found is None or not len(found):
        return text
    out, at = [], 0
    for s in sorted(found, key=lambda x: x["start"]):
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def cleaned(texts: list[str | None], model: CharCNN) -> list[str | None]:
    found, _ = found_in([t or "" for t in texts], model)
    return [redact(t, [{"start": s, "end": e} for s, _, e, _ in x]) for t, x in zip(texts, found)]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets replaced; none is dropped, ``n_chars`` follows the new text."""
    small_batches(spark)
    model, schema = trained(), docs.schema

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(cleaned(list(texts), model), dtype=object)

    found = docs.withColumn("text", F.pandas_udf(clean, "string")("text"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(schema["n_chars"].dataType)))
    return found.select(*docs.columns)
