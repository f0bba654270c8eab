"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed insult lexicon and of a lexicon of word stems learned from labels, how near
an insult stands to a second-person word, and rates of capitals, punctuation, obfuscated and drawn-out words. The
model is fitted on the driver from a bounded sample: of the labelled rows whose crc32(doc_id) mod 3 is not 1, the
first ``max_rows`` in order of a hash of doc_id. A half of them (by hash) teaches the stems, the others the trees
and, each scored by models of the other folds, the calibration; only counts of stems and the numeric features of the
sample reach the driver.
Every document is then scored in one narrow pass. Reruns on the same rows agree.

Defined cases: null and empty texts are scored like any (their features are 0); very long texts are read whole; rows
of equal hash are taken in order of doc_id; repeated documents get equal scores;
repeated labels count as toxic if any is; without labelled rows, or with labels of one class only, all scores are
that class's share (0 without any); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_mod3, table

#: Insults and words of the second person, in four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb pathetic worthless trash scum disgusting clown loser losers fool filthy vermin "
    "crap jerk bastard bitch asshole imbecile retard ugly shut hate kill "
    "idiotin dumm dummkopf trottel abschaum wertlos widerlich versager arschloch "
    "stupide crétin ordure minable débile connard salaud dégoûtant "
    "estúpido imbécil basura inútil asqueroso payaso patético perdedor".split()
)
SECOND = frozenset("you your yours yourself ur u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!", "oleastasi")
EDGE = ".,;:!?\"'()[]{}|#*%&$<>-_«»¿¡"
DRAWN = re.compile(r"(\w)\1{3,}")
STEMS = (4, 5, 6, 7)
FEATURES = 16


def stems_of(words) -> set[str]:
    return {w[:n] for w in words for n in STEMS if len(w) >= n}


def words_of(text: str) -> list[str]:
    return [w.strip(EDGE) for w in text.lower().split()]


def features(text: str, stems: dict[str, float]) -> list[float]:
    words = words_of(text)
    n = max(len(words), 1)
    chars = max(len(text), 1)
    insults = [i for i, w in enumerate(words) if w in INSULTS]
    odd = [w for w in set(words) if w and not w.isalpha() and not w.isdigit()]
    plain = {w: re.sub(r"[^\w]|_", "", w.translate(LEET)) for w in odd}
    hidden = sum(p in INSULTS and w not in INSULTS for w, p in plain.items())
    score, best, n_stem = 0.0, 0.0, 0
    if stems:
        get = stems.get
        four = stems["4"]
        for w in words:
            if w[:4] in four:
                s = max(get(w[:k], 0.0) for k in STEMS)
                if s:
                    n_stem += 1
                    score += s
                    best = max(best, s)
    second = [i for i, w in enumerate(words) if w in SECOND]
    near = _nearest(insults, second)
    letters = sum(map(str.isupper, text)) if not text.islower() else 0
    marks = text.count("!") + text.count("?")
    return [
        len(insults), 100 * len(insults) / n, len({words[i] for i in insults}), 1 / (1 + near), 100 * len(second) / n, letters / chars, 100 * marks / chars,
        100 * sum(text.count(c) for c in "#*%&$@") / chars, 100 * len(odd) / n, hidden, len(DRAWN.findall(text)) / n, n_stem, 100 * n_stem / n, score / n * 100, best, np.log1p(len(words)),
    ]


def _nearest(insults: list[int], second: list[int]) -> int:
    """The least distance between two sorted lists of places; 99 if one is empty."""
    if not insults or not second:
        return 99
    at, j = np.array(insults), np.array(second)
    k = np.searchsorted(j, at)
    return int(min(np.abs(at - j[np.maximum(k - 1, 0)]).min(), np.abs(at - j[np.minimum(k, len(j) - 1)]).min()))


class Boosted:
    """Depth-limited trees on binned features, fitted to the logistic loss; then an isotonic step function."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        for j in range(x.shape[1]):  # a rare value above 0 is cut off even where quantiles miss it
            self.cuts[j] = np.unique(np.r_[self.cuts[j], 0.0, np.quantile(x[x[:, j] > 0, j], [0.1, 0.5, 0.9]) if (x[:, j] > 0).any() else []])
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.trees, b = [], self._bin(x)
        f = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p), np.arange(len(y)), depth, least)
            self.trees.append(tree)
            f += rate * self._walk(tree, b)
        self.rate = rate
        self.steps = self.levels = None

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)

    def _grow(self, b, g, h, rows, depth, least):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = float(np.clip(total_g / (total_h + 1.0), -8, 8))
        best = (1e-6, None, None)
        if depth:
            for j, cut in enumerate(self.cuts):
                k = len(cut) + 1
                sg, sh = np.bincount(b[rows, j], g[rows], k).cumsum()[:-1], np.bincount(b[rows, j], h[rows], k).cumsum()[:-1]
                n = np.bincount(b[rows, j], minlength=k).cumsum()[:-1]
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                gain[(n < least) | (len(rows) - n < least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
        if best[1] is None:
            return leaf
        left = b[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(b, g, h, rows[left], depth - 1, least), self._grow(b, g, h, rows[~left], depth - 1, least)

    def _walk(self, tree, b: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        return np.where(b[:, tree[0]] <= tree[1], self._walk(tree[2], b), self._walk(tree[3], b))

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.base + self.rate * sum((self._walk(t, b) for t in self.trees), np.zeros(len(b)))

    @classmethod
    def calibrated(cls, x: np.ndarray, y: np.ndarray, folds: int = 5) -> Boosted:
        """Fitted to all rows, and calibrated on margins that models of the other folds give each row."""
        out, fold, f = cls(x, y), np.arange(len(y)) % folds, np.zeros(len(y))
        for k in range(folds):
            if (fold == k).any():
                f[fold == k] = cls(x[fold != k], y[fold != k]).margin(x[fold == k])
        out.calibrate(f, y)
        return out

    def calibrate(self, f: np.ndarray, y: np.ndarray) -> None:
        """Pool adjacent violators, over margins f."""
        order = np.argsort(f, kind="stable")
        f, pools = f[order], []
        for v in y[order]:
            pools.append([float(v), 1])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                s, n = pools.pop()
                pools[-1][0] += s
                pools[-1][1] += n
        self.steps = f
        self.levels = np.concatenate([np.full(n, s / n) for s, n in pools])

    def score(self, x: np.ndarray) -> np.ndarray:
        f = self.margin(x)
        if self.steps is None:
            return 1 / (1 + np.exp(-f))
        return np.clip(np.interp(f, self.steps, self.levels) + 1e-6 * np.tanh(f / 8), 0, 1)


class Model:
    def __init__(self, stems: dict, boosted: Boosted | None, share: float):
        self.stems, self.boosted, self.share = stems, boosted, share

    def score(self, texts: list[str]) -> np.ndarray:
        if self.boosted is None or not texts:
            return np.full(len(texts), self.share)
        return self.boosted.score(np.array([features(t or "", self.stems) for t in texts], dtype=float).reshape(-1, FEATURES))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_texts: int = 6) -> Model:
    """labels: (doc_id, toxic). Rows of the held-out third are never looked at."""
    known = labels.where("toxic is not null and doc_id is not null").where(crc_mod3(F.col("doc_id")) != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).withColumn("u", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(6)))
    sample = F.broadcast(known.orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(max_rows))  # bounded by max_rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id")

    def count(batches):
        for b in batches:
            seen, bad = Counter(), Counter()
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (bad if y else seen).update(stems_of(set(words_of(text))))
            keys = list(seen.keys() | bad.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], ["stem", "bad", "good"])

    counts = rows.where("u < 3").select("text", "y").mapInArrow(count, "stem string, bad long, good long")
    counts = counts.groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where((F.col("bad") >= min_texts) & (F.col("bad") > F.col("good")))
    stems: dict = {r["stem"]: float(np.log((r["bad"] + 0.5) / (r["good"] + 0.5))) for r in counts.orderBy("stem").collect()}
    stems["4"] = frozenset(s[:4] for s in stems)  # words that may have a stem at all
    shared = spark.sparkContext.broadcast(stems)

    def measure(batches):
        for b in batches:
            x = [features(t, shared.value) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "u", "x"])

    measured = rows.where("u >= 3").select("text", "doc_id", "y", "u").mapInArrow(measure, "doc_id long, y int, u long, x array<double>").collect()
    measured.sort(key=lambda r: (r["doc_id"], r["y"], r["x"]))
    y = np.array([r["y"] for r in measured], dtype=float)
    if len(set(y.tolist())) < 2:
        return Model(stems, None, float(y.mean()) if len(y) else 0.0)
    x = np.array([r["x"] for r in measured], dtype=float)
    boosted = Boosted.calibrated(x, y)
    return Model(stems, boosted, float(y.mean()))


def score(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = shared.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(spark, docs, fit(spark, docs, labels))
    return out.select("doc_id", F.coalesce(crc_mod3(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
