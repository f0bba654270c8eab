"""Secret scans: patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order Markov chains over characters are trained from labelled samples, one of random strings (keys,
digests, base64) and one of ordinary identifiers. A string of at least ``min_chars`` characters whose log-likelihood
ratio is at least ``min_ratio`` in all and ``min_mean`` per character, with 8 or more different characters, is a
secret, of kind markov. Three kinds of patterns (assign, access, hex) always count; what they leave over of a run of
key characters is scored by itself. A run that does not reach the means as a whole is searched for the stretches that
do (a key behind its name, the last part of an address); a stretch is reported by whole words between ``= / + _ -``,
those at its ends if it has half of them. All positions are code points, ends exclusive.

Texts are searched as UTF-8 bytes in one narrow pass: a pattern runs only where a fixed part of it occurs.

Defined cases: null or empty texts have no spans; spans of equal start are in the order of their kinds; repeated rows
give equal rows; an empty table gives an empty result; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .kernel import fixed_randoms

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(rb"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_NEEDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{32,}")
RUN = rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
MARKS = b"=/+_-"
DROP = 8.0  # a stretch ends where its sum falls by this much

_ALPHABET = np.full(256, 66, dtype=np.int64)
for _i, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"):
    _ALPHABET[_c] = _i
STATES = 68  # the characters, all others, and the beginning


def default_samples(n: int = 4000) -> list[tuple[str, int]]:
    """Labelled samples by rule: (token, 1) random, (token, 0) ordinary."""
    draw = iter((fixed_randoms(31, 80 * n) >> np.uint64(11)).tolist())
    hexes, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    onset, vowel = "b c d f g h j k l m n p q r s t v w z st tr ch th pr sch ll gu".split(), "a e i o u ai ea ou ei ie eau".split()
    coda = ["", "", "n", "r", "s", "t", "l", "ng", "nt", "ck", "ed", "er", "ch", "tz", "ung", "keit", "heit", "tion", "lich"]
    out = []
    for i in range(n):
        kind = i % 4
        abc = (hexes, b64, b64 + "+/", b64[:26] + b64[52:])[kind]
        out.append(("".join(abc[next(draw) % len(abc)] for _ in range(20 + next(draw) % 25)), 1))
        parts = ["".join((onset[next(draw) % len(onset)], vowel[next(draw) % len(vowel)], coda[next(draw) % len(coda)])) for _ in range(4 + next(draw) % 5)]
        words = ["".join(parts[j : j + 2]) for j in range(0, len(parts), 2)]
        year = str(1990 + next(draw) % 40)
        out.append((("".join(words), "_".join(words), words[0] + "".join(w.title() for w in words[1:]), "-".join([*words, year]), "/".join(words), "_".join(words).upper(), "".join(w.title() for w in words) + year[2:])[i % 7], 0))
    return out


class Markov:
    """Log-likelihood ratios of character steps: random over ordinary."""

    def __init__(self, samples: list[tuple[str, int]], add: float = 0.5):
        counts = np.full((2, STATES, STATES), add)
        for token, label in samples:
            c = _ALPHABET[np.frombuffer(token.encode(), np.uint8)]
            np.add.at(counts[int(label)], (np.r_[STATES - 1, c[:-1]], c), 1)
        logs = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.ratio = logs[1] - logs[0]

    def steps(self, token: bytes) -> np.ndarray:
        c = _ALPHABET[np.frombuffer(token, np.uint8)]
        return self.ratio[np.r_[STATES - 1, c[:-1]], c]

    def score(self, token: bytes) -> float:
        return float(self.steps(token).sum())


def _union(base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Beginnings and ends of the places that spans cover, in order and apart."""
    starts, ends = [], []
    for x, _, y in sorted(base):
        if ends and x <= ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x)
            ends.append(y)
    return starts, ends


def _free(a: int, b: int, union: tuple[list[int], list[int]]) -> list[tuple[int, int]]:
    """The parts of a..b outside of a union of spans."""
    starts, ends = union
    out, k = [], bisect.bisect_right(ends, a)
    while k < len(starts) and starts[k] < b:
        out.append((a, starts[k]))
        a = ends[k]
        k += 1
    return [(x, y) for x, y in [*out, (a, b)] if x < y]


def _stretches(x: np.ndarray, least: int) -> list[tuple[int, int]]:
    """From left to right stretches of at least ``least`` values with a sum of 0 or more, each grown to its largest sum.
    One is found wherever there is any."""
    pre = np.r_[0.0, np.cumsum(x)]
    if len(x) < least or (pre[least:] - np.minimum.accumulate(pre[:-least])).max() < 0:
        return []
    pre, out, low, j = pre.tolist(), [], 0, least
    while j < len(pre):
        if pre[j - least] < pre[low]:
            low = j - least
        if pre[j] < pre[low]:
            j += 1
            continue
        end = k = j
        while k + 1 < len(pre) and pre[k] >= max(pre[low], pre[end] - DROP):
            k += 1
            if pre[k] >= pre[end]:
                end = k
        out.append((min(range(low, end - least + 1), key=pre.__getitem__), end))
        low, j = end, end + least
    return out


def _whole_words(own: bytes, a: int, b: int, done: int, least: int) -> tuple[int, int]:
    """a..b as far as the marks around it, or without a first or last word of which it has less than half."""
    left, right = a, b
    while left > done and own[left - 1] not in MARKS:
        left -= 1
    while right < len(own) and own[right] not in MARKS:
        right += 1
    first = next((i for i in range(a, b) if own[i] in MARKS), b)
    last = next((i for i in range(b, a, -1) if own[i - 1] in MARKS), a)
    new_a = first + 1 if 2 * (first - a) < first - left and b - first > least else left
    new_b = last - 1 if 2 * (b - last) < right - last and last - 1 - new_a >= least else right
    return new_a, new_b


def _random(own: bytes, model: Markov, min_ratio: float, min_mean: float, min_chars: int) -> list[tuple[int, int]]:
    """The places in a run of key characters that are random strings."""
    if len(own) < min_chars or len(set(own)) < 8:
        return []
    x = model.steps(own)
    if x.sum() >= max(min_ratio, min_mean * len(own)):
        return [(0, len(own))]
    out, done = [], 0
    for a, b in _stretches(x - min_mean, min_chars):
        if x[a:b].sum() >= min_ratio and len(set(own[a:b])) >= 8 and b > done:
            a, b = _whole_words(own, max(a, done), b, done, min_chars)
            out.append((a, b))
            done = b
    return out


def find(text: bytes, model: Markov | None, min_ratio: float = 12.0, min_mean: float = 0.8, min_chars: int = 16) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a text in bytes, in order."""
    out = []
    low = text.lower()
    if any(x in low for x in ASSIGN_NEEDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if model:
        base = _union(out)
        for m in re.finditer(RUN % min_chars, text):
            for a, b in _free(m.start(), m.end(), base):
                out += [(a + x, 3, a + y) for x, y in _random(text[a:b], model, min_ratio, min_mean, min_chars)]
    return sorted(out)


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if text.isascii() or not spans:
        return spans
    own = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    at = lambda i: int(own[i - 1]) if i else 0
    return [(at(a), k, at(b)) for a, k, b in spans]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


COLUMNS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"


def scan(spark: SparkSession, docs: DataFrame, samples: DataFrame | None = None, min_ratio: float = 12.0, min_mean: float = 0.8, min_chars: int = 16, max_samples: int = 100_000) -> DataFrame:
    """doc_id and its spans. samples: labelled (token, label 0/1) to train from, of which the first max_samples in order
    of their hash are taken; without it, samples made by rule."""
    if samples is None:
        labelled = default_samples()
    else:
        some = samples.where("token is not null and label is not null").orderBy(F.xxhash64("token"), "token", "label").limit(max_samples)
        labelled = [(r["token"], r["label"]) for r in some.collect()]
    shared = spark.sparkContext.broadcast(Markov(labelled) if labelled else None)

    def run(batches):
        model = shared.value
        for b in batches:
            cols = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                spans = _points(text, find(text, model, min_ratio, min_mean, min_chars)) if text else []
                base = [s for s in spans if s[1] < 3]
                for k in range(3):
                    cols[k].append(sum(s[1] == k for s in base))
                cols[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                cols[4].append(_joined(spans))
                cols[5].append(len(spans) - len(base))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", *(x.split()[0] for x in COLUMNS.split(", "))])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, f"doc_id long, {COLUMNS}")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))
