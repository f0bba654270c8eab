"""Language identification by unigrams over a fixed vocabulary, summed over all segmentations.

A text, lower-cased, is cut into runs of letters and digits and runs of other characters, white space apart, which are called
words here, each with a space before it. In a language every piece of the vocabulary has a probability, and a word's is the sum, over all ways to write its bytes as pieces, of the products of the
pieces' probabilities. A forward pass over the word's bytes sums all of them; words of equal length go through it
together as rows of byte matrices, each distinct word of a task once. A text's likelihood is the product over its words
and a language's share; the language of the largest posterior is predicted, its posterior is the score.

The vocabulary is a public byte-level one, read from ``vocabulary`` (a file of base64 pieces with ranks) and never
trained or changed. Probabilities are learned by expectation and maximisation: expected uses of each piece over all
segmentations (forward and backward), counted per language over the distinct words of at most ``max_rows`` training
documents: those whose hash of doc_id and text begins with enough zero bits for them to be no more, so at least about half as many
where there are. Tables of words stay with Spark; only pieces x languages numbers come to the driver.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a very long text is read whole, its words
scored one batch after another; a long word is as many steps as it has bytes; languages that tie go to the smaller name;
training rows with a null text or lang teach nothing; repeated rows teach and are judged each; with nothing to
learn from, every text is ``und``; an empty table gives an empty result; other columns are ignored. Over ``max_langs``
languages among the training rows raise an error.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Work, table

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BASE = np.uint64(0x100000001B3)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
PLAIN = 30  # bytes whose product of least probabilities (LEAST each) is still a double
LEAST = 1e-10
CELLS = 2_000_000  # bytes x languages that are worked on at once
LONGEST = 4096  # bytes of a word that goes through the batches of equal lengths; longer ones go alone


class Vocabulary:
    """Byte pieces behind an open-addressing table of their hashes."""

    def __init__(self, pieces: list[bytes], slots_power: int = 20):
        self.pieces, self.power = pieces, slots_power
        self.longest = max(map(len, pieces))
        size = 1 << slots_power
        self.keys, self.ids = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        for i, piece in enumerate(pieces):
            h = 0
            for b in piece:
                h = (h * int(BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
            at = ((h * int(SPREAD)) & 0xFFFFFFFFFFFFFFFF) >> (64 - slots_power)
            while self.ids[at] >= 0:
                if self.keys[at] == h:
                    raise ValueError("two pieces of one hash")
                at = (at + 1) % size
            self.keys[at], self.ids[at] = h, i
        self.steps = 1 + max(self._run_lengths(), default=0)
        self.size_of = np.array([len(p) for p in pieces], np.int32)

    def _run_lengths(self):
        run = 0
        for used in np.r_[self.ids, self.ids[:1024]] >= 0:
            run = run + 1 if used else 0
            yield run

    def find(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes, each of ``length`` bytes, are pieces, and their numbers."""
        at = (h * SPREAD) >> np.uint64(64 - self.power)
        todo = np.flatnonzero(self.ids[at] >= 0)  # few slots are taken, so most are done here
        at, rows, found = at[todo], [], []
        for _ in range(self.steps):
            ids = self.ids[at]
            same = (ids >= 0) & (self.keys[at] == h[todo])
            fits = same.copy()
            fits[same] = self.size_of[ids[same]] == length
            rows.append(todo[fits])
            found.append(ids[fits])
            go = (ids >= 0) & ~same
            if not go.any():
                break
            todo, at = todo[go], (at[go] + np.uint64(1)) % np.uint64(len(self.ids))
        return np.concatenate(rows), np.concatenate(found)


def read_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Pieces that a word with its space before it may hold: white space only at a piece's beginning."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return Vocabulary([p for p in pieces if p and not any(b in b" \t\n\r\x0b\x0c" for b in p[1:])])


def _hits(words: np.ndarray, vocabulary: Vocabulary):
    """(start, end, rows, pieces) for every span of the words' columns that is a piece for some row; by end, then start."""
    n, length = words.shape
    prefix = np.zeros((length + 1, n), np.uint64)
    power = np.array([pow(int(BASE), i, 1 << 64) for i in range(vocabulary.longest + 1)], np.uint64)
    for i in range(length):
        prefix[i + 1] = prefix[i] * BASE + words[:, i].astype(np.uint64) + np.uint64(1)
    for end in range(1, length + 1):
        for start in range(max(0, end - vocabulary.longest), end):
            rows, ids = vocabulary.find(prefix[end] - prefix[start] * power[end - start], end - start)
            if len(rows):
                yield start, end, rows, ids


def forward(words: np.ndarray, vocabulary: Vocabulary, probs: np.ndarray, keep: bool = False):
    """Log-probabilities (rows x languages) of byte matrices under probs (pieces x languages): level by level, the sum over
    all pieces that end there. keep: those of all beginnings too, and the hits, for the backward pass."""
    n, length = words.shape
    logs = np.zeros((length + 1, n, probs.shape[1]))
    ends: dict[int, list] = {}
    for start, end, rows, ids in _hits(words, vocabulary):
        ends.setdefault(end, []).append((start, rows, ids))
    for end in range(1, length + 1):
        own = ends.get(end, [])
        # the largest term decides the scale, so that neither long words nor long pieces overflow or vanish
        level = np.full((n, probs.shape[1]), -np.inf)
        for start, rows, _ in own:
            level[rows] = np.maximum(level[rows], logs[start][rows])
        total = np.zeros((n, probs.shape[1]))
        for start, rows, ids in own:
            total[rows] += np.exp(logs[start][rows] - level[rows]) * probs[ids]
        logs[end] = level + np.log(total)
    return (logs, ends) if keep else logs[length]


def expected(words: np.ndarray, weights: np.ndarray, vocabulary: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in the words, each as often as weights (rows x languages) say, over all segmentations."""
    logs, ends = forward(words, vocabulary, probs, keep=True)
    passed = np.zeros_like(logs)  # how often a segmentation has a cut at a place
    passed[-1] = weights
    out = np.zeros_like(probs)
    for end in range(words.shape[1], 0, -1):
        for start, rows, ids in ends.get(end, []):
            uses = passed[end][rows] * np.exp(logs[start][rows] - logs[end][rows]) * probs[ids]
            np.add.at(out, ids, uses)
            passed[start][rows] += uses
    return out


def by_length(words: list[bytes], most_cells: int = 1 << 20):
    """(numbers, matrix) of words of equal length, in blocks of a bounded number of bytes."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for length in np.unique(lengths):
        own = order[np.searchsorted(lengths[order], length) : np.searchsorted(lengths[order], length, "right")]
        step = max(1, most_cells // (int(length) * 16))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            yield part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), int(length))


RUN = re.compile(r"\w+|[^\w\s]+")


def runs(text: str) -> list[str]:
    """The runs of a text, lower-cased."""
    return RUN.findall(text.lower())


def _bytes(word: str) -> bytes:
    return b" " + word.encode("utf-8", "replace")


def long_forward(word: bytes, vocabulary: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """The same for one very long word: pieces are looked up at all places at once, sums follow byte by byte."""
    w = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
    h, found = np.zeros(len(w), np.uint64), []
    for length in range(1, min(vocabulary.longest, len(w)) + 1):
        h = h[: len(w) - length + 1] * BASE + w[length - 1 :]
        at, ids = vocabulary.find(h, length)
        found.append(np.stack([at + length, at, ids]))
    found = np.concatenate(found, 1)
    found = found[:, np.argsort(found[0], kind="stable")]
    cuts = np.searchsorted(found[0], np.arange(1, len(w) + 2))
    logs = np.zeros((len(w) + 1, probs.shape[1]))
    for end in range(1, len(w) + 1):
        own = found[1:, cuts[end - 1] : cuts[end]]
        terms = logs[own[0]]
        level = terms.max(0)
        logs[end] = level + np.log((np.exp(terms - level) * probs[own[1]]).sum(0))
    return logs[-1]


def plain_forward(words: list[bytes], vocabulary: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """The same for words of at most PLAIN bytes, whatever their lengths, all together: their probabilities are numbers that a double
    holds. Pieces are looked up by length at all places, and sums go on by distance from the word's beginning."""
    sizes = np.array([len(w) for w in words])
    first = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), sizes)
    offset = np.arange(len(text)) - first[owner]
    left = sizes[owner] - offset
    at, h, found = np.arange(len(text)), np.zeros(len(text), np.uint64), []
    for length in range(1, vocabulary.longest + 1):
        go = left[at] >= length
        at = at[go]
        if not len(at):
            break
        h = h[go] * BASE + text[at + length - 1]
        rows, ids = vocabulary.find(h, length)
        found.append(np.stack([at[rows], np.full(len(rows), length), ids]))
    start, length, ids = np.concatenate(found, 1)
    step = (offset[start] + length) * 64 + length  # within a step, every word has one end
    order = np.argsort(step, kind="stable")
    start, length, ids, step = start[order], length[order], ids[order], step[order]
    cell = start + owner[start]  # a word has a cell more than bytes
    sums = np.zeros((len(text) + len(words), probs.shape[1]))
    sums[first + np.arange(len(words))] = 1.0
    edges = np.flatnonzero(np.diff(step, prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:]):
        sums[cell[a:b] + length[a:b]] += sums[cell[a:b]] * probs[ids[a:b]]
    return np.log(sums[first + sizes + np.arange(len(words))])


def scores(words: list[bytes], vocabulary: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """Log-probabilities (words x languages)."""
    out = np.zeros((len(words), probs.shape[1]))
    sizes = np.array([len(w) for w in words])
    plain = np.flatnonzero(sizes <= PLAIN)
    ends = np.cumsum(sizes[plain]) * probs.shape[1] // CELLS
    for part in np.split(plain, np.flatnonzero(np.diff(ends)) + 1) if len(plain) else ():
        out[part] = plain_forward([words[i] for i in part], vocabulary, probs)
    longer = np.flatnonzero((sizes > PLAIN) & (sizes <= LONGEST))
    for part, matrix in by_length([words[i] for i in longer]) if len(longer) else ():
        out[longer[part]] = forward(matrix, vocabulary, probs)
    for i in np.flatnonzero(sizes > LONGEST):
        out[i] = long_forward(words[i], vocabulary, probs)
    return out


def crc_mod4(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % 4


def zero_bits(h: Column) -> Column:
    """How many zero bits a hash begins with, of its last 40."""
    low = F.pmod(h, F.lit(1 << 40))
    return F.when(low == 0, 40).otherwise(39 - F.floor(F.log2(low.cast("double")))).cast("int")


class Model:
    """langs in order, their shares, and probs (pieces x languages)."""

    def __init__(self, vocabulary: Vocabulary, langs: list[str], shares: np.ndarray, probs: np.ndarray):
        self.vocabulary, self.langs, self.shares, self.probs = vocabulary, langs, shares, probs


def learn(spark: SparkSession, rows: DataFrame, path: str = VOCABULARY, max_rows: int = 20_000, max_langs: int = 1_000, rounds: int = 3, smoothing: float = 0.05) -> Model:
    """A model of rows (doc_id, text, lang): those with both are learned from, at most max_rows of them."""
    vocabulary, work = read_vocabulary(path), Work(spark, "languages")
    rows = rows.where("text is not null and lang is not null").select("text", "lang", zero_bits(F.xxhash64("doc_id", "text")).alias("_z"))
    least, some = 0, 0
    for r in sorted(rows.groupBy("_z").count().collect(), key=lambda r: -r["_z"]):
        some += r["count"]
        if some > max_rows:
            least = r["_z"] + 1
            break
    sample = work.save(rows.where(F.col("_z") >= least).select("text", "lang"), "sample")
    counts = sample.groupBy("lang").count().orderBy("lang").limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"over {max_langs} languages: raise max_langs")
    langs, shares = [r["lang"] for r in counts], np.array([r["count"] for r in counts], float)
    if not langs:
        return Model(vocabulary, [], shares, np.zeros((len(vocabulary.pieces), 0)))
    number = {x: i for i, x in enumerate(langs)}

    def cut(batches):
        for b in batches:
            words, owners = [], []
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                own = runs(text)
                words += own
                owners += [lang] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(words, pa.string())], ["lang", "word"])

    words = work.save(sample.repartition(max(8, spark.sparkContext.defaultParallelism)).mapInArrow(cut, "lang string, word string").groupBy("word", "lang").count(), "words")
    probs = np.full((len(vocabulary.pieces), len(langs)), 1.0 / len(vocabulary.pieces))
    held = spark.sparkContext.broadcast(vocabulary)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(probs)

        def step(batches, held=held, now=now):
            v, total, seen = held.value, np.zeros_like(now.value), False
            for b in batches:
                own = [_bytes(w) for w in b.column("word").to_pylist()]
                # a word longer than this says little about pieces
                take = np.array([i for i, w in enumerate(own) if len(w) <= 256], np.int64)
                weights = np.zeros((len(own), len(langs)))
                weights[np.arange(len(own)), [number[x] for x in b.column("lang").to_pylist()]] = b.column("count").to_numpy()
                for part, matrix in by_length([own[i] for i in take]) if len(take) else ():
                    total += expected(matrix, weights[take[part]], v, now.value)
                    seen = True
            if seen:
                flat = total.reshape(-1)
                at = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], ["at", "v"])

        found = words.mapInArrow(step, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        uses = np.zeros(probs.size)
        uses[found["at"].to_numpy()] = found["v"].to_numpy()
        uses = uses.reshape(probs.shape) + smoothing
        probs = np.maximum(uses / uses.sum(0), LEAST)
        now.unpersist()
    held.unpersist()
    return Model(vocabulary, langs, shares / shares.sum(), probs)


def predict(docs: DataFrame, model: Model, columns: list[str] | None = None, most_words: int = 400_000) -> DataFrame:
    """docs (its columns, or those named) and lang_pred, score. Columns of those names are replaced. most_words: of how many
    distinct words a task keeps the scores at most."""
    rest = [c for c in columns or docs.columns if c not in ("lang_pred", "score")]
    packed = docs.select(F.struct(*rest).alias("_row"), F.col("text").alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_judged"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        prior = np.log(m.shares)
        place: dict[str, int] = {}
        table_ = np.zeros((0, len(m.langs)))

        def look_up(own: list[str]) -> np.ndarray:
            nonlocal table_
            new = [w for w in dict.fromkeys(own) if w not in place]
            if new:
                if len(place) + len(new) > most_words:
                    place.clear()
                    table_ = table_[:0]
                    new = list(dict.fromkeys(own))
                place.update(zip(new, range(len(place), len(place) + len(new))))
                table_ = np.concatenate([table_, scores([_bytes(w) for w in new], m.vocabulary, m.probs)])
            return np.fromiter(map(place.__getitem__, own), np.int64, len(own))

        def totals(texts: list[list[str]]) -> np.ndarray:
            own = [w for t in texts for w in t]
            sizes = np.array([len(t) for t in texts])
            each = np.repeat(np.arange(len(texts)), sizes)
            out = np.zeros((len(texts), len(m.langs)))
            for at in range(0, len(own), most_words):
                ids = look_up(own[at : at + most_words])
                part = each[at : at + most_words]
                for k in range(len(m.langs)):
                    out[:, k] += np.bincount(part, table_[ids, k], len(texts))
            return out

        for b in batches:
            judged, texts = b.column("_judged").to_pylist(), b.column("_text").to_pylist()
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            group, size = [], 0
            for i in [*range(len(texts)), None]:
                if group and (i is None or size > most_words):
                    logs = totals([x[1] for x in group]) + prior
                    best = logs.argmax(1)
                    share = 1.0 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                    for (row, _), k, s in zip(group, best, share):
                        pred[row], score[row] = m.langs[k], float(s)
                    group, size = [], 0
                if i is not None and judged[i] and m.langs:
                    group.append((i, runs(texts[i])))
                    size += len(group[-1][1])
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["_row", "lang_pred", "score"])

    out = packed.mapInArrow(run, f"_row {packed.schema['_row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in rest], "lang_pred", "score")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(crc_mod4(F.col("doc_id")) == 2, F.lit(False)))
    model = learn(spark, docs.where("not held_out"))
    return predict(docs, model, ["doc_id", "held_out"])
