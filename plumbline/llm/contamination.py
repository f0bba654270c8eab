"""Benchmark decontamination with suffix arrays over the training texts.

Every batch of documents is a shard. Words of the benchmark are numbered; other words cannot be part of a match,
so a shard's suffix array holds only the suffixes that begin with enough numbered words in a row, ordered through
``width`` words. Every suffix of every benchmark item is looked up in it by binary search: the range of suffixes that
agree with it through width words gives all places, and each is followed as far as text and item agree, as the match of
an item's next suffix at the text's next word goes on with it. So matches come in their full length: a match is
reported once, from where it begins to where it ends.

``report`` gives each document's hit words, items and longest match, from matches of at least width words or of a whole
shorter item; ``decontaminate`` keeps documents without any. ``passages`` gives all matches of at least ``least`` words
with their places, ``locations`` the longest match of every suffix of an item with all of its places.

Shards are read in pieces of ``PIECE`` words, texts longer than that too, with an overlap. Of a match only its begin and its
end are looked for, not the windows between, and about ``PAIRS`` of them are held at once, so a task's memory follows neither
the number of rows nor how often item and text repeat one word; it holds the batch's texts themselves. The benchmark is read in blocks of at most ``block_words`` words,
each broadcast by itself and let go before the next, so the driver and what is broadcast never grow with the
benchmark; with one block nothing is shuffled at all, with more the hits of a document are written for each block and
joined by its row. Matching is by 64-bit word hashes.

Defined cases: null or empty texts have no words and no hits; very long texts are read whole; an item without words or
with a null text never occurs; repeated items are found under their item_ids alike; repeated documents are judged one
by one; of equally long longest matches the first in the text counts, then the least item_id as a string; empty tables
give empty results or no hits; other columns, of any name, pass through ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Work, table
from .kernel import ALNUM, buffers, words


class TestSuffixes:
    """A block of the benchmark: numbered words, and every item's suffixes cut at width words."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.width = width
        raw, off = buffers(pa.array([t for _, t in items], pa.binary()))
        h, at = words(raw, off, ALNUM)
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h).astype(np.uint32) + 1
        # windows that decide: all of width words; for a shorter item, its whole
        self.item, self.offset, self.length, rows = [], [], [], []
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            n = b - a
            for j in range(n - width + 1) if n >= width else range(min(n, 1)):
                self.item.append(i)
                self.offset.append(j)
                self.length.append(min(width, n))
                rows.append(np.r_[ids[a + j : a + j + min(width, n)], np.zeros(width - min(width, n), np.uint32)])
        self.names = [x for x, _ in items]
        self.keys = np.array(rows, dtype=np.uint32).reshape(-1, width)
        self.item, self.offset, self.length = (np.array(x, dtype=np.int64) for x in (self.item, self.offset, self.length))
        self.least = int(self.length.min()) if len(self.length) else 0


def blocks(benchmark: DataFrame, width: int, block_words: int) -> Iterator[TestSuffixes]:
    """The benchmark, one bounded block after another."""
    rows, n = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("binary").alias("text")).orderBy("item_id").toLocalIterator():
        size = len(r["text"] or b"") // 2 + 1
        if rows and n + size > block_words:
            yield TestSuffixes(rows, width)
            rows, n = [], 0
        rows.append((str(r["item_id"]), bytes(r["text"] or b"")))
        n += size
    if rows:
        yield TestSuffixes(rows, width)


def _packed(ids: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that compare as the rows do."""
    return np.ascontiguousarray(ids.astype(">u4")).view(f"S{4 * ids.shape[1]}").ravel()


class SuffixArray:
    """The suffixes of a shard that begin with at least ``least`` numbered words, in order through width words."""

    def __init__(self, h: np.ndarray, at: np.ndarray, test: TestSuffixes):
        width, n = test.width, len(h)
        k = np.searchsorted(test.vocabulary, h)
        k[k == len(test.vocabulary)] = 0
        ids = np.where(test.vocabulary[k] == h, k + 1, 0).astype(np.uint32)
        stop = np.r_[np.flatnonzero((ids == 0)), n]  # a run of numbered words ends here, or with its text
        where = np.arange(n)
        run = np.minimum(stop[np.searchsorted(stop, where)], at[np.searchsorted(at, where, side="right")]) - where
        start = np.flatnonzero(run >= max(test.least, 1))
        run = np.minimum(run[start], width)
        rows = np.zeros((len(start), width), dtype=np.uint32)
        for j in range(width):
            ok = run > j
            rows[ok, j] = ids[start[ok] + j]
        key = _packed(rows)
        order = np.argsort(key, kind="stable")
        self.start, self.key = start[order], key[order]

    def find(self, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """For each test window the range of suffixes that begin with it."""
        low = test.keys
        high = np.where(np.arange(test.width)[None, :] < test.length[:, None], low, np.uint32(0xFFFFFFFF))
        left = np.searchsorted(self.key, _packed(low), side="left")
        right = np.searchsorted(self.key, _packed(high), side="right")
        return left, right


PAIRS, PIECE = 1_000_000, 1 << 20
Runs = tuple[np.ndarray, ...]


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] numbers, then those of begin[1], and so on."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


def _cuts(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """n in stretches whose sum is at most PAIRS, or of one element."""
    total, first = np.r_[0, np.cumsum(n)], 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(total, total[first] + PAIRS, side="right")) - 1)
        yield first, last
        first = last


class Joined:
    """Pairs of a test window and a place of the same words whose neighbours, on one side, do not match as well."""

    def __init__(self, place: np.ndarray, same: np.ndarray, beside: np.ndarray):
        self.base = int(max(same.max(initial=0), beside.max(initial=0))) + 1
        key = same[place] * self.base + beside[place]
        order = np.argsort(key, kind="stable")
        self.place, self.key = place[order], key[order]

    def ranges(self, same: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each window the places of its words, but for those with its neighbour's words beside them: two ranges."""
        at = lambda k, side="left": np.searchsorted(self.key, k, side=side)
        low, high = at(same * self.base), at((same + 1) * self.base)
        out, back = at(same * self.base + beside), at(same * self.base + beside, "right")
        out, back = np.where(beside > 0, out, low), np.where(beside > 0, back, low)
        return low, out - low, back, high - back

    def pairs(self, w: np.ndarray, ranges: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        a, n, b, m = ranges
        return np.r_[np.repeat(w, n), np.repeat(w, m)], self.place[np.r_[_ranges(a, n), _ranges(b, m)]]


def _piece_runs(h: np.ndarray, at: np.ndarray, test: TestSuffixes) -> Iterator[Runs]:
    """Runs begin at pairs whose predecessors do not match, and end at pairs whose successors do not; only these are
    listed, at most about PAIRS at a time. In order along its diagonal, each begin belongs to the end of its number."""
    sa = SuffixArray(h, at, test)
    left, right = sa.find(test)
    n = right - left
    short = np.flatnonzero((n > 0) & (test.length < test.width))
    for a, b in _cuts(n[short]):
        w = short[a:b]
        which, place = np.repeat(w, n[w]), sa.start[_ranges(left[w], n[w])]
        text = np.searchsorted(at, place, side="right") - 1
        yield test.item[which], test.offset[which], text, place - at[text], test.length[which]
    # equal windows have equal numbers, which the places of their words bear too
    window = np.where((n > 0) & (test.length == test.width), left + 1, 0)
    used = np.flatnonzero(window)
    if not len(used):
        return
    some = used[np.unique(window[used], return_index=True)[1]]
    same = np.zeros(len(h), np.int64)
    same[sa.start[_ranges(left[some], n[some])]] = np.repeat(window[some], n[some])
    del sa
    begins, ends = np.zeros(len(h), bool), np.zeros(len(h), bool)
    begins[at[:-1][at[:-1] < at[1:]]] = True
    ends[at[1:][at[:-1] < at[1:]] - 1] = True
    before, after = np.where(begins, 0, np.r_[0, same[:-1]]), np.where(ends, 0, np.r_[same[1:], 0])
    inside = test.item[1:] == test.item[:-1]
    w_before, w_after = np.r_[0, np.where(inside, window[:-1], 0)], np.r_[np.where(inside, window[1:], 0), 0]
    place = np.flatnonzero(same)

    def along(heads: tuple[np.ndarray, np.ndarray], tails: tuple[np.ndarray, np.ndarray]) -> Runs:
        (w, p), (v, q) = (sorted_(*heads), sorted_(*tails))
        text = np.searchsorted(at, p, side="right") - 1
        return test.item[w], test.offset[w], text, p - at[text], q - p + test.width

    def sorted_(w: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((p, p - test.offset[w], test.item[w]))
        return w[order], p[order]

    heads, tails = Joined(place, same, before), Joined(place, same, after)
    head, tail = heads.ranges(window[used], w_before[used]), tails.ranges(window[used], w_after[used])
    first = np.flatnonzero(np.r_[True, test.item[used][1:] != test.item[used][:-1]])
    size = np.add.reduceat(head[1] + head[3], first)  # runs of each item: as many begin as end
    stop = np.r_[first, len(used)]
    for a, b in _cuts(size):
        own = slice(stop[a], stop[b])
        w = used[own]
        if size[a:b].sum() <= PAIRS:
            yield along(heads.pairs(w, tuple(x[own] for x in head)), tails.pairs(w, tuple(x[own] for x in tail)))
            continue
        # one item of more: its diagonals in stretches, of which each run lies in one
        low, high = int(test.offset[w].min()), int(test.offset[w].max())
        todo = [(-high, len(h) - low)]
        while todo:
            d, e = todo.pop()
            near = place[np.searchsorted(place, d + low) : np.searchsorted(place, e + high)]
            sides = [(Joined(near, same, s), t[w]) for s, t in ((before, w_before), (after, w_after))]
            lists = [j.ranges(window[w], t) for j, t in sides]
            if max(int((x[1] + x[3]).sum()) for x in lists) > PAIRS and e - d > max(1, (high - low) // 16):
                todo += [((d + e) // 2, e), (d, (d + e) // 2)]
                continue
            found = []
            for (j, _), x in zip(sides, lists):
                parts = [(w[:0], near[:0])]
                for k, m in _cuts(x[1] + x[3]):
                    v, p = j.pairs(w[k:m], tuple(y[k:m] for y in x))
                    ok = (p - test.offset[v] >= d) & (p - test.offset[v] < e)
                    parts.append((v[ok], p[ok]))
                found.append(tuple(np.concatenate(y) for y in zip(*parts)))
            if len(found[0][0]):
                yield along(*found)


def _runs(h: np.ndarray, at: np.ndarray, test: TestSuffixes) -> Iterator[Runs]:
    """(item, item's word, text, text's word, number of words) of the matches of at least width words, or of a whole
    shorter item, that go on neither before nor behind."""
    if not len(h) or not len(test.keys):
        return
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE, side="right")) - 1)
        a, b = int(at[first]), int(at[last])
        if b - a <= PIECE:
            for item, offset, text, place, n in _piece_runs(h[a:b], at[first : last + 1] - a, test):
                yield item, offset, text + first, place, n
        else:
            for item, offset, place, n in _long_text(h[a:b], test):
                yield item, offset, np.full(len(item), first), place, n
        first = last


def _long_text(h: np.ndarray, test: TestSuffixes) -> Iterator[Runs]:
    """The runs of one text, in pieces that overlap by a window's words but one. What reaches a piece's end is held until
    the next one tells whether it goes on, at most one run for each test window."""
    held: dict[tuple[int, int], tuple[int, int, int]] = {}  # (item, item's word behind it): item's word, text's word, words
    for c in range(0, len(h), PIECE):
        own = h[c : c + PIECE + test.width - 1]
        more, kept = c + PIECE < len(h), {}
        for item, offset, _, place, n in _piece_runs(own, np.array([0, len(own)]), test):
            whole = (place < PIECE) & ~((place == 0) & (c > 0))
            edge = (place + n == len(own)) & (n >= test.width) if more else np.zeros(len(n), bool)
            ok = whole & ~edge
            yield item[ok], offset[ok], place[ok] + c, n[ok]
            rows = []
            for i, o, x, k, open_ in zip(*(y[(place < PIECE) & ~ok].tolist() for y in (item, offset, place + c, n, edge))):
                if x == c and k >= test.width and (old := held.pop((i, o + test.width - 1), None)):
                    o, x, k = old[0], old[1], k + old[2] - test.width + 1
                if open_:
                    kept[i, o + k] = (o, x, k)
                else:
                    rows.append((i, o, x, k))
            if rows:
                yield tuple(np.array(y, dtype=np.int64) for y in zip(*rows))
        rest = [(i, *row) for (i, _), row in held.items()]
        if rest:
            yield tuple(np.array(y, dtype=np.int64) for y in zip(*rest))
        held = kept


Longest = tuple[int, str, int, int]  # words, item, where in the item, where in the text


def _hits(h: np.ndarray, at: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, list[set[str]], list[Longest]]:
    """Which words of a shard lie in a match, and for each text the items that occur and the longest match."""
    change, found, best = np.zeros(len(h) + 1, np.int64), [set() for _ in at[:-1]], [(0, "", 0, 0)] * (len(at) - 1)
    rank = np.unique(np.array(test.names, dtype=object), return_inverse=True)[1] if test.names else np.zeros(0, np.int64)
    for item, offset, text, place, n in _runs(h, at, test):
        np.add.at(change, at[text] + place, 1)
        np.add.at(change, at[text] + place + n, -1)
        for x in np.unique(text * len(test.names) + item).tolist():
            found[x // len(test.names)].add(test.names[x % len(test.names)])
        order = np.lexsort((offset, rank[item], place, -n, text))
        for x in order[np.flatnonzero(np.r_[True, text[order][1:] != text[order][:-1]])].tolist() if len(text) else ():
            t = int(text[x])
            best[t] = _longer(best[t], (int(n[x]), test.names[item[x]], int(offset[x]), int(place[x])))
    return np.cumsum(change)[:-1] > 0, found, best


def _longer(a: Longest, b: Longest) -> Longest:
    return min(a, b, key=lambda m: (-m[0], m[3], m[1], m[2]))


def _digest(names) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_item string, longest_item_word long, longest_word long"
NAMES = [x.split()[0] for x in REPORT.split(", ")]


def _columns(best: list[Longest]) -> list[pa.Array]:
    """The longest matches; null but for the length where there is none."""
    some = [m if m[0] else (0, None, None, None) for m in best]
    return [pa.array([m[k] for m in some], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))]


def _verdicts(spark: SparkSession, packed: DataFrame, benchmark: DataFrame, width: int, block_words: int) -> DataFrame:
    """packed (_row, _text) with the columns of REPORT. _row is any struct, _text the text as binary."""
    tests = blocks(benchmark, width, block_words)
    first = next(tests, TestSuffixes([], width))
    more = next(tests, None)
    row_type = packed.schema["_row"].dataType.simpleString()

    def scanned(shared, batches):
        for b in batches:
            h, at = words(*buffers(b.column(1)), ALNUM)
            yield b, at, *_hits(h, at, shared.value)

    if more is None:
        shared = spark.sparkContext.broadcast(first)

        def whole(batches):
            for b, at, hit, found, best in scanned(shared, batches):
                total = np.r_[0, np.cumsum(hit)]
                n_hit = total[at[1:]] - total[at[:-1]]
                cols = [pa.array(np.diff(at)), pa.array(n_hit), pa.array([len(x) for x in found], pa.int64()), pa.array([_digest(x) for x in found], pa.string()), pa.array(n_hit > 0), *_columns(best)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["_row", "_text", *NAMES])

        return packed.mapInArrow(whole, f"_row {row_type}, _text binary, {REPORT}")

    # more blocks: each row's hits of a block, as bits and item ids, are written before the next block is read
    packed = packed.withColumn("_key", F.struct(F.xxhash64("_row", "_text"), F.xxhash64(F.lit(1), "_row", "_text")))
    key_type = packed.schema["_key"].dataType.simpleString()
    longest = ", ".join(REPORT.split(", ")[5:])
    work, parts = Work(spark, "contamination"), None
    while first is not None:
        shared = spark.sparkContext.broadcast(first)

        def part(batches, shared=shared):
            for b, at, hit, found, best in scanned(shared, batches):
                bits = [np.packbits(hit[x:y]).tobytes() for x, y in zip(at[:-1], at[1:])]
                cols = [pa.array(np.diff(at)), pa.array(bits, pa.binary()), pa.array([sorted(x) for x in found], pa.list_(pa.string())), *_columns(best)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["_key", "n_words", "bits", "items", *NAMES[5:]])

        one = packed.select("_key", "_text").mapInArrow(part, f"_key {key_type}, n_words long, bits binary, items array<string>, {longest}")
        one = work.save(one.where("size(items) > 0").dropDuplicates(["_key"]), "hits")
        parts = one if parts is None else parts.unionByName(one)
        shared.destroy()
        first, more = more, next(tests, None) if more is not None else None

    def merge(t: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t["bits"].to_pylist()])
        found = {y for x in t["items"].to_pylist() for y in x}
        n = int(np.unpackbits(bits)[: t["n_words"][0].as_py()].sum())
        best = (0, "", 0, 0)
        for m in zip(*(t[c].to_pylist() for c in NAMES[5:])):
            best = _longer(best, m)
        return pa.table([t["_key"].slice(0, 1), [n], [len(found)], [_digest(found)], *_columns([best])], names=["_key", *NAMES[1:4], *NAMES[5:]])

    merged = parts.groupBy("_key").applyInArrow(merge, f"_key {key_type}, n_hit long, n_items long, items_sha256 string, {longest}")
    n_words = F.coalesce(F.regexp_count(F.col("_text").cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    out = packed.withColumn("n_words", n_words).join(merged, "_key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "_row", "_text", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.lit(_digest([]))).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), zero("longest"), *NAMES[6:],
    )


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """doc_id and the verdict: n_words, n_hit, n_items, items_sha256, contaminated, and the longest match: its words, its
    item, and where it begins in item and text."""
    packed = docs.select(F.struct("doc_id").alias("_row"), F.col("text").cast("binary").alias("_text"))
    return _verdicts(spark, packed, benchmark, width, block_words).select("_row.doc_id", *NAMES)


PLACES = "item_id string, item_word long, doc_id long, doc_word long, n_words long"


def passages(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: int = 5, block_words: int = 2_000_000) -> DataFrame:
    """All verbatim matches of at least ``least`` words in their full length: (item_id, item_word, doc_id, doc_word,
    n_words), a row for each match that goes on neither before nor behind."""
    work, out = Work(spark, "passages"), spark.createDataFrame([], PLACES)
    for test in blocks(benchmark, least, block_words):
        shared = spark.sparkContext.broadcast(test)

        def run(batches, shared=shared):
            test = shared.value
            for b in batches:
                h, at = words(*buffers(b.column(1)), ALNUM)
                for item, item_word, text, doc_word, n in _runs(h, at, test):
                    names = pa.array([test.names[i] for i in item], pa.string())
                    found = pa.RecordBatch.from_arrays([names, pa.array(item_word), b.column(0).take(pa.array(text)), pa.array(doc_word), pa.array(n)], ["item_id", "item_word", "doc_id", "doc_word", "n_words"])
                    yield found.filter(pa.array(n >= least))

        out = out.unionByName(work.save(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, PLACES), "block"))
        shared.destroy()
    return out


def locations(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int | None = None, least: int = 5, block_words: int = 2_000_000) -> DataFrame:
    """The longest verbatim match of every suffix of every item, with all its documents and places: (item_id, item_word,
    doc_id, doc_word, n_words), of matches of at least ``least`` words. With a width, n_words says at most width, and
    matches of width words or more count as equally long."""
    runs = passages(spark, docs, benchmark, least, block_words)
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_words") - least)).alias("_k")
    moved = runs.select("*", step).select("item_id", (F.col("item_word") + F.col("_k")).alias("item_word"), "doc_id", (F.col("doc_word") + F.col("_k")).alias("doc_word"), (F.col("n_words") - F.col("_k")).alias("n_words"))
    if width is not None:
        moved = moved.withColumn("n_words", F.least("n_words", F.lit(width).cast("long")))
    best = moved.groupBy("item_id", "item_word").agg(F.max("n_words").alias("n_words"))
    return moved.join(best, ["item_id", "item_word", "n_words"]).select(*[x.split()[0] for x in PLACES.split(", ")])


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """The documents without a hit, with their own columns."""
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), F.col("text").cast("binary").alias("_text"))
    clean = _verdicts(spark, packed, benchmark, width, block_words).where(~F.col("contaminated"))
    return clean.select(*[F.col("_text").cast("string").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", *NAMES[:6])


def report_sql(source: str = "documents") -> str:
    """DuckDB SQL of the query's columns."""
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {source}),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (
  SELECT item_id, i AS j, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM items),
grams AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, i, j, n FROM grams JOIN items USING (n, g)),
runs AS (
  SELECT doc_id, count(*) + any_value(n) - 1 AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM found) GROUP BY doc_id, item_id, i - j, run),
most AS (SELECT doc_id, max(n) AS longest FROM runs GROUP BY doc_id),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(longest, 0) AS longest
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN most USING (doc_id)
"""


OP7_SQL = report_sql()
