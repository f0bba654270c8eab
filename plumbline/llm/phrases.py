"""Phrases whose words keep company, counted through minimal perfect hashes.

Words are counted first. Words of at least ``least`` occurrences get numbers, the slots of a minimal perfect hash, and the
texts are rewritten as arrays of numbers once. A longer phrase is the pair of the two phrases that it is made of, its first and its
last words but one, and is looked at only where both of them are frequent, so no frequent one is missed. Which pairs
are candidates is settled by tallies that each task cuts at ``least``; a perfect hash is built over the candidates, block
by block, with the pairs themselves stored by slot. Then every task looks its pairs up, compares them with the stored
ones, adds them up in one numpy array by slot (bincount), and the tasks' arrays are summed as a tree with a bounded
fan-in. Numbers of phrases are slots, so a cut's parts are read by their numbers. The next length starts from the same
arrays, rewritten as numbers of phrases.

What a task holds is bounded: hashes of ``pass_keys`` keys at a time are broadcast (16 bytes a word, 8 a phrase, and 3 bits),
and more keys take more passes over the arrays of numbers. Blocks are sized by a hash of the key, so a frequent pair,
language or text weighs no more than others.

Defined cases: a null text is empty; a null lang is ``und``, together with rows of that lang; a very long text is cut at
white space and read to its end; repeated rows count as often as they are there; ties are broken as the order of results says, down to the
phrase, which is unique in its lang; an empty table gives an empty result; other columns are ignored. More than
2^31 frequent phrases of one length raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import LOWER, UPPER, Work, arrow_rows, ascii_lower, table, tree_sum
from .perfect_hash import PerfectHash, block_of, build

BREAKS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(UPPER.encode() + BREAKS + b"\t", LOWER.encode() + b"\n" * len(BREAKS) + b" ")
SEGMENT = 4096  # slots of a piece of a task's array
SLICE = 1 << 20  # bytes of a text that are split at once
HASH_ROW = "block int, sizes array<int>, bits binary, keys binary"


def lang_of(c: str = "lang") -> Column:
    return F.coalesce(F.col(c), F.lit("und"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f: occurrences of every word."""
    words = F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), r"[.,;:!?\x0A-\x0D\x20\x09]+")
    return docs.select(lang_of().alias("lang"), F.explode(words).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("f"))


def word_keys(lang: str, words: list[bytes]) -> np.ndarray:
    own = lang.encode()
    head = b"%d:" % len(own) + own + b":"
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(head + w) for w in words), "<u8").reshape(-1, 2)


def pieces(text: bytes):
    """Lists of the text's words, a break being b'.', which is no word."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = at + SLICE
        if end < len(folded):
            ends = [x for x in (folded.find(b" ", end), folded.find(b"\n", end)) if x >= 0]
            end = min(ends, default=len(folded))
        yield folded[at:end].replace(b"\n", b" . ").split()
        at = end


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32)))


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers in one array with a -1 after each, and where the -1 stand."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    return np.insert(column.flatten().to_numpy(zero_copy_only=False), ends, -1), ends + np.arange(len(ends))


def pairs(numbers: np.ndarray, window: int = 500_000):
    """Places where two numbers follow one another, and their keys, a window of places at a time."""
    for start in range(0, len(numbers) - 1, window):
        own = numbers[start : start + window + 1]
        at = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0))
        yield start + at, ((own[at].astype(np.uint64) << np.uint64(32)) | own[at + 1].astype(np.uint64)).reshape(-1, 1)


class Hashed:
    """A written table of hash blocks (HASH_ROW and more), its passes, and the numbers that slots stand for."""

    def __init__(self, rows: DataFrame, blocks: int, width: int, pass_keys: int):
        self.rows, self.blocks, self.width = rows, blocks, width
        self.counts = sorted((r["block"], r["n"] // (8 * width)) for r in rows.select("block", F.octet_length("keys").alias("n")).collect())
        self.passes, self.first, at = [], {}, 0
        for block, n in self.counts:
            if not self.passes or at + n - self.passes[-1][0] > pass_keys:
                self.passes.append([at, block, block])
            self.passes[-1][2] = block
            self.first[block] = at
            at += n
        self.total = at
        if at >= 1 << 31:
            raise ValueError("over 2^31 phrases of one length: ask for more occurrences")

    def hash(self, first: int, low: int, high: int) -> PerfectHash:
        own = self.rows.where(F.col("block").between(low, high)).select("block", "sizes", "bits", "keys").collect()
        return PerfectHash([(r["block"], r["sizes"], bytes(r["bits"]), bytes(r["keys"])) for r in sorted(own, key=lambda r: r["block"])], self.blocks, self.width, first)

    def firsts(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame(list(self.first.items()), "block int, first long")


def frequent_words(work: Work, counts: DataFrame, least: int, pass_keys: int, per_block: int = 16_384) -> Hashed:
    many = counts.where(F.col("f") >= least)
    blocks = max(1, -(-many.count() // per_block))

    def deal(batches):
        for b in batches:
            langs, words = b.column("lang").to_pylist(), b.column("word").to_pylist()
            keys = np.concatenate([word_keys(x, [w.encode()]) for x, w in zip(langs, words)]) if langs else np.zeros((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(block_of(keys, blocks).astype(np.int32)), *b.columns], ["block", *b.schema.names])

    def make(group: pa.Table) -> pa.Table:
        langs, words = group.column("lang").to_pylist(), group.column("word").to_pylist()
        keys = np.concatenate([word_keys(x, [w.encode()]) for x, w in zip(langs, words)])
        sizes, bits, order = build(keys)
        take = group.take(pa.array(order))
        lists = [pa.array([take.column(c).to_pylist()], pa.list_(kind)) for c, kind in (("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()))]
        return pa.table([group.column("block").slice(0, 1), pa.array([sizes], pa.list_(pa.int32())), pa.array([bits]), pa.array([keys[order].tobytes()]), *lists], ["block", "sizes", "bits", "keys", "langs", "words", "fs"])

    dealt = many.select("lang", "word", "f").mapInArrow(deal, "block int, lang string, word string, f long")
    made = dealt.groupBy("block").applyInArrow(make, HASH_ROW + ", langs array<string>, words array<string>, fs array<long>")
    return Hashed(work.save(made, "word-hash"), blocks, 2, pass_keys)


def numbered_words(work: Work, docs: DataFrame, words: Hashed) -> DataFrame:
    """ids: the numbers of each text's words, -1 for words that are not frequent and for breaks."""
    spark, last = work.spark, len(words.passes) - 1
    rows = docs.select(lang_of().alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    for i, (first, low, high) in enumerate(words.passes):
        held = spark.sparkContext.broadcast(words.hash(first, low, high))

        def run(batches, held=held, final=i == last):
            cache: dict[str, dict[bytes, int]] = {}

            def numbers(lang: str, own: list[bytes]) -> np.ndarray:
                known = cache.setdefault(lang, {b".": -1})
                new = [w for w in set(own) if w not in known]
                if new:
                    if sum(map(len, cache.values())) > 100_000:
                        cache.clear()
                        known = cache[lang] = {b".": -1}
                        new = [w for w in set(own) if w != b"."]
                    slots = held.value.slots(word_keys(lang, new))
                    known.update(zip(new, np.where(slots >= 0, slots + held.value.first, -1).tolist()))
                return np.fromiter(map(known.__getitem__, own), np.int32, len(own))

            for b in batches:
                langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
                found: list[np.ndarray | None] = [None] * len(texts)
                group: dict[str, list] = {}
                held_words = 0

                def settle():
                    for lang, own in group.items():
                        flat = numbers(lang, [w for _, ws in own for w in ws])
                        at = 0
                        for i, ws in own:
                            part = flat[at : at + len(ws)]
                            found[i] = part if found[i] is None else np.concatenate([found[i], part])
                            at += len(ws)
                    group.clear()

                for i, text in enumerate(texts):
                    found[i] = np.zeros(0, np.int32) if not text else None
                    for ws in pieces(text):
                        group.setdefault(langs[i], []).append((i, ws))
                        held_words += len(ws)
                        if held_words > 100_000:
                            settle()
                            held_words = 0
                settle()
                found = [np.zeros(0, np.int32) if x is None else x for x in found]
                if "ids" in b.schema.names:
                    found = [np.maximum(a, np.asarray(x, np.int32)) for a, x in zip(found, b.column("ids").to_pylist())]
                ids = _lists(found)
                yield pa.RecordBatch.from_arrays([ids] if final else [b.column("lang"), b.column("text"), ids], ["ids"] if final else ["lang", "text", "ids"])

        before = rows
        rows = work.save(rows.mapInArrow(run, "ids array<int>" if i == last else "lang string, text binary, ids array<int>"), f"numbers{i}")
        if i:
            work.drop(before)
        held.unpersist()
    return rows


def candidates(work: Work, rows: DataFrame, least: int, blocks: int, pass_keys: int, chunk: int = 1_000_000) -> Hashed:
    """Pairs that follow one another at least ``least`` times, behind perfect hashes."""
    kind = np.min_scalar_type(least)

    def tally(batches):
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            block = block_of(keys.reshape(-1, 1), blocks)
            order = np.argsort(block, kind="stable")
            keys, n, block = keys[order], np.minimum(n, least)[order].astype(kind), block[order]
            there, at = np.unique(block, return_index=True)
            ends = [*at[1:], len(block)]
            return pa.RecordBatch.from_arrays(
                [pa.array(there.astype(np.int32)), pa.array([keys[a:e].tobytes() for a, e in zip(at, ends)], pa.binary()), pa.array([n[a:e].tobytes() for a, e in zip(at, ends)], pa.binary())],
                ["block", "keys", "tallies"],
            )

        for b in batches:
            for _, own in pairs(_padded(b.column("ids"))[0]):
                held.append(own[:, 0])
                size += len(own)
                if size >= chunk:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def make(group: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), "<u8")
        n = np.frombuffer(b"".join(group.column("tallies").to_pylist()), kind)
        own, back = np.unique(keys, return_inverse=True)
        own = own[np.bincount(back, n) >= least].reshape(-1, 1)
        sizes, bits, order = build(own)
        return pa.table([group.column("block").slice(0, 1), pa.array([sizes], pa.list_(pa.int32())), pa.array([bits], pa.binary()), pa.array([own[order].tobytes()], pa.binary())], ["block", "sizes", "bits", "keys"])

    made = rows.mapInArrow(tally, "block int, keys binary, tallies binary").groupBy("block").applyInArrow(make, HASH_ROW)
    return Hashed(work.save(made, "hash"), blocks, 1, pass_keys)


def counted(rows: DataFrame, found: Hashed) -> DataFrame:
    """id, f: occurrences of every stored pair, by bincount in the tasks and a tree of sums."""
    spark, out = rows.sparkSession, spark_empty(rows.sparkSession, "id int, f long")
    parts = rows.rdd.getNumPartitions()
    for first, low, high in found.passes:
        held = spark.sparkContext.broadcast(found.hash(first, low, high))

        def count(batches, held=held):
            h = held.value
            total, slots, size = np.zeros(-(-len(h) // SEGMENT) * SEGMENT, np.int64), [], 0

            def add():
                own = np.concatenate(slots)
                np.add(total, np.bincount(own, minlength=len(total)), out=total)

            for b in batches:
                for _, keys in pairs(_padded(b.column("ids"))[0]):
                    own = h.slots(keys)
                    slots.append(own[own >= 0])
                    size += len(slots[-1])
                    if size > 1_000_000:
                        add()
                        slots, size = [], 0
            if slots:
                add()
            by = total.reshape(-1, SEGMENT)
            some = np.flatnonzero(by.any(1))
            part = TaskContext.get().partitionId()
            for at in range(0, len(some), 64):
                own = some[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), part, np.int32)), pa.array([by[s].tobytes() for s in own], pa.binary())], ["segment", "part", "counts"])

        def read(batches, first=first):
            for b in batches:
                for segment, counts in zip(b.column("segment").to_pylist(), b.column("counts").to_pylist()):
                    f = np.frombuffer(counts, "<i8")
                    at = np.flatnonzero(f)
                    yield pa.RecordBatch.from_arrays([pa.array((first + segment * SEGMENT + at).astype(np.int32)), pa.array(f[at])], ["id", "f"])

        own = tree_sum(rows.mapInArrow(count, "segment int, part int, counts binary"), parts).mapInArrow(read, "id int, f long")
        out = out.unionByName(own)
    return out


def spark_empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def stored_pairs(found: Hashed) -> DataFrame:
    """id, left, right of all stored pairs."""

    def run(batches):
        for b in batches:
            for first, keys in zip(b.column("first").to_pylist(), b.column("keys").to_pylist()):
                own = np.frombuffer(keys, "<u8")
                ids = np.arange(first, first + len(own)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((own >> np.uint64(32)).astype(np.int32)), pa.array((own & np.uint64(0xFFFFFFFF)).astype(np.int32))], ["id", "left", "right"])

    return found.rows.join(F.broadcast(found.firsts()), "block").select("first", "keys").mapInArrow(run, "id int, left int, right int")


def numbered_pairs(work: Work, rows: DataFrame, found: Hashed) -> DataFrame:
    """ids: the number of the phrase that starts at each place, one word longer than those of rows; else -1."""
    rows = rows.select("ids", F.lit(None).cast("array<int>").alias("more"))
    for i, (first, low, high) in enumerate(found.passes):
        held = work.spark.sparkContext.broadcast(found.hash(first, low, high))

        def run(batches, held=held):
            for b in batches:
                numbers, ends = _padded(b.column("ids"))
                out = np.full(len(numbers), -1, np.int32)
                for places, keys in pairs(numbers):
                    slots = held.value.slots(keys)
                    out[places] = np.where(slots >= 0, slots + held.value.first, -1)
                out = np.delete(out, ends)
                if not b.column("more").null_count:
                    out = np.maximum(out, b.column("more").flatten().to_numpy(zero_copy_only=False))
                offsets = np.concatenate([[0], ends - np.arange(len(ends))])
                yield pa.RecordBatch.from_arrays([b.column("ids"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))], ["ids", "more"])

        before = rows
        done = rows.mapInArrow(run, "ids array<int>, more array<int>")
        rows = work.save(done.select(F.col("more").alias("ids")) if i == len(found.passes) - 1 else done, f"pairs{i}")
        if i:
            work.drop(before)
        held.unpersist()
    return rows


class Phrases:
    """.totals: lang, n. .levels: for each length from 1 on a table of its frequent phrases: id, lang, words, f, heads and
    tails (occurrences of its first and last 1, 2, ... words), left and right (numbers one length shorter)."""

    def __init__(self, spark: SparkSession, docs: DataFrame, longest: int = 3, least: int = 10, pass_keys: int = 4_000_000, block_pairs: int = 2_000_000):
        self.work, self.levels = Work(spark, "phrases"), []
        with arrow_rows(spark, 1000):
            self._count(docs, longest, least, pass_keys, block_pairs)

    def _count(self, docs: DataFrame, longest: int, least: int, pass_keys: int, block_pairs: int) -> None:
        work = self.work
        counts = work.save(word_counts(docs), "words")
        self.totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
        words = frequent_words(work, counts, least, pass_keys)
        one = words.rows.join(F.broadcast(words.firsts()), "block").select("first", F.posexplode(F.arrays_zip("langs", "words", "fs")).alias("i", "w"))
        alone = F.array(F.col("w.fs"))
        nothing = F.lit(None).cast("int")
        one = one.select((F.col("first") + F.col("i")).cast("int").alias("id"), F.col("w.langs").alias("lang"), F.array("w.words").alias("words"), F.col("w.fs").alias("f"), alone.alias("heads"), alone.alias("tails"), nothing.alias("left"), nothing.alias("right"))
        self.levels.append(work.save(one, "level1"))
        if not words.total or longest < 2:
            return
        blocks = max(1, -(-(counts.agg(F.sum("f")).first()[0] or 0) // block_pairs))
        rows = numbered_words(work, docs, words)
        for length in range(2, longest + 1):
            found = candidates(work, rows, least, blocks, pass_keys)
            if not found.total:
                return
            self.levels.append(work.save(self._level(stored_pairs(found), counted(rows, found)), f"level{length}"))
            if length < longest:
                before, rows = rows, numbered_pairs(work, rows, found)
                work.drop(before)
        work.drop(rows)

    def _level(self, keys: DataFrame, counts: DataFrame) -> DataFrame:
        shorter = self.levels[-1]
        left = shorter.select(F.col("id").alias("left"), "lang", F.col("words").alias("_lw"), "heads")
        right = shorter.select(F.col("id").alias("right"), F.col("words").alias("_rw"), "tails")
        rows = keys.join(counts, "id").join(left, "left").join(right, "right")
        one = F.array("f")
        words = F.concat("_lw", F.slice("_rw", -1, 1))
        return rows.select("id", "lang", words.alias("words"), "f", F.concat("heads", one).alias("heads"), F.concat("tails", one).alias("tails"), "left", "right")

    def scored(self, percent: int = 50) -> DataFrame:
        """lang, phrase, a, l, r, score of candidates that no longer one stands for: one that holds their words and has
        percent of their occurrences at least."""
        out = None
        for n, level in enumerate(self.levels, 1):
            if n == 1:
                continue
            if n < len(self.levels):
                longer = self.levels[n].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("_f")).groupBy("id").agg(F.max("_f").alias("_f"))
                level = level.join(longer, "id", "left").where(f"_f is null or 100 * cast(_f as decimal(20,0)) < {percent} * cast(f as decimal(20,0))")
            wide = lambda c: f"cast({c} as decimal(19,0))"
            score = f"(1000000 * ({wide('f')} * {wide('f')})) div ({wide('heads[k - 1]')} * {wide(f'tails[{n} - k - 1]')})"
            cut = F.expr(f"array_min(transform(sequence(1, {n - 1}), k -> struct({score} as score, k as k, heads[k - 1] as l, tails[{n} - k - 1] as r)))")
            level = level.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), cut.alias("c"))
            level = level.select("lang", "phrase", "a", "c.l", "c.r", F.col("c.score").cast("long").alias("score"))
            out = level if out is None else out.unionByName(level)
        return out if out is not None else spark_empty(self.work.spark, "lang string, phrase string, a long, l long, r long, score long")

    def best(self, most: int = 2000, percent: int = 50, salts: int = 64) -> DataFrame:
        """The first ``most`` of each lang, ranked. Parts of a lang are ranked first, so that none is sorted in one task whole."""
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        rows = self.scored(percent).withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("_k") <= most).drop("_k", "_s")
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
        return rows.join(self.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Phrases(spark, table(spark, sf_dir, "documents"), longest=3, least=10).best(2000)


OP11_SQL = r"""
WITH piece AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
gram AS MATERIALIZED (
  SELECT lang, array_to_string(g, ' ') AS p, any_value(g) AS g, count(*) AS f FROM (
    SELECT lang, ws[i : i + k - 1] AS g FROM (SELECT lang, ws, unnest(range(1, len(ws) - k + 2)) AS i, k FROM piece, (VALUES (1), (2), (3)) v(k) WHERE len(ws) >= k))
  GROUP BY lang, p),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM gram WHERE len(g) = 1 GROUP BY lang),
candidate AS MATERIALIZED (SELECT lang, p, g, f AS a FROM gram WHERE len(g) > 1 AND f >= 10),
part AS MATERIALIZED (
  SELECT lang, p, a, k, array_to_string(g[1 : k], ' ') AS lp, array_to_string(g[k + 1 :], ' ') AS rp FROM (SELECT *, unnest(range(1, len(g))) AS k FROM candidate)),
cut AS (
  SELECT c.lang, c.p, c.a, x.f AS l, y.f AS r, k, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM part c JOIN gram x ON x.lang = c.lang AND x.p = c.lp JOIN gram y ON y.lang = c.lang AND y.p = c.rp),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT lang, p, max(a) AS longer FROM (SELECT lang, a, array_to_string(g[s : s + 1], ' ') AS p FROM (SELECT *, unnest([1, 2]) AS s FROM candidate WHERE len(g) = 3)) GROUP BY lang, p),
kept AS (SELECT o.* FROM lowest o LEFT JOIN inside i ON i.lang = o.lang AND i.p = o.p WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(p)) AS rank, p AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
