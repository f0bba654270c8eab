"""Line dedup with sharded cuckoo filters over exact reference counts.

The index keeps, for every line key (stripped, A-Z lower-cased, at least ``min_chars`` code points; stored as a
128-bit hash), its exact postings (key, doc_id) and, derived from them, its reference count and largest holder.
Keys that reach ``min_docs`` documents are boilerplate. They are also held in cuckoo filters, one per shard of the
key space. Lines of documents are probed against the filters first, and only the few that may be boilerplate are
joined with the exact table, which decides. Cuckoo filters can forget a key, so removing documents decrements the
counts, takes keys that fall below the limit out of the filters, and their lines come back.

The filters are broadcast if all shards together stay within ``filter_bytes``; beyond that lines go to the filter of
their shard, at most about ``task_postings`` to a task. Results are equal. Lines that pass are joined with the exact table; what is known of the few lines of
very many documents (fewer than 10,000 of them at any size) is broadcast, so no task gathers a frequent line's documents.

Defined cases: null or empty text is one empty line; very long texts and lines are read whole; rows of equal doc_id
count as one holder, and each is rewritten by itself, so a line that is repeated in its largest holder stays in all of
its places; a null doc_id counts as no holder, and its lines stay; empty tables give empty results; other columns
pass through or are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Work, by_groups, table
from .kernel import mix

MOST_PARTS = 32
STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    line = line.strip(STRIP)
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(line.lower())  # bytes.lower() changes A-Z alone


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket, over 16-byte keys."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.mask = len(slots) - 1

    @classmethod
    def of_size(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(keys, 1) / 4 / 0.8))))
        return cls(np.zeros((buckets, 4), dtype=np.uint16))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word = keys.view("<u8").reshape(-1, 2)
        finger = (word[:, 1] % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
        one = (word[:, 0] & np.uint64(self.mask)).astype(np.int64)
        return finger, one, self._other(one, finger)

    def _other(self, bucket, finger):
        return bucket ^ (mix(np.asarray(finger, dtype=np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key finds no place; the caller then builds a larger filter."""
        rng = np.random.default_rng(1)
        for finger, one, two in zip(*self._places(keys)):
            for b in (one, two):
                free = np.flatnonzero(self.slots[b] == 0)
                if len(free):
                    self.slots[b, free[0]] = finger
                    break
            else:
                b = int(two)
                for _ in range(500):
                    j = int(rng.integers(4))
                    self.slots[b, j], finger = finger, self.slots[b, j]
                    b = int(self._other(np.array([b]), np.array([finger]))[0])
                    free = np.flatnonzero(self.slots[b] == 0)
                    if len(free):
                        self.slots[b, free[0]] = finger
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        for finger, one, two in zip(*self._places(keys)):
            for b in (one, two):
                at = np.flatnonzero(self.slots[b] == finger)
                if len(at):
                    self.slots[b, at[0]] = 0
                    break

    def has(self, keys: np.ndarray) -> np.ndarray:
        finger, one, two = self._places(keys)
        return (self.slots[one] == finger[:, None]).any(1) | (self.slots[two] == finger[:, None]).any(1)

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> Cuckoo:
        return cls(np.frombuffer(b, dtype=np.uint16).reshape(-1, 4).copy())


def _keys(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="V16")


def _build(t: pa.Table) -> pa.Table:
    keys = _keys(t["k"])
    size = len(keys)
    while not (f := Cuckoo.of_size(size)).insert(keys):
        size *= 2
    return pa.table({"shard": t["shard"][:1], "filter": pa.array([f.to_bytes()], pa.binary())})


def _learn(old: pa.Table, new: pa.Table) -> pa.Table:
    """The filter of a shard with new keys; null if they find no place."""
    if not len(new):
        return old
    if not len(old):
        return _build(new)
    f = Cuckoo.from_bytes(old["filter"][0].as_py())
    return pa.table({"shard": new["shard"][:1], "filter": pa.array([f.to_bytes() if f.insert(_keys(new["k"])) else None], pa.binary())})


def _forget(old: pa.Table, gone: pa.Table) -> pa.Table:
    if not len(old):
        return pa.table({"shard": pa.array([], pa.int64()), "filter": pa.array([], pa.binary())})
    f = Cuckoo.from_bytes(old["filter"][0].as_py())
    if len(gone):
        f.delete(_keys(gone["k"]))
    return pa.table({"shard": old["shard"], "filter": pa.array([f.to_bytes()], pa.binary())})


def _passed(posted: pa.Table, filters: pa.Table) -> pa.Table:
    own = posted.select(["k", "doc_id"])
    if not len(own) or not len(filters):
        return own.slice(0, 0)
    return own.filter(pa.array(Cuckoo.from_bytes(filters["filter"][0].as_py()).has(_keys(own["k"]))))


def postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """(k, doc_id): the distinct line keys of every row of docs."""

    def scan(batches):
        for b in batches:
            ks, ids = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text and i is not None:
                    own = {line_key(x, min_chars) for x in text.split(b"\n") if len(x) >= min_chars}
                    own.discard(None)
                    ks += own
                    ids += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(ids, pa.int64())], ["k", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(scan, "k binary, doc_id long")


class LineIndex:
    def __init__(self, spark: SparkSession, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 100_000, filter_bytes: int = 32 << 20, task_postings: int = 200_000):
        self.spark, self.min_chars, self.min_docs, self.task_postings = spark, min_chars, min_docs, task_postings
        self.shard_keys, self.filter_bytes, self.shards = shard_keys, filter_bytes, 1
        self.work = Work(spark, "lines")
        self.parts: list[DataFrame] = []  # postings, a written table for each insertion
        self.counts = self.filters = None

    def _count(self, postings: DataFrame) -> DataFrame:
        """k, n_docs, largest: exact; a holder counts once, and a frequent key is summed before it is shuffled."""
        return postings.groupBy("k").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("largest"))

    def hot(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    @property
    def postings(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.parts) if self.parts else None

    def _shard(self) -> Column:
        return F.pmod(F.crc32("k"), F.lit(self.shards)).alias("shard")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents. A (key, doc_id) that is there already changes nothing. Of an index that has postings only the
        new ones are counted and stored, and keys that become frequent are put into the filters of their shards; a
        filter is built anew if it is full, all of them once the frequent keys have doubled their shards."""
        new = postings(docs, self.min_chars).distinct()
        if not self.parts:
            self.parts = [self.work.save(new, "postings")]
            self.counts = self.work.save(self._count(self.parts[0]), "counts")
            return self._build_filters()
        new = self.work.save(new.join(self.postings, ["k", "doc_id"], "left_anti"), "postings")
        self.parts.append(new)
        both = self.counts.unionByName(self._count(new)).groupBy("k").agg(F.sum("n_docs").alias("n_docs"), F.max("largest").alias("largest"))
        counts, old = self.work.save(both, "counts"), self.counts
        if len(self.parts) > MOST_PARTS:
            parts, self.parts = self.parts, [self.work.save(self.postings, "postings")]
            self.work.drop(*parts)
        hot = counts.where(F.col("n_docs") >= self.min_docs)
        if hot.count() > 2 * self.shards * self.shard_keys:
            self.counts = counts
            self.work.drop(old)
            return self._build_filters()
        risen = hot.join(self.hot(), "k", "left_anti").select(self._shard(), "k")
        grown = self.filters.groupBy("shard").cogroup(risen.groupBy("shard")).applyInArrow(_learn, "shard long, filter binary")
        grown = self.work.save(grown, "filters")
        self.counts = counts
        full = grown.where("filter is null").select("shard")
        again = hot.select(self._shard(), "k").join(F.broadcast(full), "shard").groupBy("shard").applyInArrow(_build, "shard long, filter binary")
        filters = self.work.save(grown.where("filter is not null").unionByName(again), "filters")
        self.work.drop(old, grown, self.filters)
        self.filters = filters
        return self

    def _build_filters(self) -> LineIndex:
        self.shards = max(1, -(-self.hot().count() // self.shard_keys))
        build = self.hot().select(self._shard(), "k").groupBy("shard").applyInArrow(_build, "shard long, filter binary")
        old, self.filters = self.filters, self.work.save(build, "filters")
        if old is not None:
            self.work.drop(old)
        return self

    def delete(self, ids: DataFrame) -> LineIndex:
        """Takes documents (column doc_id) out again: counts fall, and keys that fall below the limit leave the filters."""
        ids = ids.select("doc_id").distinct()
        gone = self.postings.join(ids, "doc_id", "left_semi")
        touched = gone.select("k").distinct()
        left = self.work.save(self.postings.join(ids, "doc_id", "left_anti").select("k", "doc_id"), "postings")
        again = self._count(left.join(touched, "k", "left_semi"))
        counts = self.work.save(self.counts.join(touched, "k", "left_anti").unionByName(again), "counts")
        cold = self.hot().join(counts.where(F.col("n_docs") >= self.min_docs), "k", "left_anti").select(self._shard(), "k")
        changed = self.filters.groupBy("shard").cogroup(cold.groupBy("shard")).applyInArrow(_forget, "shard long, filter binary")
        filters = self.work.save(changed, "filters")
        old = (*self.parts, self.counts, self.filters)
        self.parts, self.counts, self.filters = [left], counts, filters
        self.work.drop(*old)
        return self

    def candidates(self, posted: DataFrame) -> DataFrame:
        """The postings that the filters pass."""
        posted = posted.select("k", "doc_id", self._shard())
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        if size > self.filter_bytes:
            salts = -(-(self.counts.agg(F.sum("n_docs")).first()[0] or 0) // (self.shards * self.task_postings))
            dealt = posted.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, salts))).cast("int"))
            filters = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(max(1, salts) - 1))))
            return dealt.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInArrow(_passed, "k binary, doc_id long")
        by = {r["shard"]: bytes(r["filter"]) for r in self.filters.collect()}  # filter_bytes at most
        shared = self.spark.sparkContext.broadcast(by)

        def probe(batches):
            filters = {s: Cuckoo.from_bytes(b) for s, b in shared.value.items()}
            for t in batches:
                if not len(t):
                    continue
                keys, shard = _keys(t.column(0)), np.array(t.column(2))
                ok = np.zeros(len(t), dtype=bool)
                for s, f in filters.items():
                    at = np.flatnonzero(shard == s)
                    if len(at):
                        ok[at] = f.has(keys[at])
                yield t.filter(pa.array(ok)).select([0, 1])

        return posted.mapInArrow(probe, "k binary, doc_id long")

    def apply(self, docs: DataFrame, posted: DataFrame | None = None, counts: bool = True) -> DataFrame:
        """docs without their boilerplate lines, except in each line's largest holder: all columns of docs with the new
        text and, with counts, n_lines and n_dropped (input columns of these names give way). posted: the postings of
        docs, if they are known."""
        posted = postings(docs, self.min_chars).distinct() if posted is None else posted
        hot = self.work.save(self.hot().withColumnRenamed("n_docs", "n"), "hot")
        passed = self.work.save(self.candidates(posted), "passed")
        drops = by_groups(passed, hot, ["k"]).where("doc_id < largest")
        drops = drops.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("k").alias("_drop"))
        rest = [c for c in docs.columns if c != "text"]
        packed = docs.select(F.struct(*rest).alias("_row"), F.col("text").cast("binary").alias("_text"), F.col("doc_id").cast("long").alias("_own"))
        # the postings grow with the documents: their lines are always found by a merge join
        joined = packed.join(drops.hint("merge"), F.col("_own") == F.col("_id"), "left").select("_row", "_text", "_drop")
        row_type = joined.schema["_row"].dataType.simpleString()
        min_chars = self.min_chars

        def rewrite(batches):
            for b in batches:
                texts, n_lines, n_dropped = [], [], []
                for text, drop in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    n_lines.append(text.count(b"\n") + 1 if text else 1)
                    n_dropped.append(0)
                    if drop and text:
                        drop = set(drop)
                        kept = [x for x in text.split(b"\n") if len(x) < min_chars or line_key(x, min_chars) not in drop]
                        n_dropped[-1] = n_lines[-1] - len(kept)
                        text = b"\n".join(kept)
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["_row", "_text", "n_lines", "n_dropped"])

        out = joined.mapInArrow(rewrite, f"_row {row_type}, _text binary, n_lines long, n_dropped long")
        names = [c for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
        own = [F.col("_text").cast("string").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in names]
        return out.select(*own, *(["n_lines", "n_dropped"] if counts else []))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, counts: bool = True, **settings) -> DataFrame:
    index = LineIndex(spark, **settings).insert(docs)
    return index.apply(docs, index.postings, counts)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(spark, docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def dedup_sql(source: str = "documents") -> str:
    """DuckDB SQL of the query's columns and the text that is left (kept)."""
    return rf"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source})),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (
  SELECT k, max(doc_id) AS largest FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, coalesce(doc_id < largest, false) AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
FROM marked GROUP BY doc_id
"""


OP4_SQL = f"SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM ({dedup_sql()})"
