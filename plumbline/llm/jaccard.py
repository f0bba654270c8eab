"""N-gram Jaccard join with parity sketches.

A document is its set of distinct ``words``-word shingles; two link when 100 * intersection >= ``percent`` * union.
Linked sets differ in at most t = n (100 - percent) / percent shingles, n being the smaller size. Sizes fall into
bands; a band has a number of parts, more than the largest t in it, and a hash deals every shingle into one part.
The shingles of a part are XORed into a 64-bit parity sketch. Each differing shingle changes one part, so of
p = t + 1 + m parts at least m + 1 agree (pigeonhole); an equal part is a candidate, pairs with too few equal
parts are dropped. A set joins its own band and that of the smallest partner it may have.

Parts without shingles say nothing. A set with more than z of them is sketched again under another hash, up to
``SALTS`` times, and after the last its empty parts are sketched too, so a pair is never lost: at the first hash
under which one of the two has no more than z empty parts, m + 1 - z parts that are not empty agree.

Sets are first reduced to classes of equal sets, so copies are never paired. Sketches travel in packed blocks, a
few per batch and bucket. In a bucket, groups of up to ``pairs_below`` classes give their pairs with counts. The
members of larger groups are compared by wider bit sketches, whose Hamming distance cannot exceed the difference;
of the pairs within the bound as many are kept as connect the members. Candidates make clusters (connected
components); a cluster's texts go to one task, which links classes: by size, then by Hamming distance, then exactly,
leaving out pairs that are already connected. So the links found connect all that any link connects. Groups and
clusters of more than ``block_rows`` classes, and clusters of more than ``block_shingles`` shingles, are dealt in
blocks, a task for every two of them.

Defined cases: null, empty or blank texts have no shingles, link with nothing and are their own component; very long
texts are read whole; a pair exactly at the threshold links; repeated rows are equal sets; a null doc_id is not linked and has a null component; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Work, by_groups, shuffle_parts, table
from .graph import components
from .kernel import VISIBLE, buffers, long, mix, shingle_sets, words as find_words

U = np.uint64
RATIO, SALTS = 1.35, 4


class Bands:
    """The size bands of a threshold and their numbers of parts."""

    def __init__(self, percent: int, top: int = 1 << 40):
        self.percent = percent
        least = -(-percent // (100 - percent))  # smaller sets link only with equal ones
        self.edges = [least]
        while self.edges[-1] < top:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * RATIO)))
        self.edges = np.array(self.edges)

    def most(self, n: int) -> int:
        """Shingles in which a set of n and one not smaller can differ at most."""
        return n * (100 - self.percent) // self.percent

    def of(self, n: int) -> list[int]:
        if n < self.edges[0]:
            return []
        small = -(-n * self.percent // 100)
        lo, hi = (int(np.searchsorted(self.edges, x, side="right")) - 1 for x in (small, n))
        return list(range(max(lo, 0), hi + 1))

    def parts(self, band: int) -> tuple[int, int, int]:
        """Parts of a band, empty parts that a set may have, equal parts that a pair needs."""
        t1 = self.most(int(self.edges[band + 1]) - 1) + 1
        m = 1 + t1 // 8
        z = 1 + (t1 + m) // 25
        return t1 + m, z, max(1, m + 1 - z)


def set_keys(sets: Iterator[np.ndarray]) -> tuple[list, list, list]:
    n, one, two = [], [], []
    with np.errstate(over="ignore"):
        for s in sets:
            n.append(len(s))
            one.append(s.sum(dtype=U) + U(len(s)))
            two.append(mix(s).sum(dtype=U) if len(s) else U(0))
    return n, mix(np.array(one, dtype=U)), mix(np.array(two, dtype=U))


def sketch(s: np.ndarray, bands: Bands) -> Iterator[tuple[int, np.ndarray]]:
    """(band, sketches) of a set, once for each band and hash that it needs."""
    for band in bands.of(len(s)):
        parts, z, _ = bands.parts(band)
        for salt in range(SALTS):
            tag = U((band * SALTS + salt) << 32)
            h = mix(s ^ mix(np.array([tag + U(5)], dtype=U)))
            part = (h >> U(20)) % U(parts)
            order = np.argsort(part)
            part = part[order]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            sig = np.bitwise_xor.reduceat(h[order], first)
            empty = parts - len(first)
            yield band, mix(sig + mix(part[first] + tag))
            if empty <= z:
                break
        else:
            none = np.setdiff1d(np.arange(parts, dtype=U), part[first])
            yield band, mix(mix(none + tag) + U(99))


def wide_sketch(s: np.ndarray, bits: int = 0) -> np.ndarray:
    """One parity bit for each residue of the shingles' hashes, in words; a power of two, at least twice the set."""
    bits = bits or max(64, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s >> U(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def fold(w: np.ndarray, size: int) -> np.ndarray:
    """A wide sketch cut to fewer words: the sketch of the same set at that size."""
    while len(w) > size:
        w = w[: len(w) // 2] ^ w[len(w) // 2 :]
    return w


def near_pairs(n: np.ndarray, wide: np.ndarray, side: np.ndarray, percent: int, verify=None) -> list[tuple[int, int]]:
    """Pairs, by position in order of size n, that connect all that near pairs connect: sizes and Hamming distances
    within the bound, of different sides if there are two, and verify(r, q) where it is given."""
    comp, out, cross = np.arange(len(n)), [], side.any()
    for r in range(len(n)):
        most = n[r] * (100 - percent) // percent
        end = int(np.searchsorted(n, n[r] * 100 // percent, side="right"))
        for at in range(r + 1, end, 4096):
            to = min(end, at + 4096)
            left = np.flatnonzero((comp[at:to] != comp[r]) & ((side[at:to] != side[r]) | (not cross))) + at
            near = left[np.bitwise_count(wide[left] ^ wide[r]).sum(axis=1, dtype=np.int64) <= most]
            for q in near.tolist():
                if comp[q] != comp[r] and (verify is None or verify(r, q)):
                    comp[comp == comp[q]] = comp[r]
                    out.append((r, q))
    return out


def _bucket_groups(t: pa.Table, pairs_below: int):
    """From a bucket's packed sketches: candidate pairs (u, v) with counts, and of band 255 the members v of larger
    groups, u naming the group."""
    sig, key, band = [], [], []
    for k, s, i, b in zip(*(t[c].to_pylist() for c in ("keys", "sigs", "at", "bands"))):
        at = np.frombuffer(i, np.uint16)
        sig.append(np.frombuffer(s, U))
        key.append(np.frombuffer(k, np.int64)[at])
        band.append(np.frombuffer(b, np.uint8))
    sig, key, band = np.concatenate(sig), np.concatenate(key), np.concatenate(band)
    order = np.argsort(sig)
    sig = sig[order]
    same = sig[1:] == sig[:-1]
    keep = np.r_[False, same] | np.r_[same, False]
    sig, key, band = sig[keep], key[order][keep], band[order][keep]
    order = np.lexsort((key, sig))
    sig, key, band = sig[order], key[order], band[order]
    new = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])] if len(sig) else np.zeros(0, bool)
    sig, key, band = sig[new], key[new], band[new]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, int)
    size = np.diff(np.r_[first, len(sig)])
    a, b, at = [], [], []
    for n in range(2, pairs_below + 1):
        start = first[size == n]
        for i in range(n):
            for j in range(i + 1, n):
                a.append(key[start + i]), b.append(key[start + j]), at.append(band[start])
    hot = size > pairs_below
    of = np.repeat(np.arange(len(first)), size)
    many = hot[of]
    a.append(long(sig[many])), b.append(key[many]), at.append(np.full(int(many.sum()), 255, np.uint8))
    a, b, at = np.concatenate(a), np.concatenate(b), np.concatenate(at)
    order = np.lexsort((at, b, a))
    a, b, at = a[order], b[order], at[order]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (at[1:] != at[:-1])]) if len(a) else np.zeros(0, int)
    return pa.table({"u": a[start], "v": b[start], "band": at[start].astype(np.int32), "n": np.diff(np.r_[start, len(a)])})


def link_block(ids: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all that any link of the block connects. sides: 0, 1 for a pair of blocks, whose own pairs
    other tasks look at; else all 0."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    n = np.array([len(sets[i]) for i in order])
    bits = max(64, 1 << (4 * int(n.max()) - 1).bit_length())
    wide = np.stack([wide_sketch(sets[i], bits) for i in order])

    def same(r: int, q: int) -> bool:
        both = len(np.intersect1d(sets[order[r]], sets[order[q]], assume_unique=True))
        return 100 * both >= percent * (int(n[r]) + int(n[q]) - both)

    pairs = near_pairs(n, wide, np.array([sides[i] for i in order]), percent, same)
    return [(ids[order[r]], ids[order[q]]) for r, q in pairs]


def _near_block(keys: list[int], sides: list[int], sizes: list[int], wides: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Of a group's members, pairs that connect all within the bounds of size and Hamming distance."""
    order = sorted(range(len(keys)), key=lambda i: (sizes[i], keys[i]))
    own = [np.frombuffer(wides[i], U) for i in order]
    least = min(map(len, own))
    wide = np.stack([fold(w, least) for w in own])
    pairs = near_pairs(np.array([sizes[i] for i in order]), wide, np.array([sides[i] for i in order]), percent)
    return [(keys[order[r]], keys[order[q]]) for r, q in pairs]


def blocked(work: Work, rows: DataFrame, group: str, member: str, block_rows: int, weight: str | None = None, block_weight: int = 1) -> DataFrame:
    """rows with x, y, own: each member of a group of more than block_rows, or of more than block_weight in all, goes to
    every two blocks that hold its own."""
    count = F.ceil(F.count("*") / block_rows)
    count = F.greatest(count, F.ceil(F.sum(weight) / block_weight)) if weight else count
    sizes = work.save(rows.groupBy(group).agg(F.count("*").alias("n"), count.cast("int").alias("blocks")).where("blocks > 1"), "sizes")
    rows = by_groups(rows, sizes, [group], how="left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("blocks", "other")


class Join:
    """The join over docs (doc_id, text). .sets: a row per document with n_shingles and its class; .links: pairs of
    class representatives (smallest doc_ids) that connect all that links connect; .components."""

    def __init__(self, spark: SparkSession, docs: DataFrame, words: int = 4, percent: int = 85, pairs_below: int = 8, block_rows: int = 4000, bucket_sketches: int = 500_000, block_shingles: int = 4_000_000):
        self.work = work = Work(spark, "jaccard")
        bands = Bands(percent)
        docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

        def sets_of(column):
            h, at = find_words(*buffers(column), VISIBLE)
            return shingle_sets(h, at, words)

        def scan(batches):
            for b in batches:
                own = list(sets_of(b.column(1)))
                n, one, two = set_keys(iter(own))
                wide = [wide_sketch(s).tobytes() if len(s) >= bands.edges[0] else b"" for s in own]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(long(one)), pa.array(long(two)), pa.array(wide, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "wide"])

        self.sets = work.save(docs.mapInArrow(scan, "doc_id long, n_shingles long, k1 long, k2 long, wide binary"), "sets")
        total = self.sets.agg(F.sum("n_shingles")).first()[0] or 0
        factor = 2 * (100 - percent) / percent
        buckets = max(shuffle_parts(spark), int(total * factor / bucket_sketches) + 1)

        def sketches(batches):
            for b in batches:
                seen, sig, at, band, keys = set(), [], [], [], []
                all_sets = list(sets_of(b.column(1)))
                _, one, two = set_keys(iter(all_sets))
                for s, k, k2 in zip(all_sets, long(one).tolist(), two.tolist()):
                    if (k, k2) in seen or len(keys) == 65535:
                        if (k, k2) in seen:
                            continue
                        yield from _pack(sig, at, band, keys, buckets)
                        seen, sig, at, band, keys = set(), [], [], [], []
                    seen.add((k, k2))
                    for d, x in sketch(s, bands):
                        sig.append(x)
                        at.append(np.full(len(x), len(keys), np.uint16))
                        band.append(np.full(len(x), d, np.uint8))
                    keys.append(k)
                yield from _pack(sig, at, band, keys, buckets)

        packed = docs.mapInArrow(sketches, "bucket int, keys binary, sigs binary, at binary, bands binary")
        group = lambda t: _bucket_groups(t, pairs_below)
        found = work.save(packed.groupBy("bucket").applyInArrow(group, "u long, v long, band int, n long"), "found")
        need = {b: bands.parts(b)[2] for b in range(min(254, len(bands.edges) - 1))}
        enough = F.col("n") >= F.element_at(F.create_map(*[F.lit(x) for kv in need.items() for x in kv]), F.col("band"))
        pairs = found.where("band <> 255").groupBy("u", "v", "band").agg(F.sum("n").alias("n")).where(enough)
        groups = blocked(work, found.where("band = 255").select(F.col("u").alias("gid"), F.col("v").alias("key")), "gid", "key", block_rows)
        near = work.save(self._near(groups, percent), "near")
        cluster = work.save(components(work, pairs.select("u", "v").unionByName(near)), "clusters")
        work.drop(found, near)
        classes = self.sets.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"))
        self.classes = work.save(classes.where("rep is not null"), "classes")
        members = self.classes.join(cluster, F.col("k1") == F.col("id")).select("rep", "k1", "k2", "label", F.col("n").alias("shingles"))
        members = work.save(members, "members")
        work.drop(cluster)
        self.links = work.save(self._verify(docs, members, sets_of, percent, block_rows, block_shingles), "links")
        work.drop(members)
        labels = components(work, self.links)
        self.labels = work.save(labels, "labels")
        named = self.classes.join(self.labels, F.col("rep") == F.col("id"), "left").select("k1", "k2", F.coalesce("label", "rep").alias("component_id"))
        joined = self.sets.drop("wide").join(named, ["k1", "k2"], "left")
        own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        self.components = joined.select("doc_id", "n_shingles", own.alias("component_id"))

    def _near(self, groups, percent) -> DataFrame:
        """Pairs of keys that connect the members of large groups as far as sizes and wide sketches allow."""
        wide = self.sets.where("n_shingles > 0").groupBy("k1").agg(F.min(F.struct("n_shingles", "wide")).alias("w"))
        rows = groups.join(wide, F.col("key") == F.col("k1")).select("gid", "x", "y", "own", "key", "w.n_shingles", "w.wide")
        dealt = rows.repartition("gid", "x", "y").sortWithinPartitions("gid", "x", "y")

        def run(batches):
            here, own = None, ([], [], [], [])
            for b in batches:
                for gid, x, y, o, key, n, w in zip(*(c.to_pylist() for c in b.columns)):
                    if (gid, x, y) != here:
                        yield from _pairs(own[0], _near_block, own, percent)
                        here, own = (gid, x, y), ([], [], [], [])
                    for c, v in zip(own, (key, int(o != x), n, w)):
                        c.append(v)
            yield from _pairs(own[0], _near_block, own, percent)

        return dealt.mapInArrow(run, "u long, v long").distinct()

    def _verify(self, docs, members, sets_of, percent, block_rows, block_shingles) -> DataFrame:
        placed = blocked(self.work, members, "label", "rep", block_rows, "shingles", block_shingles)
        # the members grow with the documents: their texts are always found by a merge join
        texts = docs.join(placed.hint("merge"), F.col("doc_id") == F.col("rep")).select("label", "x", "y", "own", "rep", "k1", "k2", "text")
        dealt = texts.repartition("label", "x", "y").sortWithinPartitions("label", "x", "y")

        def run(batches):
            here, ids, sides, sets = None, [], [], []
            for b in batches:
                _, one, two = set_keys(iter(got := list(sets_of(b.column(7)))))
                cols = [b.column(i).to_pylist() for i in range(7)]
                for label, x, y, own, rep, k1, k2, s, o, t in zip(*cols, got, long(one).tolist(), long(two).tolist()):
                    if (label, x, y) != here:
                        yield from _pairs(ids, link_block, (ids, sides, sets), percent)
                        here, ids, sides, sets = (label, x, y), [], [], []
                    if (k1, k2) == (o, t):  # else another text of a repeated doc_id
                        ids.append(rep), sides.append(int(own != x)), sets.append(s)
            yield from _pairs(ids, link_block, (ids, sides, sets), percent)

        return dealt.mapInArrow(run, "u long, v long")


def _pairs(ids, compare, own, percent):
    if len(ids) > 1:
        got = compare(*own, percent)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["u", "v"])


def _pack(sig, at, band, keys, buckets):
    """The sketches of some documents, a row for each bucket that gets any."""
    if not sig:
        return
    sig, at, band, keys = np.concatenate(sig), np.concatenate(at), np.concatenate(band), np.array(keys, dtype=np.int64)
    bucket = (sig >> U(40)) % U(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, sig, at, band = bucket[order], sig[order], at[order], band[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rows = [[], [], [], [], []]
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(sig)]):
        used, local = np.unique(at[a:b], return_inverse=True)
        for c, x in zip(rows, (int(bucket[a]), keys[used].tobytes(), sig[a:b].tobytes(), local.astype(np.uint16).tobytes(), band[a:b].tobytes())):
            c.append(x)
    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], ["bucket", "keys", "sigs", "at", "bands"])


def _ids(spark: SparkSession, docs: DataFrame, again: DataFrame) -> DataFrame:
    """docs as (_row, _text, _key), where the second and further texts of a doc_id have keys of their own, behind all doc_ids."""
    work, text = Work(spark, "keep_one"), F.coalesce("_text", F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"), F.col("doc_id").cast("long").alias("_key"))
    rows = rows.withColumns({"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(1), text)})
    texts = rows.select("_key", "_h1", "_h2").join(again, "_key", "left_semi").distinct()
    first = texts.groupBy("_key").agg(F.min(F.struct("_h1", "_h2")).alias("_f")).select("_key", "_f.*")
    last = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
    more = texts.join(first, ["_key", "_h1", "_h2"], "left_anti").withColumn("_new", F.lit(last + 1) + F.monotonically_increasing_id())
    more = work.save(more, "more")  # the keys must not change when a plan runs again
    return work.save(rows.join(more, ["_key", "_h1", "_h2"], "left").select("_row", "_text", F.coalesce("_new", "_key").alias("_key")), "rows")


def keep_one(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but the first (smallest doc_id) document of each component. Rows without a doc_id stay. Rows that
    share a doc_id are one document only if their texts are equal; of its other texts each is a document by itself,
    which comes behind all doc_ids, so it goes only for an equal or linked text."""
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_key")).count().where("count > 1").select("_key")
    if again.isEmpty():
        gone = Join(spark, docs, words, percent).components.where("component_id <> doc_id").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti")
    rows = _ids(spark, docs, again)
    join = Join(spark, rows.select(F.col("_key").alias("doc_id"), F.col("_text").alias("text")), words, percent)
    kept = rows.join(join.components.where("component_id <> doc_id").select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti")
    equal = join.sets.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("_key")).count().where("count > 1").select("_key")
    once, more = kept.join(equal, "_key", "left_anti"), kept.join(equal, "_key", "left_semi")
    return once.unionByName(more.dropDuplicates(["_key"])).select("_row.*")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Join(spark, docs).components


def components_sql(source: str = "documents", words: int = 4, percent: int = 85) -> str:
    """DuckDB SQL of the components: every pair that shares a shingle is counted, and a recursion closes the links."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {source}),
g AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + {words - 1}) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {words - 1}, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM pair JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= {percent} * (a.n + b.n - k)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, link.v FROM reach JOIN link ON link.u = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


OP5_SQL = components_sql()
