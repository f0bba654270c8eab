"""Removal of repeated byte strings by grouping suffixes by hashes, in place of a depth-limited radix sort.

A string of ``depth`` bytes is repeated if two suffixes agree through depth bytes. Nothing is
sorted, as only equality counts: a pass groups suffixes by a hash of their first bytes, groups of one are
done with, and only groups whose members still may differ go on to the next, deeper pass; the groups of the last
pass agree through all of depth and are exactly the repeated windows.

A pass need not hold every suffix. Of the suffixes in a window of depth bytes, a pass through k < depth bytes
takes the one whose first k bytes have the least hash (a minimiser), so equal windows take the same one, and
neighbouring windows share it: a record stands for a run of windows. A record also carries a hash of all that its
windows cover. Equal records mean that all of their windows are repeated, and are settled; where a group has
unlike records, one of each kind goes to the next pass. The passes go through 128, 352 and 400 bytes, that is,
they take about one suffix in 140, one in 25 and every one, but the later ones only where copies begin, end or
differ. All comparisons are of two independent 64-bit hashes.

All passes are aggregations and joins on hashes. A group of any size is summed before it moves; the records of large
groups (of more than 1 in 10,000 of all) are not moved at all, as what is known of these groups is broadcast.
Texts longer than ``SEGMENT`` bytes are read in segments.

Defined cases: null text is empty; texts shorter than depth bytes never lose anything; very long texts are read whole;
repeated rows are other places, so equal texts of at least depth bytes lose all their bytes; of suffixes with the same
least hash in a window the first is taken; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Work, by_groups, table
from .kernel import _powers, buffers, fixed_randoms, long, mix

SEGMENT = 1 << 18
_B1, _B2 = 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5
_T1, _T2 = fixed_randoms(21, 256), fixed_randoms(22, 256)
_CACHE: dict[int, tuple] = {}
U = np.uint64


def _tables(n: int) -> tuple:
    size = max(1 << 19, 1 << (n + 1).bit_length())
    if size not in _CACHE:
        _CACHE.clear()
        _CACHE[size] = tuple(_powers(size, b) for b in (_B1, pow(_B1, -1, 1 << 64), _B2, pow(_B2, -1, 1 << 64)))
    return _CACHE[size]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = w - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def records(b: np.ndarray, lo: int, hi: int, k: int, depth: int) -> tuple[np.ndarray, ...]:
    """For the windows that begin at lo..hi-1 of the bytes b: (hash of the taken suffix's first k bytes, hash of
    all that its windows cover, first window, last window) for each taken suffix."""
    b = b[lo : hi - 1 + depth]
    n = len(b)
    p1, i1, p2, i2 = _tables(n)
    with np.errstate(over="ignore"):
        s1 = np.zeros(n + 1, dtype=U)
        np.cumsum(_T1[b] * p1[:n], out=s1[1:])
        gram = (s1[k:] - s1[:-k]) * i1[: n - k + 1]
        w = depth - k + 1
        if w > 1:
            key = gram * U(0x9E3779B97F4A7C15)
            key &= U(0xFFFFFFFFFF000000)
            key |= np.arange(len(key), dtype=U)
            at = (sliding_min(key, w) & U(0xFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            last = np.r_[first[1:], len(at)] - 1
            at = at[first]
        else:
            at = first = last = np.arange(n - k + 1)
        s2 = np.zeros(n + 1, dtype=U)
        np.cumsum(_T2[b] * p2[:n], out=s2[1:])
        cover = (s2[last + depth] - s2[first]) * i2[first]
        shape = (at - first).astype(U) * U(1 << 20) + (last - first).astype(U)
        return mix(gram[at] + U(k)), mix(cover ^ mix(shape + U(1))), first + lo, last + lo


def _joined(spans: list[dict], depth: int) -> list[tuple[int, int]]:
    """Runs of windows, first and one past the last, where neighbours meet, in segments of bounded length."""
    out: list[list[int]] = []
    for x in sorted((s["lo"], s["hi"] + 1) for s in spans):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [(a, min(a + SEGMENT, y)) for x, y in out for a in range(x, y, SEGMENT)]


RECORD = "h long, g long, r1 long, r2 long, lo int, hi int"


def _scan(k: int, depth: int):
    """A pass over texts: columns r1, r2, text bytes and, but in the first pass, the runs of windows to look at."""

    def run(batches):
        for batch in batches:
            raw, off = buffers(batch.column(2))
            spans = batch.column(3).to_pylist() if batch.num_columns > 3 else None
            cols, rows = [[] for _ in range(4)], []
            for i in range(batch.num_rows):
                n = int(off[i + 1] - off[i])
                if n < depth:
                    continue
                own = raw[off[i] : off[i + 1]]
                runs = _joined(spans[i], depth) if spans else [(a, min(a + SEGMENT, n - depth + 1)) for a in range(0, n - depth + 1, SEGMENT)]
                for lo, hi in runs:
                    got = records(own, lo, hi, k, depth)
                    for c, x in zip(cols, got):
                        c.append(x)
                    rows.append((i, len(got[0])))
                if sum(x for _, x in rows) > 200_000:
                    yield _pack(batch, cols, rows)
                    cols, rows = [[] for _ in range(4)], []
            if rows:
                yield _pack(batch, cols, rows)

    return run


def _pack(batch, cols, rows) -> pa.RecordBatch:
    h, g, lo, hi = (np.concatenate(c) for c in cols)
    i = pa.array(np.repeat([x for x, _ in rows], [n for _, n in rows]))
    return pa.RecordBatch.from_arrays(
        [pa.array(long(h)), pa.array(long(g)), batch.column(0).take(i), batch.column(1).take(i), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
        ["h", "g", "r1", "r2", "lo", "hi"],
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """_row (all but the text), two hashes of the row (r1, r2), by which later passes find its text again, and _bytes."""
    rest = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = [c for c in rest if c == "doc_id"]
    return docs.select(F.struct(*rest).alias("_row"), F.xxhash64(*ids, text).alias("r1"), F.xxhash64(F.lit(1), text, *ids).alias("r2"), text.cast("binary").alias("_bytes"))


def repeated_windows(docs: DataFrame, work: Work, depth: int = 400, passes=(128, 352)) -> DataFrame:
    """(r1, r2, spans): for each row of keyed docs the runs of repeated windows, as first and last start."""
    texts = docs.where(F.octet_length("_bytes") >= depth).select("r1", "r2", F.col("_bytes").alias("text"))
    settled, open_ = [], None
    for k in (*passes, depth):
        source = texts if open_ is None else texts.join(open_.hint("merge"), ["r1", "r2"]).select("r1", "r2", "text", "spans")
        all_ = work.save(source.mapInArrow(_scan(k, depth), RECORD), f"pass{k}")
        groups = work.save(all_.groupBy("h").agg(F.count("*").alias("n"), (F.min("g") == F.max("g")).alias("alike")).where("n > 1"), f"groups{k}")
        shared = work.save(by_groups(all_, groups, ["h"]), f"shared{k}")
        work.drop(all_, groups)
        kinds = shared.groupBy("h", "g", "alike").agg(F.count("*").alias("n"), F.min(F.struct("r1", "r2", "lo", "hi")).alias("one"))
        kinds = work.save(kinds, f"kinds{k}")
        equal = by_groups(shared, kinds.where("n > 1").select("h", "g", "n"), ["h", "g"])
        settled.append(work.save(equal.select("r1", "r2", "lo", "hi"), f"settled{k}"))
        if k != depth:
            span = F.struct(F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"))
            mixed = kinds.where("not alike").select("one.r1", "one.r2", span.alias("span"))
            after = work.save(mixed.groupBy("r1", "r2").agg(F.collect_set("span").alias("spans")), f"open{k}")
        work.drop(shared, kinds, *([open_] if open_ is not None else []))
        open_ = after
    work.drop(open_)
    runs = settled[0]
    for x in settled[1:]:
        runs = runs.unionByName(x)
    out = work.save(runs.groupBy("r1", "r2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "runs")
    work.drop(*settled)
    return out


OUT = "n_bytes long, n_removed long, n_spans long, _kept binary"


def cut_repeats(spark: SparkSession, docs: DataFrame, depth: int = 400, passes=(128, 352)) -> DataFrame:
    """All columns of docs but text, and n_bytes, n_removed, n_spans and kept: the bytes that remain (they may end
    inside a character, so they are binary). Input columns of these names give way."""
    work = Work(spark, "suffixes")
    keyed = _keyed(docs)
    spans = repeated_windows(keyed, work, depth, passes)
    names = [c for c in docs.columns if c not in ("text", "n_bytes", "n_removed", "n_spans", "kept")]
    joined = keyed.join(spans.hint("merge"), ["r1", "r2"], "left").select("_row", "_bytes", "spans")
    row_type = joined.schema["_row"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            raw, off = buffers(b.column(1))
            out = []
            for i, spans in enumerate(b.column(2).to_pylist()):
                own = raw[off[i] : off[i + 1]]
                if not spans:
                    out.append((len(own), 0, 0, own.tobytes()))
                    continue
                change = np.zeros(len(own) + 1, dtype=np.int64)
                np.add.at(change, [s["lo"] for s in spans], 1)
                np.add.at(change, [s["hi"] + depth for s in spans], -1)
                gone = np.cumsum(change)[:-1] > 0
                begins = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(own), int(gone.sum()), begins, own[~gone].tobytes()))
            n, removed, count, kept = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["_row", "n_bytes", "n_removed", "n_spans", "_kept"])

    out = joined.mapInArrow(cut, f"_row {row_type}, {OUT}")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names], "n_bytes", "n_removed", "n_spans", F.col("_kept").alias("kept"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_repeats(spark, docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 400 bytes by its MD5.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (
  SELECT doc_id, i, md5(b[i:i + 399]) AS h FROM (SELECT doc_id, b, unnest(generate_series(1, octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
starts AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS fresh FROM w SEMI JOIN twice USING (h)),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 399 AS e FROM (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts) GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS s, a - 1 AS t FROM runs
  UNION ALL SELECT doc_id, max(e) + 1, NULL FROM runs GROUP BY doc_id),
left_over AS (
  SELECT doc_id, sha256(unhex(string_agg(hex(b[s:coalesce(t, octet_length(b))]), '' ORDER BY s))) AS kept_sha256 FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, CAST(sum(e - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256(b)) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
