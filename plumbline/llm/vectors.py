"""Product codes of vectors by Lloyd's method, kept up by differences.

Components become integers, vectors are cut into equal parts, and each part position has a codebook of ``entries``
integer vectors. Assignments of a round are a written table, and the sums and counts of every entry stay with the driver
(entries x dimension integers, whatever the number of vectors). A round reads vectors and their previous assignments
side by side, assigns again, and only parts whose assignment changed add their components to the new entry's sums and
take them from the old one's: a task adds up its own contributions, so one array of sums a task is shuffled, summed as a
tree, and none from a task where every part stayed. Without a change the codebooks are final and
the rounds end early.

Vectors are written once, bucketed by a row number, assignments likewise, so that a round joins them without moving
either. All arithmetic is in integers (in doubles as long as those hold every value exactly).

Defined cases: rows whose vector is null, or holds null or non-finite components, are dropped; the dimension is that of
the first vector by vec_id (then by components) whose length is a multiple of ``parts``, and vectors of another length
have a null code and error; fewer vectors than entries make smaller codebooks; distances that tie go to the lower index;
repeated rows count as often as they are there; a null vec_id comes last; null labels are one group; a component of 2^28
or more after scaling is an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import delete
from .common import Work, by_groups, shuffle_parts, table, tree_sum

LIMIT = 1 << 28


def scaled(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, q: rows with a usable vector, components as integers."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    fine = rows.where(F.col("embedding").isNotNull()).where(~F.coalesce(F.exists("embedding", odd), F.lit(True)))
    down = lambda x: F.floor(x.cast("double") * scale)
    large = F.raise_error(F.lit("a component is too large for exact codes")).cast("int")
    # Spark may work components out before it drops rows, so odd ones raise nothing
    q = F.transform("embedding", lambda x: F.when(odd(x), F.lit(None)).when(F.abs(down(x)) < LIMIT, down(x).cast("int")).otherwise(large))
    return fine.select("vec_id", "label", q.alias("q"))


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower) and the squared distance, exactly."""
    most = int(max(np.abs(part).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * part.shape[1] < 2**52 else np.int64
    x, c = part.astype(kind), entries.astype(kind)
    off = (c * c).sum(1) - 2 * (x @ c.T)
    best = off.argmin(1)
    d = off[np.arange(len(x)), best] + (x * x).sum(1)
    return best, d.astype(np.int64)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _codes(q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts, wide = books.shape[0], books.shape[2]
    found = [nearest(q[:, p * wide : (p + 1) * wide], books[p]) for p in range(parts)]
    return np.stack([f[0] for f in found], 1).astype(np.uint8), np.sum([f[1] for f in found], 0, dtype=np.int64)


def _changes(books: np.ndarray):
    """A task's new assignments; if any changed, its last row also holds what they add to sums and counts."""
    parts, entries, wide = books.shape

    def run(batches):
        total, held = np.zeros((parts, entries, wide + 1), np.int64), None
        schema = pa.schema([("rid", pa.int64()), ("code", pa.binary()), ("part", pa.int32()), ("delta", pa.binary())])
        part = TaskContext.get().partitionId()

        def made(rid, code, delta):
            n = len(rid)
            return pa.RecordBatch.from_arrays([rid, code, pa.array(np.full(n, part, np.int32)), pa.array([None] * (n - 1) + [delta], pa.binary())], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b, parts * wide)
            code, _ = _codes(q, books)
            before = b.column("before").to_pylist() if "before" in b.schema.names else None
            old = None if before is None else np.frombuffer(b"".join(before), np.uint8).reshape(-1, parts)
            for p in range(parts):
                own = np.column_stack([q[:, p * wide : (p + 1) * wide], np.ones(len(q), np.int64)])
                moved = slice(None) if old is None else np.flatnonzero(code[:, p] != old[:, p])
                np.add.at(total[p], code[moved, p], own[moved])
                if old is not None:
                    np.subtract.at(total[p], old[moved, p], own[moved])
            if held is not None:
                yield made(*held, None)
            held = b.column("rid"), pa.array([c.tobytes() for c in code], pa.binary())
        if held is not None:
            yield made(*held, total.tobytes() if total.any() else None)

    return run


def _final(books: np.ndarray):
    def run(batches):
        for b in batches:
            code, error = _codes(_matrix(b, books.shape[0] * books.shape[2]), books)
            texts = [c.tobytes().hex() for c in code]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(texts, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


class Bucketed:
    """Tables in a working folder, all bucketed alike by rid, so that they join without a shuffle."""

    def __init__(self, work: Work, buckets: int):
        self.work, self.buckets, self.tables = work, buckets, []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        full = f"plumbline_{name}_{uuid.uuid4().hex[:12]}"
        path = f"{self.work.base}/{full}"
        df.write.format("parquet").option("path", path).bucketBy(self.buckets, "rid").saveAsTable(full)
        out = self.work.spark.table(full)
        self.tables.append((full, path, out))
        return out

    def drop(self, *frames: DataFrame) -> None:
        for one in list(self.tables):
            if any(one[2] is f for f in frames):
                self.work.spark.sql(f"DROP TABLE IF EXISTS {one[0]}")
                delete(self.work.spark, one[1])
                self.tables.remove(one)
        self.work.tidy()


class Codes:
    """.rows: vec_id, label, code, error of each usable vector; .books: the codebooks (parts, entries, components);
    .moved: how many sums each round changed."""

    def __init__(self, spark: SparkSession, rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096):
        if not 0 < entries <= 256:
            raise ValueError("entries go from 1 to 256")
        work, self.moved = Work(spark, "codes"), []
        whole = scaled(rows, scale)
        fits = whole.where((F.size("q") > 0) & (F.size("q") % parts == 0))
        order = [F.col("vec_id").asc_nulls_last(), F.col("q")]
        one = fits.orderBy(*order).limit(1).collect()
        self.dim = len(one[0]["q"]) if one else 0
        none = whole.where(F.size("q") != self.dim).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        if not self.dim:
            self.rows, self.books = none, np.zeros((parts, 0, 0), np.int64)
            return
        own = fits.where(F.size("q") == self.dim)
        first = [r["q"] for r in own.orderBy(*order).limit(entries).collect()]
        books = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
        n, kept = shuffle_parts(spark), Bucketed(work, shuffle_parts(spark))
        vectors = kept.save(own.withColumn("rid", F.monotonically_increasing_id()).repartition(n, "rid"), "vectors")
        sums, last = np.zeros((*books.shape[:2], books.shape[2] + 1), object), None
        for r in range(rounds):
            seen = vectors.select("rid", "q")
            if last is not None:
                seen = seen.join(last.select("rid", F.col("code").alias("before")).hint("shuffle_hash"), "rid")
            codes = kept.save(seen.mapInArrow(_changes(books), "rid long, code binary, part int, delta binary"), f"codes{r}")
            deltas = codes.where("delta is not null").select(F.lit(0).alias("segment"), "part", F.col("delta").alias("counts"))
            moved = np.frombuffer(b"".join(bytes(x["counts"]) for x in tree_sum(deltas, max(n, seen.rdd.getNumPartitions())).collect()), "<i8")
            if last is not None:
                kept.drop(last)
            last = codes
            self.moved.append(int(np.count_nonzero(moved)))
            if not self.moved[-1]:
                break
            sums += moved.reshape(sums.shape).astype(object)
            for p in range(parts):
                for e in range(books.shape[1]):
                    if sums[p, e, -1]:
                        books[p, e] = [s // sums[p, e, -1] for s in sums[p, e, :-1]]
        self.books = books
        coded = vectors.select("vec_id", "label", "q").mapInArrow(_final(books), own.select("vec_id", "label").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema)
        self.rows = work.save(coded.unionByName(none), "coded")
        kept.drop(last, vectors)
        self.work = work

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()

    def with_label_errors(self) -> DataFrame:
        """rows and label_error: the errors summed over rows of equal label, null labels together."""
        keyed = self.rows.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(0))})
        if not self.dim:
            return self.rows.withColumn("label_error", F.lit(None).cast("long"))
        groups = self.work.save(keyed.groupBy("_none", "_label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "labels")
        return by_groups(keyed, groups, ["_none", "_label"]).drop("_none", "_label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = Codes(spark, table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    out = codes.with_label_errors()
    return out.select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every round as a table of assignments and a table of entries."""
    assign = """a{r} AS MATERIALIZED (SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT x.rid, x.p, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM part x JOIN b{r} c USING (p)) GROUP BY rid, p)"""
    update = """m{s} AS MATERIALIZED (SELECT p, e, list(v ORDER BY i) AS v FROM (
  SELECT p, e, i, CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
  FROM (SELECT x.p, a.e, unnest(x.v) AS y, generate_subscripts(x.v, 1) AS i FROM part x JOIN a{r} a USING (rid, p)) GROUP BY p, e, i) GROUP BY p, e),
b{s} AS MATERIALIZED (SELECT p, e, coalesce(m{s}.v, b{r}.v) AS v FROM b{r} LEFT JOIN m{s} USING (p, e))"""
    steps = [f"{assign.format(r=r)},\n{update.format(r=r, s=r + 1)}" for r in range(rounds)] + [assign.format(r=rounds)]
    return f"""
WITH vec AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS rid, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
part AS MATERIALIZED (SELECT rid, p, q[p * len(q) // {parts} + 1 : (p + 1) * len(q) // {parts}] AS v FROM vec, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, rid AS e, v FROM part WHERE rid < {entries}),
{','.join(steps)},
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM vec JOIN coded USING (rid), digest
"""


OP12_SQL = _sql()
