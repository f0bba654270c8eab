"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents are put in a shuffled order that depends on doc_id alone (its MD5) and laid end to end on a
line of tokens, cut into blocks of ``block_tokens``. The mix is a sequence of slots: slot i takes the point
frac(i * golden ratio) and maps it through the cumulative weights to a source, so that every stretch of the
sequence holds the sources in nearly their proportions. A slot's rank among its source's slots says which
block it takes (it says when in the mix, not how much of a source is taken in all, which its target alone decides): ranks run through the source's blocks once, then again for a second epoch. The last block that a
source takes is cut where its target ends, and blocks that no slot takes add nothing, so every source's total is its
target without the fraction. Positions on the lines and ranks are prefix sums in three steps, over small buckets,
runs of buckets and runs of those; no task holds a source, or all buckets of one.

Defined cases: a null or empty text has size 0 and is never taken; a very long text is cut like any other where
blocks end; a null source is a source of its own, last in order; repeated rows are separate documents; rows of equal
doc_id in a source are ordered by size, and of equal size too, it is the same whichever comes first; an empty table
gives an empty result; other columns are ignored. One row per source goes to the driver, of which ``max_sources``
are allowed (more raise an error).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import SPACE_WORD, Work, table

GOLDEN = 0.6180339887498949


def prefix_sums(df: DataFrame, group: str, bucket: str, order: list, value: str, out: str, run: int = 4096, steps: int = 3) -> DataFrame:
    """Adds the sum of value over the rows before each row of its group, ordered by bucket (numbers from 0) and then
    order. Buckets are small; their totals are summed along runs of buckets, and only the last step's along a group."""
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias(f"_t{steps}"))
    if steps > 2:
        totals = totals.withColumn(f"_run{steps}", F.expr(f"{bucket} div {run}"))
        totals = prefix_sums(totals, group, f"_run{steps}", [bucket], f"_t{steps}", "_before", run, steps - 1).select(group, bucket, "_before")
    else:
        before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(group, bucket, F.coalesce(F.sum(f"_t{steps}").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(totals.withColumnRenamed("_before", f"_b{steps}"), [group, bucket]).withColumn(out, F.col(out) + F.col(f"_b{steps}")).drop(f"_b{steps}")


def share(sizes: list[int], weights: list[float], factor: float, cap: float) -> list[float]:
    """factor * sum(sizes) dealt by weight; shares stop at cap * size, the excess is dealt again."""
    target = [0.0] * len(sizes)
    left, open_ = factor * sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = float(cap * sizes[i])
            left -= target[i]
        full = set(full)
        open_ = [i for i in open_ if i not in full]
    return target


class Mix:
    """A mix of documents (doc_id, source, text): .documents has what it takes of each, in how many slots and in which one
    first, .slots the schedule."""

    def __init__(self, spark: SparkSession, docs: DataFrame, weights=(5.0, 2.0, 1.0), factor: float = 1.5, cap: float = 2.0, block_tokens: int = 8192, bucket_rows: int = 512, max_sources: int = 1_000_000):
        work = Work(spark, "mixing")
        sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"))
        sized = work.save(sized, "sizes")
        rows = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(max_sources + 1).collect()
        if len(rows) > max_sources:
            raise ValueError(f"over {max_sources} sources: raise max_sources to mix them")
        rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["s"] for r in rows]
        targets = share(sizes, [weights[i % len(weights)] for i in range(len(rows))], factor, cap)
        plan = []
        for i, (r, goal) in enumerate(zip(rows, targets)):
            epochs, rest = divmod(int(goal), r["s"]) if r["s"] else (0, 0)
            blocks = -(-r["s"] // block_tokens)
            plan.append((i, r["source"], r["s"], goal, int(-(-r["n"] // bucket_rows)), int(epochs), int(rest), int(blocks), int(epochs * blocks - (-rest // block_tokens))))
        self.sources = spark.createDataFrame(plan, "src int, source string, source_size long, target double, buckets int, epochs long, rest long, blocks long, ranks long")
        self.slots = self._slots(spark, plan)
        self.documents = self._documents(sized, block_tokens)

    def _slots(self, spark: SparkSession, plan: list[tuple]) -> DataFrame:
        """(slot, src, rank, epoch, block, ends): the schedule. ends: where the slot's epoch ends on the source's line."""
        n = sum(p[8] for p in plan)
        cells, at, parts = max(1024, len(plan)), 0, []
        for p in plan:
            if p[8]:
                lo, hi = at / n, (at + p[8]) / n
                parts += [(c, p[0], lo, hi) for c in range(int(lo * cells), min(cells - 1, int(hi * cells)) + 1)]
                at += p[8]
        parts = spark.createDataFrame(parts, "cell int, src int, lo double, hi double")
        point = F.col("slot").cast("double") * F.lit(GOLDEN)
        points = spark.range(n).withColumnRenamed("id", "slot").withColumn("x", point - F.floor(point))
        points = points.withColumn("cell", F.floor(F.col("x") * cells).cast("int"))
        drawn = points.join(parts, "cell").where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
        drawn = drawn.select("slot", "src", F.floor(F.col("slot") / 4096).alias("chunk"), F.lit(1).alias("one"))
        ranked = prefix_sums(drawn, "src", "chunk", ["slot"], "one", "rank").select("slot", "src", "rank")
        drawn_by = drawn.groupBy("src").agg(F.sum("one").alias("drawn"))
        short = self.sources.select("src", "ranks").join(drawn_by, "src", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        short = short.where("drawn < ranks").select("src", F.explode(F.expr("sequence(drawn, ranks - 1)")).alias("rank"))
        slots = ranked.unionByName(short.select((F.lit(n) + F.col("rank")).alias("slot"), "src", "rank"))
        s = self.sources.select("src", "source_size", "epochs", "rest", "blocks", "ranks")
        slots = slots.join(s, "src").where(F.col("rank") < F.col("ranks")).withColumn("epoch", F.expr("rank div blocks"))
        ends = F.when(F.col("epoch") < F.col("epochs"), F.col("source_size")).otherwise(F.col("rest"))
        return slots.select("slot", "src", "rank", "epoch", F.expr("rank % blocks").alias("block"), ends.alias("ends"))

    def _documents(self, sized: DataFrame, block_tokens: int) -> DataFrame:
        s = self.sources.select("src", F.col("source").alias("_s"), "source_size", "target", "buckets")
        line = sized.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        order = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
        line = line.withColumn("u", order).withColumn("bucket", F.least(F.floor(F.col("u") / F.lit(2.0**60) * F.col("buckets")), F.col("buckets") - 1))
        none = line.where("size = 0").select("doc_id", "source", "size", "source_size", "target", *[F.lit(x).cast("long").alias(c) for c, x in (("taken", 0), ("n_slots", 0), ("first_slot", None))])
        line = prefix_sums(line.where("size > 0"), "src", "bucket", ["u", "doc_id", "size"], "size", "start")
        block = F.explode(F.expr(f"sequence(start div {block_tokens}, (start + size - 1) div {block_tokens})")).alias("block")
        pieces = line.select("doc_id", "source", "size", "source_size", "target", "src", "start", block)
        lo = F.greatest(F.col("start"), F.col("block") * block_tokens)
        hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_tokens)
        pieces = pieces.withColumn("lo", lo).withColumn("hi", hi)
        # a block without a slot has no end: least() alone would skip it and count the block as taken
        got = F.when(F.col("ends").isNotNull(), F.greatest(F.lit(0), F.least(F.col("hi"), F.col("ends")) - F.col("lo")))
        joined = pieces.join(self.slots.select("src", "block", "slot", "ends"), ["src", "block"], "left").withColumn("got", got)
        taken = F.coalesce(F.sum("got"), F.lit(0)).cast("long").alias("taken")
        taking = F.when(F.col("got") > 0, F.col("slot"))
        some = joined.groupBy("src", "start", "doc_id", "source", "size", "source_size", "target").agg(taken, F.count(taking).alias("n_slots"), F.min(taking).alias("first_slot"))
        return some.select(*none.columns).unionByName(none)


def mix(spark: SparkSession, docs: DataFrame, **settings) -> DataFrame:
    return Mix(spark, docs, **settings).documents


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "n_slots", "first_slot")


def mix_sql(source: str = "documents", slots: bool = False, block_tokens: int = 8192) -> str:
    """DuckDB SQL of a mix, with slots of op10's rows. Without them: whatever the order of slots, a source takes its line whole
    once an epoch and then the line's beginning, so what is taken of a document follows from its place on the line. With
    them every slot is drawn, ranked and joined with the documents of its block. Targets: sources in order of size by
    weight are full as long as an even share of what is left exceeds their cap."""
    rows = """
SELECT doc_id, line.source AS source, size, s AS source_size, target, epochs * size + greatest(0, least(size, rest - start)) AS taken
FROM line JOIN cut ON line.source IS NOT DISTINCT FROM cut.source
"""
    drawn = f""",
plan AS (
  SELECT *, CAST(coalesce(sum(ranks) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(sum(ranks) OVER () AS BIGINT) AS n
  FROM (SELECT *, (s + {block_tokens} - 1) // {block_tokens} AS blocks, epochs * ((s + {block_tokens} - 1) // {block_tokens}) + (rest + {block_tokens} - 1) // {block_tokens} AS ranks FROM cut)),
point AS (
  SELECT slot, CAST(slot AS DOUBLE) * {GOLDEN}::DOUBLE - floor(CAST(slot AS DOUBLE) * {GOLDEN}::DOUBLE) AS x
  FROM (SELECT unnest(generate_series(0, coalesce((SELECT max(n) FROM plan), 0) - 1)) AS slot)),
ranked AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM point JOIN plan ON x >= before / CAST(n AS DOUBLE) AND x < (before + ranks) / CAST(n AS DOUBLE)),
short AS (
  SELECT source, n, unnest(generate_series(coalesce((SELECT count(*) FROM ranked r WHERE r.source IS NOT DISTINCT FROM plan.source), 0), ranks - 1)) AS rank FROM plan),
slots AS (
  SELECT p.source, slot, rank % blocks AS block, CASE WHEN rank // blocks < epochs THEN s ELSE rest END AS ends
  FROM (SELECT source, slot, rank FROM ranked UNION ALL SELECT source, n + rank, rank FROM short) r
  JOIN plan p ON r.source IS NOT DISTINCT FROM p.source WHERE rank < ranks),
got AS (
  SELECT l.doc_id, l.source, l.start, slot, least(start + size, (block + 1) * {block_tokens}, ends) - greatest(start, block * {block_tokens}) AS words
  FROM line l JOIN slots b ON l.source IS NOT DISTINCT FROM b.source AND block * {block_tokens} < start + size AND (block + 1) * {block_tokens} > start
  WHERE size > 0),
summed AS (
  SELECT doc_id, source, start, sum(words) AS taken, count(*) AS n_slots, min(slot) AS first_slot FROM got WHERE words > 0 GROUP BY doc_id, source, start)
SELECT line.doc_id, line.source, size, CAST(cut.s AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken,
       coalesce(n_slots, 0) AS n_slots, CAST(first_slot AS BIGINT) AS first_slot
FROM line JOIN cut ON line.source IS NOT DISTINCT FROM cut.source
LEFT JOIN summed g ON size > 0 AND g.doc_id IS NOT DISTINCT FROM line.doc_id AND g.source IS NOT DISTINCT FROM line.source AND g.start = line.start
"""
    return rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS u FROM {source}),
src AS (
  SELECT source, s, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 1.5::DOUBLE * sum(s) OVER () AS total
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source)),
filled AS (
  SELECT *, (total - coalesce(sum(2 * s) OVER (ORDER BY s / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
            / sum(w) OVER (ORDER BY s / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > 2 * s AS is_full
  FROM src WHERE s > 0),
goals AS (
  SELECT source, s, CAST(CASE WHEN is_full THEN 2 * s ELSE (total - coalesce(sum(2 * s) FILTER (is_full) OVER (), 0)) * w / sum(w) FILTER (NOT is_full) OVER () END AS DOUBLE) AS target
  FROM filled UNION ALL SELECT source, s, 0 FROM src WHERE s = 0),
line AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized),
cut AS (SELECT *, CAST(floor(target) AS BIGINT) // greatest(s, 1) AS epochs, CAST(floor(target) AS BIGINT) % greatest(s, 1) AS rest FROM goals){drawn if slots else rows}"""


OP10_SQL = mix_sql(slots=True)
