"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Work, by_groups


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())


def components(work: Work, edges: DataFrame) -> DataFrame:
    """(id, label) for every id of edges (u, v), label being the smallest id of its component.

    Alternating large-star and small-star steps: in each, neighbours are hung on the smallest neighbour known. All
    is joins and minimum aggregations that combine before they shuffle; no neighbourhood is ever collected, and the edges
    of an id with very many stay where they are. Every round is a written table, so lineage stays short."""
    big, small = F.greatest("u", "v"), F.least("u", "v")
    e = work.save(edges.where("u <> v").select(big.alias("u"), small.alias("v")).distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.save(both.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("_m")).select("u", "n", F.least("u", "_m").alias("m")), "least")
        large = by_groups(both, least, ["u"], total=2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = work.save(large, "large")
        work.drop(least)
        least = work.save(large.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m")), "least")
        hung = by_groups(large, least, ["u"]).where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        hung = hung.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        after = work.save(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        work.drop(least)
        work.drop(e, large)
        new = _mark(after)
        e, done = after, new == mark
        mark = new
        if done:
            break
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)
