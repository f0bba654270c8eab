"""Simplification that keeps shared borders shared.

Rings are cut where borders meet: a point is a node if its occurrences in all rings do not all have the same two
neighbours. Between two nodes neighbouring polygons run over the same points, so these arcs, in one of their two directions,
are the same rows; each is simplified once, and rings are put together of simplified arcs again. So no gap and no overlap
opens along a border, whichever features share it. An arc is known by its first two points, its last and its length, as
every point between nodes has one way to go on.

Points are shuffled once by position to find nodes (pre-aggregated to two neighbour pairs a position), arcs by their
key; rows hold single rings and arcs, never features that are cut apart by others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import POINT, POLYGONS
from ..functions.simplify import kept

RING = ["fi", "pg", "r"]


def _rounded(ring: Column, digits: int) -> Column:
    return F.transform(ring, lambda p: F.struct(F.round(p["lon"], digits).alias("lon"), F.round(p["lat"], digits).alias("lat")))


def open_rings(features: DataFrame, digits: int = 6) -> DataFrame:
    """fi, pg, r, pts: every ring's points once, without the closing one and without repetitions of the point before."""
    parts = features.select("fi", F.posexplode("polygons").alias("pg", "_part"))
    rings = parts.select("fi", "pg", F.posexplode("_part").alias("r", "_ring")).select(*RING, _rounded(F.col("_ring"), digits).alias("_ring"))
    own = F.filter("_ring", lambda p, i: (i == 0) | (p != F.element_at("_ring", F.greatest(i, F.lit(1)))))
    rings = rings.select(*RING, own.alias("_ring"))
    closed = (F.size("_ring") > 1) & (F.element_at("_ring", 1) == F.element_at("_ring", -1))
    return rings.select(*RING, F.when(F.size("_ring") == 0, F.col("_ring")).when(closed, F.slice("_ring", F.lit(1), F.size("_ring") - 1)).otherwise(F.col("_ring")).alias("pts"))


def nodes(rings: DataFrame) -> DataFrame:
    """p: the points where not all rings go on alike."""
    n = F.size("pts")
    before = F.concat(F.slice("pts", n, F.lit(1)), F.slice("pts", F.lit(1), n - 1))
    after = F.concat(F.slice("pts", F.lit(2), n - 1), F.slice("pts", 1, 1))
    ways = rings.where(n > 0).select(F.explode(F.arrays_zip(F.col("pts").alias("p"), before.alias("a"), after.alias("b"))).alias("w"))
    ways = ways.select("w.p", F.struct(F.least("w.a", "w.b").alias("a"), F.greatest("w.a", "w.b").alias("b")).alias("way"))
    return ways.groupBy("p").agg(F.min("way").alias("least"), F.max("way").alias("most")).where("least <> most").select("p")


def arcs(rings: DataFrame) -> DataFrame:
    """fi, pg, r, j, turned, key, arc: every ring's arcs in order. turned: the ring runs over the arc backwards. A ring without
    nodes is one arc from its smallest point around to it."""
    places = rings.select(*RING, F.posexplode("pts").alias("i", "p"))
    cuts = places.join(nodes(rings), "p").groupBy(*RING).agg(F.array_sort(F.collect_list("i")).alias("at"))
    smallest = F.array((F.array_position("pts", F.array_min("pts")) - 1).cast("int"))
    cut = rings.where(F.size("pts") > 0).join(cuts, RING, "left").withColumn("at", F.coalesce("at", smallest))
    cut = cut.select(*RING, "pts", F.posexplode(F.zip_with("at", F.concat(F.slice("at", F.lit(2), F.size("at") - 1), F.array(F.get("at", F.lit(0)) + F.size("pts"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("j", "s"))
    arc = F.slice(F.concat("pts", "pts", F.slice("pts", 1, 1)), F.col("s.a") + 1, F.col("s.b") - F.col("s.a") + 1)
    cut = cut.select(*RING, "j", arc.alias("way")).withColumn("back", F.reverse("way"))
    cut = cut.select(*RING, "j", (F.col("back") < F.col("way")).alias("turned"), F.least("way", "back").alias("arc"))
    key = F.struct(F.element_at("arc", 1).alias("a"), F.element_at("arc", 2).alias("b"), F.element_at("arc", -1).alias("z"), F.size("arc").alias("n"))
    return cut.withColumn("key", key)


def _simplified(distinct: DataFrame, metres: float) -> DataFrame:
    """key, line, spare: each arc simplified, and with at least one point between its ends (two, if it is closed)."""
    line = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))

    def run(batches):
        for b in batches:
            column = b.column("arc")
            offsets = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            flat = column.flatten()
            xy = np.column_stack([flat.field("lon").to_numpy(zero_copy_only=False), flat.field("lat").to_numpy(zero_copy_only=False)])
            lines = []
            for least in (0, 1):
                keep = np.zeros(len(xy), bool)
                for a, e in zip(offsets, offsets[1:]):
                    own = xy[a:e]
                    keep[a:e] = kept(own, metres, least + (least and bool((own[0] == own[-1]).all())))
                starts = np.concatenate([[0], np.cumsum(keep)])[offsets]
                points = pa.StructArray.from_arrays([pa.array(xy[keep, 0]), pa.array(xy[keep, 1])], ["lon", "lat"])
                lines.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), points).cast(line))
            yield pa.RecordBatch.from_arrays([b.column("key"), *lines], ["key", "line", "spare"])

    kind = distinct.schema["key"].dataType.simpleString()
    return distinct.mapInArrow(run, f"key {kind}, line array<{POINT}>, spare array<{POINT}>")


def simplify_layer(features: DataFrame, metres: float = 200.0, digits: int = 6) -> DataFrame:
    """features (fi, polygons, others) with simplified polygons. Every ring stays: one that would be left with less than three
    sides keeps a point more in each of its arcs, and so do the rings that share them. A ring begins at its first node.
    Coordinates are rounded to digits first, as borders are shared only where they are equal; a missing geometry stays so."""
    cut = arcs(open_rings(features.select("fi", "polygons"), digits))
    lines = _simplified(cut.groupBy("key").agg(F.first("arc").alias("arc")), metres)
    laid = cut.select(*RING, "j", "turned", "key").join(lines, "key")
    flat = laid.groupBy(*RING).agg(F.sum(F.size("line") - 1).alias("sides"), F.collect_set("key").alias("keys")).where("sides < 3")
    spared = flat.select(F.explode("keys").alias("key")).distinct().withColumn("_spared", F.lit(True))
    laid = laid.join(spared, "key", "left").withColumn("line", F.when(F.col("_spared"), F.col("spare")).otherwise(F.col("line")))
    laid = laid.select(*RING, "j", F.when(F.col("turned"), F.reverse("line")).otherwise(F.col("line")).alias("line"))
    rings = laid.groupBy(*RING).agg(F.array_sort(F.collect_list(F.struct("j", "line"))).alias("lines"))
    open_ = F.flatten(F.transform("lines", lambda x: F.slice(x["line"], F.lit(1), F.size(x["line"]) - 1)))
    rings = rings.select(*RING, open_.alias("o")).select(*RING, F.concat("o", F.slice("o", 1, 1)).alias("ring"))
    parts = rings.groupBy("fi", "pg").agg(F.array_sort(F.collect_list(F.struct("r", "ring"))).alias("rings"))
    parts = parts.select("fi", "pg", F.transform("rings", lambda x: x["ring"]).alias("part"))
    whole = parts.groupBy("fi").agg(F.array_sort(F.collect_list(F.struct("pg", "part"))).alias("parts"))
    whole = whole.select(F.col("fi").alias("_fi"), F.transform("parts", lambda x: x["part"]).cast(POLYGONS).alias("_polygons"))
    out = features.join(whole, F.col("fi") == F.col("_fi"), "left")
    return out.select(*[F.coalesce("_polygons", "polygons").alias("polygons") if c == "polygons" else F.col(c) for c in features.columns])
