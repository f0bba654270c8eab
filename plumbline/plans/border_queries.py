"""Queries of simplified layers: nations as a grid of 5 x 5 areas whose borders bend once and wobble by a few metres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.topology import simplify_layer
from .queries import _num, _t

WIDE, HIGH = 24, 20


def _line(n: int, x: str, y: str, wobble: str) -> Column:
    """n + 1 points by k, as expressions."""
    shake = f"IF(k * 2 % {n} = 0, 0, ((k * 7 + {wobble}) % 9 - 4) / 100000)"
    point = f"named_struct('lon', CAST(round({x.replace('SHAKE', shake)}, 6) AS DOUBLE), 'lat', CAST(round({y.replace('SHAKE', shake)}, 6) AS DOUBLE))"
    return F.expr(f"transform(sequence(0, {n}), k -> {point})")


def wobbling(spark: SparkSession, d: str) -> DataFrame:
    """Features fi, polygons: each nation's four borders, those of neighbours the same points."""
    up = lambda g, r: _line(HIGH, f"{WIDE} * {g} - 60 + least(k, {HIGH} - k) / 5 + SHAKE", f"{HIGH} * {r} - 50 + k", f"{g} * 5 + {r} * 3")
    along = lambda c, h: _line(WIDE, f"{WIDE} * {c} - 60 + k", f"{HIGH} * {h} - 50 + least(k, {WIDE} - k) / 8 + SHAKE", f"{c} * 4 + {h} * 2")
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("fi"), F.expr("n_nationkey % 5").alias("c"), F.expr("n_nationkey div 5").alias("r"))
    cut = lambda line, n: F.slice(line, 1, n)
    ring = F.concat(cut(along("c", "r"), WIDE), cut(up("(c + 1)", "r"), HIGH), cut(F.reverse(along("c", "(r + 1)")), WIDE), F.reverse(up("c", "r")))
    return n.select("fi", F.array(F.array(ring)).alias("polygons"))


def sides(features: DataFrame) -> DataFrame:
    """fi, x, y, nx, ny: every side of every ring, in millionths."""
    rings = features.select("fi", F.explode(F.flatten("polygons")).alias("ring"))
    pair = F.arrays_zip(F.slice("ring", F.lit(1), F.size("ring") - 1).alias("a"), F.slice("ring", F.lit(2), F.size("ring") - 1).alias("b"))
    whole = lambda c: F.round(F.col(c) * 1000000).cast("int")
    return rings.select("fi", F.explode(pair).alias("s")).select("fi", whole("s.a.lon").alias("x"), whole("s.a.lat").alias("y"), whole("s.b.lon").alias("nx"), whole("s.b.lat").alias("ny"))


def simplified_borders(spark: SparkSession, d: str) -> DataFrame:
    return sides(simplify_layer(wobbling(spark, d), 200.0))


_CORNERS = "(0, 0, 0, 0, 0), (1, 0, 0, 12, 1.5), (2, 1, 0, 0, 0), (3, 1, 0, 2, 10), (4, 1, 1, 0, 0), (5, 0, 1, 12, 1.5), (6, 0, 1, 0, 0), (7, 0, 0, 2, 10)"
SIMPLIFIED_BORDERS = f"""
WITH p AS (
  SELECT CAST(n_nationkey AS INTEGER) AS fi, i, CAST(1000000 * ({WIDE} * (n_nationkey % 5 + dc) - 60 + dx) AS INTEGER) AS x, CAST(1000000 * ({HIGH} * (n_nationkey // 5 + dr) - 50 + dy) AS INTEGER) AS y
  FROM nation, (VALUES {_CORNERS}) v(i, dc, dr, dx, dy))
SELECT a.fi, a.x, a.y, b.x AS nx, b.y AS ny FROM p a JOIN p b ON a.fi = b.fi AND b.i = (a.i + 1) % 8
"""


def shared_borders(spark: SparkSession, d: str) -> DataFrame:
    """Sides of the simplified layer by how many features run over them: inner borders have two, outer ones one."""
    s = simplified_borders(spark, d)
    a, b = F.array("x", "y"), F.array("nx", "ny")
    return s.groupBy(F.least(a, b), F.greatest(a, b)).agg(F.count("*").alias("features")).groupBy("features").agg(F.count("*").alias("sides"))


SHARED_BORDERS = "SELECT features, count(*) AS sides FROM (SELECT count(*) AS features FROM (" + SIMPLIFIED_BORDERS + ") GROUP BY least((x, y), (nx, ny)), greatest((x, y), (nx, ny))) GROUP BY features"

PAIRS = {"simplified_borders": (simplified_borders, SIMPLIFIED_BORDERS), "shared_borders": (shared_borders, SHARED_BORDERS)}
