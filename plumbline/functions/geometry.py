"""Polygons as nested arrays: parts, rings, points. All are column expressions, so plans stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .coords import quantize

POINT = "struct<lon:double,lat:double>"
POLYGONS = f"array<array<array<{POINT}>>>"  # parts, rings (the first is the outer one), points


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def box(lon0, lat0, lon1, lat1) -> Column:
    """A rectangle as a closed ring of columns or numbers."""
    c = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    corner = lambda x, y: F.struct(c(x).cast("double").alias("lon"), c(y).cast("double").alias("lat"))
    return F.array(corner(lon0, lat0), corner(lon1, lat0), corner(lon1, lat1), corner(lon0, lat1), corner(lon0, lat0))


def bbox(polygons: Column) -> Column:
    """Raw degrees over all points; null without points."""
    points = F.flatten(F.flatten(polygons))
    xs, ys = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(xs).alias("min_lon"), F.array_min(ys).alias("min_lat"), F.array_max(xs).alias("max_lon"), F.array_max(ys).alias("max_lat"))


def _ring(points: Column) -> Column:
    q = F.transform(points, lambda p: F.struct(quantize(p["lon"]).alias("x"), quantize(p["lat"]).alias("y")))
    xs, ys = F.transform(q, lambda p: p["x"]), F.transform(q, lambda p: p["y"])
    return F.struct(
        F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")).alias("bbox"),
        xs.alias("xs"), ys.alias("ys"),
    )


def rings(polygons: Column) -> Column:
    """Quantised rings with their boxes: array<array<struct<bbox, xs, ys>>>."""
    return F.transform(polygons, lambda part: F.transform(part, _ring))


def ring_edges(ring: Column) -> Column:
    """Edges (xi, yi, xj, yj) of a quantised ring in doubles, point i with the point before it. Level edges never
    count in a ray cast and are left out."""
    n = F.size(ring["xs"])
    back = lambda a: F.concat(F.slice(a, n, F.lit(1)), F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))))
    d = lambda c: c.cast("double")
    zipped = F.arrays_zip(ring["xs"].alias("xi"), ring["ys"].alias("yi"), back(ring["xs"]).alias("xj"), back(ring["ys"]).alias("yj"))
    edges = F.transform(zipped, lambda e: F.struct(d(e["xi"]).alias("xi"), d(e["yi"]).alias("yi"), d(e["xj"]).alias("xj"), d(e["yj"]).alias("yj")))
    edges = F.when(n > 0, edges).otherwise(F.array().cast("array<struct<xi:double,yi:double,xj:double,yj:double>>"))
    return F.filter(edges, lambda e: e["yi"] != e["yj"])


def prepared(polygons: Column) -> Column:
    """What the exact test reads: array<array<struct<bbox, edges>>>. Parts without rings match nothing and go."""
    ready = F.transform(rings(polygons), lambda part: F.transform(part, lambda r: F.struct(r["bbox"].alias("bbox"), ring_edges(r).alias("edges"))))
    return F.filter(ready, lambda part: F.size(part) > 0)


def crosses(e: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point to the right crosses an edge; left and bottom edges are inside, others not."""
    at = e["xj"] + (e["xi"] - e["xj"]) * (y - e["yj"]) / (e["yi"] - e["yj"])
    return ((e["yi"] > y) != (e["yj"] > y)) & (x < at)


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    b = ring["bbox"]
    near = x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"])
    odd = F.size(F.filter(ring["edges"], lambda e: crosses(e, x, y))) % 2 == 1
    return F.when(near, odd).otherwise(F.lit(False))


def contains(parts: Column, x: Column, y: Column) -> Column:
    """Even-odd over parts; a part's holes count only inside its own outer ring."""

    def toggles(part: Column) -> Column:
        holes = F.size(F.filter(F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0))), lambda r: in_ring(r, x, y)))
        return F.when(in_ring(F.get(part, F.lit(0)), x, y), holes + 1).otherwise(F.lit(0))

    return F.aggregate(parts, F.lit(0), lambda n, part: n + toggles(part)) % 2 == 1


def approx_area(polygons: Column) -> Column:
    """Square degrees of the outer rings, shrunk by the cosine of their mean latitude; holes are ignored."""

    def one(part: Column) -> Column:
        ring = F.get(part, F.lit(0))
        n = F.size(ring)
        before = F.concat(F.slice(ring, n, F.lit(1)), F.slice(ring, F.lit(1), n - 1))
        cross = F.zip_with(before, ring, lambda j, i: j["lon"] * i["lat"] - i["lon"] * j["lat"])
        mean = _sum(F.transform(ring, lambda p: p["lat"])) / n
        return F.when(n >= 4, F.abs(_sum(cross) / 2.0) * F.cos(mean * F.lit(3.141592653589793) / 180.0)).otherwise(F.lit(0.0))

    return _sum(F.transform(polygons, one))


def from_quantised(parts: Column) -> Column:
    """Quantised rings back to a GeoJSON geometry text."""
    position = lambda x, y: F.array(x / F.lit(1e6), y / F.lit(1e6))
    coordinates = F.transform(parts, lambda part: F.transform(part, lambda r: F.zip_with(r["xs"], r["ys"], position)))
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(coordinates, F.lit(0)).alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")))
    return F.when(F.size(parts) == 1, single).otherwise(multi)
