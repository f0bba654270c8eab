"""Queries over the driver's tables. Points and layers are derived from their keys by whole-number arithmetic, alike in
Spark and SQL: nation makes a tessellation, region overlapping diamonds with holes and a second part, supplier small
boxes in one cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.coords import dequantize, js_number, quantize, valid_coord
from ..functions.geometry import bbox, box, rings
from ..functions.text import PALETTE, auto_color, clean_space, first_segment, slug
from ..operators import display, etl, grid
from ..operators.enrich import enrich, match_stats, preview
from .layer import Layer


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# points: a row per customer; three of fifty have odd cells

LON, LAT = "CAST((c_custkey * 7919) % 3600 AS DOUBLE) / 10 - 180", "CAST((c_custkey * 104729) % 1800 AS DOUBLE) / 10 - 90"


def points(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    odd = F.col("c_custkey") % 50
    lat = F.when(odd == 0, "abc").when(odd == 1, "").when(odd == 2, "95").otherwise(F.expr(LAT).cast("string"))
    return c.select("c_custkey", lat.alias("lat"), F.expr(LON).cast("string").alias("lon"), "c_mktsegment")


POINTS_SQL = f"""
points AS (
  SELECT c_custkey, c_mktsegment, {LON} AS lon,
         CASE c_custkey % 50 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 95 ELSE {LAT} END AS lat FROM customer),
good AS (SELECT c_custkey, round(lon * 1000000) AS x, floor(lat * 1000000 + 0.5) AS y FROM points WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND lat < 90 AND lon < 180)"""


# layers

def _num(sql: str) -> Column:
    return F.expr(sql).cast("double")


def tessellation(spark: SparkSession, d: str, selected: list[str] | None = None) -> Layer:
    n = _t(spark, d, "nation")
    ring = box(_num("-180 + 72 * (n_nationkey % 5)"), _num("-90 + 36 * (n_nationkey div 5)"), _num("-108 + 72 * (n_nationkey % 5)"), _num("-54 + 36 * (n_nationkey div 5)"))
    props = F.create_map(F.lit("n_name"), F.col("n_name"), F.lit("n_regionkey"), F.col("n_regionkey").cast("string"))
    features = n.select(F.col("n_nationkey").cast("int").alias("fi"), props.alias("props"), F.array(F.array(ring)).alias("polygons"))
    return Layer(features, "nation", "Nation", [("n_name", "Name"), ("n_regionkey", "Region key")], selected or ["n_name"])


def diamonds(spark: SparkSession, d: str, suggestion: str = "Zone", selected: list[str] | None = None) -> Layer:
    r = _t(spark, d, "region")
    cx, cy = "(-120 + 60 * r_regionkey)", "(-20 + 10 * r_regionkey)"
    at = lambda dx, dy: F.struct(_num(f"{cx} + {dx}").alias("lon"), _num(f"{cy} + {dy}").alias("lat"))
    outer = F.array(at(-50, 0), at(0, -45), at(50, 0), at(0, 45), at(-50, 0))
    hole = box(_num(f"{cx} - 10"), _num(f"{cy} - 10"), _num(f"{cx} + 10"), _num(f"{cy} + 10"))
    second = box(_num(f"{cx} + 20"), _num(f"{cy} - 5"), _num(f"{cx} + 70"), _num(f"{cy} + 5"))
    name = F.when(F.col("r_regionkey") == 2, "").otherwise(F.col("r_name"))
    props = F.create_map(F.lit("r_name"), name, F.lit("key"), F.col("r_regionkey").cast("string"))
    features = r.select(F.col("r_regionkey").cast("int").alias("fi"), props.alias("props"), F.array(F.array(outer, hole), F.array(second)).alias("polygons"))
    return Layer(features, "region", suggestion, [("r_name", "Name"), ("key", "Key")], selected or ["r_name"])


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Small boxes in a few cells; those of (10, 20) are many enough to be refined."""
    s = _t(spark, d, "supplier")
    lon, lat = "20 + CAST((s_suppkey * 37) % 100 AS DOUBLE) / 100", "10 + CAST((s_suppkey * 53) % 100 AS DOUBLE) / 100"
    ring = box(_num(lon), _num(lat), _num(f"{lon} + 0.15"), _num(f"{lat} + 0.15"))
    props = F.create_map(F.lit("s_name"), F.col("s_name"))
    return s.select(F.col("s_suppkey").cast("int").alias("fi"), props.alias("props"), F.array(F.array(ring)).alias("polygons"))


BOXES_SQL = """
boxes AS (SELECT s_suppkey, lon AS x0, lat AS y0, lon + 0.15::DOUBLE AS x1, lat + 0.15::DOUBLE AS y1 FROM (
  SELECT s_suppkey, 20 + CAST((s_suppkey * 37) % 100 AS DOUBLE) / 100 AS lon, 10 + CAST((s_suppkey * 53) % 100 AS DOUBLE) / 100 AS lat FROM supplier))"""

# rings as (fi, pg, r, i, x, y) in whole degrees
TESS_RINGS = """SELECT n_nationkey AS fi, 0 AS pg, 0 AS r, i, -180 + 72 * (n_nationkey % 5) + 72 * dx AS x, -90 + 36 * (n_nationkey // 5) + 36 * dy AS y
  FROM nation, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) v(i, dx, dy)"""
DIAMOND_RINGS = """SELECT r_regionkey AS fi, pg, r, i, -120 + 60 * r_regionkey + dx AS x, -20 + 10 * r_regionkey + dy AS y
  FROM region, (VALUES (0, 0, 0, -50, 0), (0, 0, 1, 0, -45), (0, 0, 2, 50, 0), (0, 0, 3, 0, 45), (0, 0, 4, -50, 0),
    (0, 1, 0, -10, -10), (0, 1, 1, 10, -10), (0, 1, 2, 10, 10), (0, 1, 3, -10, 10), (0, 1, 4, -10, -10),
    (1, 0, 0, 20, -5), (1, 0, 1, 70, -5), (1, 0, 2, 70, 5), (1, 0, 3, 20, 5), (1, 0, 4, 20, -5)) v(pg, r, i, dx, dy)"""


def hits_sql(name: str, ring_rows: str) -> str:
    """CTEs that end in {name}_hits(c_custkey, fi): edges, crossings by ring, parts, features."""
    return f"""
{name}_ring AS ({ring_rows}),
{name}_edge AS (
  SELECT a.fi, a.pg, a.r, a.x * 1000000.0::DOUBLE AS xi, a.y * 1000000.0::DOUBLE AS yi, b.x * 1000000.0::DOUBLE AS xj, b.y * 1000000.0::DOUBLE AS yj
  FROM {name}_ring a JOIN {name}_ring b ON a.fi = b.fi AND a.pg = b.pg AND a.r = b.r AND a.i = b.i + 1 WHERE a.y <> b.y),
{name}_in AS (
  SELECT c_custkey, fi, pg, r FROM good, {name}_edge
  WHERE (yi > y) <> (yj > y) AND x < xj + (xi - xj) * (y - yj) / (yi - yj) GROUP BY ALL HAVING count(*) % 2 = 1),
{name}_hits AS (
  SELECT c_custkey, fi FROM (SELECT c_custkey, fi, pg, count(*) AS n, min(r) AS outermost FROM {name}_in GROUP BY ALL)
  WHERE outermost = 0 GROUP BY ALL HAVING sum(n) % 2 = 1)"""


NATION_HITS, REGION_HITS = hits_sql("nation", TESS_RINGS), hits_sql("region", DIAMOND_RINGS)
REGION_NAME = "CASE r_regionkey WHEN 2 THEN '' ELSE r_name END"


def cell_sql(mode: str, hits: str, table: str, key: str, value: str, out: str) -> str:
    """A CTE out_cells(c_custkey, out, any): the output cell of each row that has a hit, by mode."""
    agg = {
        "first": f"arg_min({value}, fi)", "join": f"string_agg(nullif({value}, ''), '; ' ORDER BY fi)",
        "all": f"to_json(list({value} ORDER BY fi) FILTER ({value} <> ''))",
    }[mode]
    return f"{out}_cells AS (SELECT c_custkey, coalesce(CAST({agg} AS VARCHAR), '{'[]' if mode == 'all' else ''}') AS {out} FROM {hits} JOIN {table} ON {key} = fi GROUP BY c_custkey)"


OK_SQL = "coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false)"


def _blank(mode: str) -> str:
    return f"CASE WHEN {OK_SQL} THEN '[]' ELSE '' END" if mode == "all" else "''"


def _pip(mode: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return enrich(points(spark, d), [diamonds(spark, d)], mode=mode).select("c_custkey", "Zone")

    sql = f"""WITH {POINTS_SQL}, {REGION_HITS}, {cell_sql(mode, 'region_hits', 'region', 'r_regionkey', REGION_NAME, 'zone')}
SELECT c_custkey, coalesce(zone, {_blank(mode)}) AS "Zone" FROM points LEFT JOIN zone_cells USING (c_custkey)"""
    return query, sql


def pip_joined(spark: SparkSession, d: str) -> DataFrame:
    return enrich(points(spark, d), [diamonds(spark, d)], mode="join", plan="joined", key="c_custkey").select("c_custkey", "Zone")


def pip_multi_output(spark: SparkSession, d: str) -> DataFrame:
    layer = tessellation(spark, d, ["n_regionkey", "n_name"])
    return enrich(points(spark, d), [layer], mode="first").select("c_custkey", "Nation", "Nation_Region_key")


PIP_MULTI_OUTPUT = f"""WITH {POINTS_SQL}, {NATION_HITS}
SELECT c_custkey, coalesce(n_name, '') AS "Nation", coalesce(CAST(n_regionkey AS VARCHAR), '') AS "Nation_Region_key"
FROM points LEFT JOIN nation_hits USING (c_custkey) LEFT JOIN nation ON n_nationkey = fi"""


def pip_multi_layer(spark: SparkSession, d: str) -> DataFrame:
    return enrich(points(spark, d), [tessellation(spark, d), diamonds(spark, d)]).select("c_custkey", "Nation", "Zone")


PIP_MULTI_LAYER = f"""WITH {POINTS_SQL}, {NATION_HITS}, {REGION_HITS},
{cell_sql('join', 'nation_hits', 'nation', 'n_nationkey', 'n_name', 'nat')}, {cell_sql('join', 'region_hits', 'region', 'r_regionkey', REGION_NAME, 'zone')}
SELECT c_custkey, coalesce(nat, '') AS "Nation", coalesce(zone, '') AS "Zone" FROM points LEFT JOIN nat_cells USING (c_custkey) LEFT JOIN zone_cells USING (c_custkey)"""


def pip_overwrite_column(spark: SparkSession, d: str) -> DataFrame:
    """The second layer writes over the first one's column."""
    return enrich(points(spark, d), [tessellation(spark, d), diamonds(spark, d, "Nation")]).select("c_custkey", "Nation")


PIP_OVERWRITE = f"""WITH {POINTS_SQL}, {REGION_HITS}, {cell_sql('join', 'region_hits', 'region', 'r_regionkey', REGION_NAME, 'zone')}
SELECT c_custkey, coalesce(zone, '') AS "Nation" FROM points LEFT JOIN zone_cells USING (c_custkey)"""


def pip_unknown_property(spark: SparkSession, d: str) -> DataFrame:
    """A property that the layer lacks takes the default's values."""
    layer = diamonds(spark, d, selected=["r_name", "key"]).having(["r_name"])
    return enrich(points(spark, d), [layer], mode="first").select("c_custkey", "Zone", "Zone_Key")


PIP_UNKNOWN = f"""WITH {POINTS_SQL}, {REGION_HITS}, {cell_sql('first', 'region_hits', 'region', 'r_regionkey', REGION_NAME, 'zone')}
SELECT c_custkey, coalesce(zone, '') AS "Zone", coalesce(zone, '') AS "Zone_Key" FROM points LEFT JOIN zone_cells USING (c_custkey)"""


def pip_edge_points(spark: SparkSession, d: str) -> DataFrame:
    """Points on corners and edges of the tessellation: every one is in one cell at most."""
    n = _t(spark, d, "nation").select(F.col("n_nationkey"), F.expr("CAST(-180 + 72 * (n_nationkey % 5) AS DOUBLE)").alias("lon"), F.expr("CAST(-90 + 36 * (n_nationkey div 5) AS DOUBLE)").alias("lat"))
    return enrich(n, [tessellation(spark, d)], lat="lat", lon="lon", mode="all").select("n_nationkey", "Nation")


PIP_EDGE = """SELECT n_nationkey, to_json([n_name]) AS "Nation" FROM nation"""


def pip_bulk(spark: SparkSession, d: str) -> DataFrame:
    """Many rows with numeric coordinates."""
    at = lambda a, b, n, o: f"CAST((l_orderkey * {a} + l_linenumber * {b}) % {n} AS DOUBLE) / 10 - {o}"
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(at(7919, 31, 3600, 180)).alias("lon"), F.expr(at(104729, 17, 1800, 90)).alias("lat"))
    return enrich(rows, [tessellation(spark, d)], mode="first").select("l_orderkey", "l_linenumber", "Nation")


PIP_BULK = """WITH p AS (SELECT l_orderkey, l_linenumber, ((l_orderkey * 7919 + l_linenumber * 31) % 3600) // 10 AS x, ((l_orderkey * 104729 + l_linenumber * 17) % 1800) // 10 AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, n_name AS "Nation" FROM p JOIN nation ON n_nationkey = (y // 36) * 5 + x // 72"""


# coordinates

RAW = ("45.5", " 45.5 ", "+45.5", ".5", "5.", "1e1", "", "   ", "0x10", "0b11", "0o17", "90", "-90", "90.0001", "Infinity", "abc", "1.0d", "inf", "12abc", "1_000", "-0x10")
PARSED = (45.5, 45.5, 45.5, 0.5, 5.0, 10.0, 0.0, 0.0, 16.0, 3.0, 15.0, 90.0, -90.0, 90.0001, None, None, None, None, None, None, None)
_CASES = ", ".join(f"({i}, {'NULL' if v is None else f'{v}::DOUBLE'})" for i, v in enumerate(PARSED))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("event_id")
    return e.withColumn("raw", F.element_at(F.array(*map(F.lit, RAW)), (F.col("event_id") % len(RAW)).cast("int") + 1))


def coord_coerce(spark: SparkSession, d: str) -> DataFrame:
    v = js_number(F.col("raw"))
    fine = ~F.isnan(v) & (F.abs(v) != float("inf"))
    return _raw(spark, d).select("event_id", F.when(fine, v).alias("value"))


COORD_COERCE = f"SELECT event_id, v.value AS value FROM events JOIN (VALUES {_CASES}) v(i, value) ON i = event_id % {len(RAW)}"


def coord_validity(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).groupBy("raw").agg(F.count_if(valid_coord(js_number(F.col("raw")), F.lit(0.0))).alias("valid"), F.count("*").alias("rows"))


COORD_VALIDITY = f"""SELECT raw, count(*) FILTER (coalesce(v.value BETWEEN -90 AND 90, false)) AS valid, count(*) AS rows
FROM events JOIN (VALUES {', '.join(f"({i}, '{r}', {'NULL' if v is None else f'{v}::DOUBLE'})" for i, (r, v) in enumerate(zip(RAW, PARSED)))}) v(i, raw, value) ON i = event_id % {len(RAW)} GROUP BY raw"""


def quantized(spark: SparkSession, d: str) -> DataFrame:
    v = (F.col("l_extendedprice") - 50000.0) / 1000000.0
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quantize(v).alias("q"), dequantize(quantize(v)).alias("deg"))


QUANTIZED = "SELECT l_orderkey, l_linenumber, CAST(floor((l_extendedprice - 50000) / 1000000 * 1000000 + 0.5) AS INTEGER) AS q, floor((l_extendedprice - 50000) / 1000000 * 1000000 + 0.5) / 1000000 AS deg FROM lineitem"


# statistics


def _stats(mode: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return match_stats(enrich(points(spark, d), [diamonds(spark, d)], mode=mode, keep_hidden=True))

    hit = OK_SQL if mode == "all" else f"{OK_SQL} AND coalesce(zone, '') <> ''"
    sql = f"""WITH {POINTS_SQL}, {REGION_HITS}, {cell_sql('join', 'region_hits', 'region', 'r_regionkey', REGION_NAME, 'zone')}
SELECT count(*) AS "totalRows", count(*) FILTER ({hit}) AS "matchedRows", count(*) FILTER ({OK_SQL} AND NOT ({hit})) AS "unmatchedRows",
       count(*) FILTER (NOT {OK_SQL}) AS "badCoordRows" FROM points LEFT JOIN zone_cells USING (c_custkey)"""
    return query, sql


# grid


def _boxed(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("fi", bbox(F.col("polygons")).alias("bbox"))


def grid_base_cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.base_cells(diamonds(spark, d).features.select("fi", bbox(F.col("polygons")).alias("bbox"))).select("fi", "ci", "cj")


GRID_BASE = f"""WITH r AS ({DIAMOND_RINGS}), b AS (SELECT fi, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM r GROUP BY fi)
SELECT fi, CAST(ci AS INTEGER) AS ci, CAST(cj AS INTEGER) AS cj FROM b, range(0, 180) a(ci), range(0, 360) c(cj)
WHERE ci BETWEEN y0 + 90 AND least(y1 + 90, 179) AND cj BETWEEN x0 + 180 AND least(x1 + 180, 359)"""


def grid_refined_cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.cells(_boxed(spark, d))


CELLS_SQL = f"""{BOXES_SQL},
base AS (SELECT s_suppkey AS fi, boxes.*, ci, cj FROM boxes, range(0, 180) a(ci), range(0, 360) c(cj) WHERE ci BETWEEN floor(y0 + 90) AND floor(y1 + 90) AND cj BETWEEN floor(x0 + 180) AND floor(x1 + 180)),
counted AS (SELECT *, count(*) OVER (PARTITION BY ci, cj) AS n, ci - 90 AS oy, cj - 180 AS ox FROM base),
fine AS (
  SELECT fi, ci, cj, si, sj FROM counted, range(0, 5) a(si), range(0, 5) b(sj) WHERE n > 20
  AND si BETWEEN floor((greatest(y0, oy) - oy) / 0.2::DOUBLE) AND least(4, floor((least(y1, oy + 1) - oy) / 0.2::DOUBLE))
  AND sj BETWEEN floor((greatest(x0, ox) - ox) / 0.2::DOUBLE) AND least(4, floor((least(x1, ox + 1) - ox) / 0.2::DOUBLE))),
cells AS (
  SELECT 0 AS level, ci, cj, 0 AS si, 0 AS sj, fi FROM counted WHERE n <= 20 UNION ALL SELECT 1, ci, cj, si, sj, fi FROM fine)"""
GRID_REFINED = f"WITH {CELLS_SQL} SELECT level, CAST(ci AS INTEGER) AS ci, CAST(cj AS INTEGER) AS cj, CAST(si AS INTEGER) AS si, CAST(sj AS INTEGER) AS sj, CAST(fi AS INTEGER) AS fi FROM cells"


def grid_statistics(spark: SparkSession, d: str) -> DataFrame:
    return grid.statistics(grid.cells(_boxed(spark, d)))


GRID_STATISTICS = f"WITH {CELLS_SQL} SELECT count(DISTINCT (ci, cj)) AS non_empty, count(DISTINCT (ci, cj)) FILTER (level = 1) AS refined, count(*) AS postings FROM cells"


def grid_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of points in the refined cell. They are counted by cell, so points are not multiplied by them."""
    p = _t(spark, d, "customer").select("c_custkey", F.expr("20 + CAST((c_custkey * 7) % 100 AS DOUBLE) / 100").alias("lon"), F.expr("10 + CAST((c_custkey * 11) % 100 AS DOUBLE) / 100").alias("lat"))
    keys = grid.point_keys(F.col("lat"), F.col("lon"))
    k = F.explode(F.array(*[F.struct(F.lit(v).alias("level"), keys["ci"].alias("ci"), keys["cj"].alias("cj"), *[(keys[s] if v else F.lit(0)).alias(s) for s in ("si", "sj")]) for v in (0, 1)]))
    rows = p.select("c_custkey", k.alias("k")).select("c_custkey", "k.*")
    cell = ["level", "ci", "cj", "si", "sj"]
    found = rows.join(grid.cells(_boxed(spark, d)).groupBy(*cell).agg(F.count("*").alias("n")), cell)
    return found.groupBy("c_custkey").agg(F.sum("n").alias("candidates"))


GRID_CANDIDATES = f"""WITH {CELLS_SQL},
p AS (SELECT c_custkey, 20 + CAST((c_custkey * 7) % 100 AS DOUBLE) / 100 AS lon, 10 + CAST((c_custkey * 11) % 100 AS DOUBLE) / 100 AS lat FROM customer)
SELECT c_custkey, count(*) AS candidates FROM p JOIN cells ON ci = floor(lat + 90) AND cj = floor(lon + 180)
 AND (level = 0 OR (si = floor((lat - (floor(lat + 90) - 90)) / 0.2::DOUBLE) AND sj = floor((lon - (floor(lon + 180) - 180)) / 0.2::DOUBLE))) GROUP BY c_custkey"""


def pip_refined(spark: SparkSession, d: str) -> DataFrame:
    """The join through refined cells."""
    layer = Layer(boxes(spark, d), "box", "Box", [("s_name", "Name")])
    p = _t(spark, d, "customer").select("c_custkey", F.expr("20 + CAST((c_custkey * 7) % 100 AS DOUBLE) / 100").alias("lon"), F.expr("10 + CAST((c_custkey * 11) % 100 AS DOUBLE) / 100").alias("lat"))
    return enrich(p, [layer], lat="lat", lon="lon").select("c_custkey", "Box")


PIP_REFINED = f"""WITH {BOXES_SQL},
p AS (SELECT c_custkey, 20 + CAST((c_custkey * 7) % 100 AS DOUBLE) / 100 AS lon, 10 + CAST((c_custkey * 11) % 100 AS DOUBLE) / 100 AS lat FROM customer),
m AS (SELECT c_custkey, string_agg(s_name, '; ' ORDER BY s_suppkey) AS box FROM p JOIN boxes
  ON floor(lon * 1000000 + 0.5) >= floor(x0 * 1000000 + 0.5) AND floor(lon * 1000000 + 0.5) < floor(x1 * 1000000 + 0.5) AND floor(lat * 1000000 + 0.5) >= floor(y0 * 1000000 + 0.5) AND floor(lat * 1000000 + 0.5) < floor(y1 * 1000000 + 0.5)
  JOIN supplier USING (s_suppkey) GROUP BY c_custkey)
SELECT c_custkey, coalesce(box, '') AS "Box" FROM p LEFT JOIN m USING (c_custkey)"""


def bbox_features(spark: SparkSession, d: str) -> DataFrame:
    return diamonds(spark, d).features.select("fi", bbox(F.col("polygons")).alias("b")).select("fi", "b.*")


BBOX_FEATURES = f"WITH r AS ({DIAMOND_RINGS}) SELECT fi, CAST(min(x) AS DOUBLE) AS min_lon, CAST(min(y) AS DOUBLE) AS min_lat, CAST(max(x) AS DOUBLE) AS max_lon, CAST(max(y) AS DOUBLE) AS max_lat FROM r GROUP BY fi"


def bbox_rings(spark: SparkSession, d: str) -> DataFrame:
    parts = diamonds(spark, d).features.select("fi", F.posexplode(rings(F.col("polygons"))).alias("pg", "part"))
    return parts.select("fi", "pg", F.posexplode("part").alias("r", "ring")).select("fi", "pg", "r", "ring.bbox.*")


BBOX_RINGS = f"WITH r AS ({DIAMOND_RINGS}) SELECT fi, pg, r, CAST(min(x) * 1000000 AS INTEGER) AS x0, CAST(min(y) * 1000000 AS INTEGER) AS y0, CAST(max(x) * 1000000 AS INTEGER) AS x1, CAST(max(y) * 1000000 AS INTEGER) AS y1 FROM r GROUP BY ALL"


# texts


def slug_columns(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", slug(F.concat(F.lit(" ("), F.col("p_name"), F.lit(") / "), F.col("p_type"), F.lit("!"))).alias("slug"))


SLUG = "SELECT p_partkey, regexp_replace(regexp_replace(' (' || p_name || ') / ' || p_type || '!', '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part"


def auto_colors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", auto_color(F.col("c_name")).alias("color"))


AUTO_COLORS = f"""SELECT c_custkey, list_extract({list(PALETTE)!r}, 1 + CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)),
 lambda h, c: (xor(h, c) * 16777619) & 4294967295) % {len(PALETTE)} AS INTEGER)) AS color FROM customer"""


def first_segments(spark: SparkSession, d: str) -> DataFrame:
    return enrich(points(spark, d), [diamonds(spark, d)]).select("c_custkey", first_segment(F.col("Zone")).alias("first"))


FIRST_SEGMENTS = f"""WITH {POINTS_SQL}, {REGION_HITS}, {cell_sql('join', 'region_hits', 'region', 'r_regionkey', REGION_NAME, 'zone')}
SELECT c_custkey, trim(split_part(coalesce(zone, ''), '; ', 1)) AS first FROM points LEFT JOIN zone_cells USING (c_custkey)"""


def whitespace_clean(spark: SparkSession, d: str) -> DataFrame:
    messy = F.concat(F.lit("  "), F.regexp_replace("p_name", " ", " \t  "), F.lit("\n"))
    return _t(spark, d, "part").select("p_partkey", clean_space(messy).alias("clean"))


WHITESPACE = "SELECT p_partkey, trim(regexp_replace(p_name, ' +', ' ', 'g')) AS clean FROM part"


def _messy(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 7
    text = F.when(k == 0, "not available").when(k == 1, " N/A ").when(k == 2, "unknown").when(k == 3, None).when(k == 4, "").otherwise(F.col("p_brand"))
    number = F.when(k == 0, -999999.0).when(k == 1, None).when(k == 2, F.col("p_size") + 0.5).otherwise(F.col("p_size").cast("double"))
    return _t(spark, d, "part").select("p_partkey", text.alias("name"), number.alias("customers"))


MESSY_SQL = """messy AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'not available' WHEN 1 THEN ' N/A ' WHEN 2 THEN 'unknown' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE p_brand END AS name,
 CASE p_partkey % 7 WHEN 0 THEN -999999.0 WHEN 1 THEN NULL WHEN 2 THEN p_size + 0.5 ELSE CAST(p_size AS DOUBLE) END AS customers FROM part)"""


def sentinel_clean(spark: SparkSession, d: str) -> DataFrame:
    return etl.clean_columns(_messy(spark, d), ["name"], ["customers"])


SENTINEL = f"""WITH {MESSY_SQL} SELECT p_partkey, CASE WHEN p_partkey % 7 < 5 THEN '' ELSE trim(name) END AS name,
 CASE WHEN customers IS NULL OR customers < 0 THEN '' WHEN customers = floor(customers) THEN CAST(CAST(customers AS BIGINT) AS VARCHAR) ELSE CAST(customers AS VARCHAR) END AS customers FROM messy"""


def sentinel_counts(spark: SparkSession, d: str) -> DataFrame:
    return etl.sentinel_counts(_messy(spark, d), ["name"], ["customers"])


SENTINEL_COUNTS = f"WITH {MESSY_SQL} SELECT count(*) FILTER (p_partkey % 7 < 3) AS name, count(*) FILTER (customers < 0) AS customers FROM messy"


# table preparation


def translation_table(spark: SparkSession, d: str) -> DataFrame:
    props = F.create_map(F.lit("short"), F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.concat(F.lit("S"), (F.col("c_custkey") % 97).cast("string"))), F.lit("long"), F.col("c_name"))
    return etl.translation_table(_t(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("fi"), props.alias("props")), "short", "long")


TRANSLATION = "SELECT 'S' || (c_custkey % 97) AS short, arg_min(c_name, c_custkey) AS long, CAST(min(c_custkey) AS INTEGER) AS first_fi FROM customer WHERE c_custkey % 10 <> 0 GROUP BY short"


def _code(c: str, every: int) -> Column:
    """A code that every so manieth row lacks among the codes of others, having one of its own."""
    return F.concat(F.when(F.col(c) % every == 0, "X").otherwise(""), F.col(c).cast("string"))


def translate_join(spark: SparkSession, d: str) -> DataFrame:
    table = _t(spark, d, "nation").select(_code("n_nationkey", 5).alias("short"), F.col("n_name").alias("long"))
    return etl.translate(_t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("code")), "code", table, "name")


TRANSLATE = "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS code, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE coalesce(n_name, '') END AS name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"


def attr_left_join(spark: SparkSession, d: str) -> DataFrame:
    left = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("code"))
    right = _t(spark, d, "supplier").select(_code("s_nationkey", 4).alias("code"), F.col("s_suppkey").alias("pos"), F.when(F.col("s_suppkey") % 5 == 0, "-99").otherwise(F.col("s_name")).alias("iso"))
    return etl.attribute_join(left, right, "code", "pos", ["iso"])


ATTR_JOIN = """SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS code, CASE WHEN c_nationkey % 4 = 0 THEN '' ELSE coalesce(nullif(iso, '-99'), '') END AS iso FROM customer LEFT JOIN
 (SELECT s_nationkey, arg_max(CASE WHEN s_suppkey % 5 = 0 THEN '-99' ELSE s_name END, s_suppkey) AS iso FROM supplier GROUP BY s_nationkey) ON s_nationkey = c_nationkey"""


def territory_anti_join(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation")
    code = F.when(F.col("n_nationkey") % 6 == 0, "-99").otherwise(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")))
    present = n.select(F.concat(F.when(F.col("n_nationkey") % 4 == 1, "C").otherwise("other"), F.col("n_nationkey").cast("string")).alias("iso"))
    return etl.territories(n.select("n_nationkey", "n_name", code.alias("iso")), present, "iso", ("C7",))


TERRITORIES = "SELECT n_nationkey, n_name, 'C' || n_nationkey AS iso FROM nation WHERE n_nationkey % 6 <> 0 AND n_nationkey % 4 <> 1 AND n_nationkey <> 7"


def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    s, n = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name")), _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("name"))
    return etl.ordered_union([s, n], "pos")


ORDERED_UNION = """SELECT pos, name, CAST(row_number() OVER (ORDER BY part, pos) - 1 AS INTEGER) AS fi FROM
 (SELECT 0 AS part, s_suppkey AS pos, s_name AS name FROM supplier UNION ALL SELECT 1, n_nationkey, n_name FROM nation)"""


def dimension_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Of names of equal code the last counts."""
    names = _t(spark, d, "supplier").select(_code("s_nationkey", 3).alias("code"), "s_name", F.col("s_suppkey").alias("pos"))
    return etl.lookup(_t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("code")), names, "code", "s_name", "country", "pos")


LOOKUP = """SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS code, coalesce(CASE WHEN c_nationkey % 3 > 0 THEN name END, CAST(c_nationkey AS VARCHAR)) AS country
FROM customer LEFT JOIN (SELECT s_nationkey, arg_max(s_name, s_suppkey) AS name FROM supplier GROUP BY s_nationkey) ON s_nationkey = c_nationkey"""


def area_sort(spark: SparkSession, d: str) -> DataFrame:
    f = tessellation(spark, d).features.withColumnRenamed("fi", "pos")
    return etl.by_specificity(f, "pos").select("pos", "fi", F.round("area", 6).alias("area"))


AREA_SORT = """WITH a AS (SELECT n_nationkey AS pos, 72.0::DOUBLE * 36 * cos((4 * y + 2 * (y + 36) - y) / 5.0::DOUBLE * 3.141592653589793 / 180) AS area FROM (SELECT n_nationkey, -90 + 36 * (n_nationkey // 5) AS y FROM nation))
SELECT CAST(pos AS INTEGER) AS pos, CAST(row_number() OVER (ORDER BY round(area, 6), pos) - 1 AS INTEGER) AS fi, round(area, 6) AS area FROM a"""


# display


def extent(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select(js_number(F.col("lat")).alias("lat"), js_number(F.col("lon")).alias("lon"))
    return display.extent(p.where(display.finite(F.col("lat"), F.col("lon"))), "lat", "lon")


EXTENT = f"WITH {POINTS_SQL} SELECT min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM points WHERE lat IS NOT NULL"


def topk_labels(spark: SparkSession, d: str) -> DataFrame:
    b = display.labels(_boxed(spark, d), (20.2, 10.1, 20.8, 10.9))
    return b.select("fi", F.round("box_area", 6).alias("box_area"))


TOPK_LABELS = f"""WITH {BOXES_SQL} SELECT CAST(s_suppkey AS INTEGER) AS fi, round((x1 - x0) * (y1 - y0), 6) AS box_area FROM boxes
WHERE x0 <= 20.8::DOUBLE AND x1 >= 20.2::DOUBLE AND y0 <= 10.9::DOUBLE AND y1 >= 10.1::DOUBLE ORDER BY (x1 - x0) * (y1 - y0) DESC, s_suppkey LIMIT 60"""


def group_headings(spark: SparkSession, d: str) -> DataFrame:
    return display.group_headings(_t(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey")


GROUP_HEADINGS = "SELECT n_nationkey, n_regionkey, n_regionkey IS DISTINCT FROM lag(n_regionkey) OVER (ORDER BY n_nationkey) AS heading FROM nation"


def preview_50(spark: SparkSession, d: str) -> DataFrame:
    return preview(enrich(points(spark, d), [tessellation(spark, d)]).select("c_custkey", "Nation"), "c_custkey")


PREVIEW = f"""WITH {POINTS_SQL}, {NATION_HITS} SELECT c_custkey, coalesce(n_name, '') AS "Nation"
FROM points LEFT JOIN nation_hits USING (c_custkey) LEFT JOIN nation ON n_nationkey = fi ORDER BY c_custkey LIMIT 50"""


def property_keys(spark: SparkSession, d: str) -> DataFrame:
    return display.property_keys(diamonds(spark, d).features)


PROPERTY_KEYS = "SELECT * FROM (VALUES ('r_name', 0, 0), ('key', 0, 1)) v(key, first_fi, first_pos)"


def colored_points(spark: SparkSession, d: str) -> DataFrame:
    e = enrich(points(spark, d), [diamonds(spark, d)]).withColumns({"lat": js_number(F.col("lat")), "lon": js_number(F.col("lon"))})
    return display.colored_points(e, "lat", "lon", "Zone").select("c_custkey", "color")


_FNV = f"list_extract({list(PALETTE)!r}, 1 + CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(v, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % {len(PALETTE)} AS INTEGER))"
COLORED_POINTS = f"""WITH {POINTS_SQL}, {REGION_HITS}, {cell_sql('join', 'region_hits', 'region', 'r_regionkey', REGION_NAME, 'zone')},
s AS (SELECT c_custkey, trim(split_part(coalesce(zone, ''), '; ', 1)) AS v FROM points LEFT JOIN zone_cells USING (c_custkey) WHERE lat IS NOT NULL)
SELECT c_custkey, CASE WHEN v = '' THEN '#ff4444' ELSE {_FNV} END AS color FROM s"""

_FIRST, _JOIN, _ALL = _pip("first"), _pip("join"), _pip("all")
_STATS, _STATS_ALL = _stats("join"), _stats("all")
PAIRS = {
    "pip_first": _FIRST, "pip_join": _JOIN, "pip_all": _ALL, "pip_holes_xor_parts": (pip_joined, _JOIN[1]), "pip_multi_output": (pip_multi_output, PIP_MULTI_OUTPUT),
    "pip_multi_layer": (pip_multi_layer, PIP_MULTI_LAYER), "pip_overwrite_column": (pip_overwrite_column, PIP_OVERWRITE), "pip_unknown_property": (pip_unknown_property, PIP_UNKNOWN),
    "pip_edge_points": (pip_edge_points, PIP_EDGE), "pip_refined": (pip_refined, PIP_REFINED), "pip_bulk": (pip_bulk, PIP_BULK), "coord_coerce": (coord_coerce, COORD_COERCE), "coord_validity": (coord_validity, COORD_VALIDITY),
    "quantize": (quantized, QUANTIZED), "match_stats": _STATS, "match_stats_all_mode": _STATS_ALL, "grid_base_cells": (grid_base_cells, GRID_BASE),
    "grid_refined_cells": (grid_refined_cells, GRID_REFINED), "grid_statistics": (grid_statistics, GRID_STATISTICS), "grid_candidates": (grid_candidates, GRID_CANDIDATES),
    "bbox_features": (bbox_features, BBOX_FEATURES), "bbox_rings": (bbox_rings, BBOX_RINGS), "slug_columns": (slug_columns, SLUG), "auto_color": (auto_colors, AUTO_COLORS),
    "first_segment": (first_segments, FIRST_SEGMENTS), "whitespace_clean": (whitespace_clean, WHITESPACE), "sentinel_clean": (sentinel_clean, SENTINEL), "sentinel_counts": (sentinel_counts, SENTINEL_COUNTS),
    "translation_table": (translation_table, TRANSLATION), "translate_join": (translate_join, TRANSLATE), "attr_left_join": (attr_left_join, ATTR_JOIN), "territory_anti_join": (territory_anti_join, TERRITORIES),
    "ordered_union": (ordered_union, ORDERED_UNION), "dimension_lookup": (dimension_lookup, LOOKUP), "area_sort": (area_sort, AREA_SORT), "extent": (extent, EXTENT), "topk_labels": (topk_labels, TOPK_LABELS),
    "group_headings": (group_headings, GROUP_HEADINGS), "preview_50": (preview_50, PREVIEW), "property_keys": (property_keys, PROPERTY_KEYS), "colored_points": (colored_points, COLORED_POINTS),
}
