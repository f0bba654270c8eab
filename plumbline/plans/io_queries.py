"""Queries of readers, writers and configuration. Files are made of the driver's tables first, in the shared folder, and
then read; what comes back is compared with the tables."""

from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import bbox, box
from ..functions.text import base_name, detect_coordinates, megabytes, percent_done, size_warning
from ..operators import display, etl, grid
from ..operators.enrich import enrich, match_stats
from ..sources import binary, geojson, kml, layer_files, tables
from ..sources.geojson_split import read_geojson_split
from ..sources.joined import write_text
from ..sources.shared import put_bytes, shared_folder
from .cache import LayerCache
from .layer import Layer, Session
from .queries import DIAMOND_RINGS, OK_SQL, PIP_REFINED, POINTS_SQL, REGION_HITS, REGION_NAME, TESS_RINGS, TRANSLATION, _t, boxes, cell_sql, diamonds, points, tessellation, translation_table


def flat(features: DataFrame) -> DataFrame:
    """A row for each position: fi, pg, r, i, lon, lat."""
    parts = features.select("fi", F.posexplode("polygons").alias("pg", "part")).select("fi", "pg", F.posexplode("part").alias("r", "ring"))
    return parts.select("fi", "pg", "r", F.posexplode("ring").alias("i", "p")).select("fi", "pg", "r", "i", "p.lon", "p.lat")


def flat_sql(rings: str) -> str:
    return f"SELECT fi, pg, r, i, CAST(x AS DOUBLE) AS lon, CAST(y AS DOUBLE) AS lat FROM ({rings})"


# CSV


def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Quotes, delimiters, line ends and blanks in cells, behind a byte order mark."""
    c = _t(spark, d, "customer")
    odd = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(', "x"\n;'))).when(F.col("c_custkey") % 3 == 1, F.lit("")).otherwise(F.col("c_name"))
    rows = c.select(F.col("c_custkey").alias("id"), odd.alias("name"), F.col("c_nationkey").alias("nation"), F.lit("end").alias("last"))
    path = shared_folder(spark, "csv")
    tables.write_csv(rows, path, order="id", bom=True)
    return tables.read_csv(spark, path)


CSV_SCAN = """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 3 WHEN 0 THEN c_name || ', "x"' || chr(10) || ';' WHEN 1 THEN '' ELSE c_name END AS name,
 CAST(c_nationkey AS VARCHAR) AS nation, 'end' AS last FROM customer"""

def csv_errors(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a cell too few or too many, told by their numbers in a file whose cells hold line ends."""
    c = _t(spark, d, "customer")
    key = F.col("c_custkey")
    name = tables.csv_cell(F.when(key % 3 == 0, F.concat("c_name", F.lit(", a\nb"))).otherwise(F.col("c_name")))
    more = F.when(key % 7 == 1, F.lit("")).when(key % 7 == 2, F.lit(",0,1,2")).otherwise(F.lit(",0"))
    path = f"{shared_folder(spark, 'csv')}/ragged.csv"
    write_text(c.orderBy("c_custkey").select(F.concat(key.cast("string"), F.lit(","), name, more).alias("value")), path, head="id,name,n\r\n", end="\r\n")
    return tables.csv_errors(spark, path).select("row", "message")


CSV_ERRORS = """WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row, CASE c_custkey % 7 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 3 END AS m FROM customer)
SELECT row, 'Row ' || row || ': Too ' || CASE WHEN m < 3 THEN 'few' ELSE 'many' END || ' fields: expected 3 fields but parsed ' || m AS message FROM r WHERE m <> 3"""


SEPARATORS = {"comma": ",", "tab": "\t", "bar": "|", "semicolon": ";"}


def delimiter_sniff(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, sep in SEPARATORS.items():
        path = shared_folder(spark, "sniff")
        _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1).write.csv(path, header=True, sep=sep)
        rows = tables.read_csv(spark, path).select(F.lit(name).alias("kind"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


SNIFF = f"""SELECT kind, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey
FROM nation, (VALUES {', '.join(f"('{k}')" for k in SEPARATORS)}) v(kind)"""


def csv_headers(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "headers")
    _t(spark, d, "region").select(F.col("r_regionkey").alias(" key "), F.col("r_name").alias("name")).coalesce(1).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return spark.createDataFrame(list(enumerate(tables.csv_headers(spark, path))), "pos int, name string")


def sample_source(spark: SparkSession, d: str) -> DataFrame:
    return tables.sample_points(spark)


SAMPLE = "SELECT * FROM (VALUES " + ", ".join(f"('{i + 1}', '{lat}', '{lon}', '{city}')" for i, (city, lat, lon) in enumerate(tables.SAMPLE)) + ") v(id, lat, lon, city)"


def translation_csv(spark: SparkSession, d: str) -> DataFrame:
    """Written, copied by its catalogue entry, and read again."""
    root = shared_folder(spark, "translation")
    tables.write_translation(translation_table(spark, d), f"{root}/own/codes.csv")
    entry = spark.createDataFrame([("codes", "/old/own/codes.csv")], "id string, translationUrl string")
    return tables.read_translation(spark, tables.translation_download(spark, entry, "codes", root, root))


TRANSLATION_CSV = f"SELECT short, long FROM ({TRANSLATION})"

# GeoJSON


def geojson_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "geojson")
    geojson.write_geojson(diamonds(spark, d).features, path)
    return flat(geojson.read_geojson(spark, path))


def geojson_split(spark: SparkSession, d: str) -> DataFrame:
    """One collection of all customers' boxes, with texts that look like structure, read by as many tasks as it has blocks."""
    lon, lat = F.expr("CAST((c_custkey * 7919) % 3400 AS DOUBLE) / 10 - 170"), F.expr("CAST((c_custkey * 104729) % 1600 AS DOUBLE) / 10 - 80")
    props = F.create_map(F.lit("name"), F.concat("c_name", F.lit(' }],"features":[{ "\\')), F.lit("segment"), F.col("c_mktsegment"))
    made = _t(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("fi"), props.alias("props"), F.array(F.array(box(lon, lat, lon + 1, lat + 2))).alias("polygons"))
    path = shared_folder(spark, "geojson")
    geojson.write_geojson(made, path)
    read = read_geojson_split(spark, path)
    return read.select("fi", F.element_at("props", "name").alias("name"), F.element_at("props", "segment").alias("segment"), bbox(F.col("polygons")).alias("b")).select("fi", "name", "segment", "b.*")


GEOJSON_SPLIT = """SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS fi, c_name || ' }],"features":[{ "' || chr(92) AS name, c_mktsegment AS segment, lon AS min_lon, lat AS min_lat, lon + 1 AS max_lon, lat + 2 AS max_lat
FROM (SELECT *, CAST((c_custkey * 7919) % 3400 AS DOUBLE) / 10 - 170 AS lon, CAST((c_custkey * 104729) % 1600 AS DOUBLE) / 10 - 80 AS lat FROM customer)"""


def geojson_properties(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, truth values, nulls and letters as texts; features that are no polygons are left out before numbering."""
    n = _t(spark, d, "nation")
    props = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("n"), (F.col("n_nationkey") % 2 == 0).alias("even"), F.concat(F.lit("ñ "), "n_name").alias("other")), {"ignoreNullFields": "false"})
    kind = F.when(F.col("n_nationkey") % 5 == 4, '{"type":"Point","coordinates":[1,2]}').otherwise('{"type":"Polygon","coordinates":[[[0,0,5],[2,0,5],[2,2,5],[0,0,5]]]}')
    text = n.select("n_nationkey", F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), kind, F.lit("}")).alias("f")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "f"))), lambda x: x["f"]), ",").alias("all"))
    path = shared_folder(spark, "geojson")
    text.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}")).alias("value")).write.text(path)
    read = geojson.read_geojson(spark, path, validate=False)
    return read.select("fi", *[F.col("props").getItem(k).alias(k) for k in ("name", "n", "even", "other")])


GEOJSON_PROPERTIES = """SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS fi, n_name AS name, CAST(n_nationkey AS VARCHAR) AS n,
 CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END AS even, 'ñ ' || n_name AS other FROM nation WHERE n_nationkey % 5 <> 4"""

FEATURE = '{"type":"FeatureCollection","features":[%s]}'
TEXTS = (
    ("[1]", "Not a JSON object."), ("not json", "Not a JSON object."), ('{"type":"X"}', "Not a FeatureCollection."), (FEATURE % "", "The collection has no features."),
    (FEATURE % "3", "Feature 0 is not an object."), (FEATURE % '{"type":"Feature"}', "Feature 0 has no geometry."), (FEATURE % '{"geometry":{}}', "Feature 0 has no geometry type."),
    (FEATURE % '{"geometry":{"type":"Point","coordinates":[1,2]}}', "Feature 0 is not a polygon."), (FEATURE % '{"geometry":{"type":"Polygon","coordinates":[]}},{"geometry":{"type":"Polygon"}}', "Feature 1 has no coordinates."),
    (FEATURE % '{"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}', None),
)


def geojson_validation(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(t) for t, _ in TEXTS]), (F.col("event_id") % len(TEXTS)).cast("int") + 1)
    parsed = _t(spark, d, "events").select("event_id", F.try_parse_json(text).alias("v"))
    return parsed.select("event_id", geojson.validation_error("v").alias("error"))


VALIDATION = f"""SELECT event_id, error FROM events JOIN (VALUES {', '.join(f"({i}, {'NULL' if e is None else repr(e)})" for i, (_, e) in enumerate(TEXTS))}) v(i, error) ON i = event_id % {len(TEXTS)}"""


def polygon_filter(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Polygon", "MultiPolygon", "Point", None)]), (F.col("event_id") % 4).cast("int") + 1)
    return etl.polygons_only(_t(spark, d, "events").select("event_id", F.struct(kind.alias("type")).alias("geometry"))).select("event_id", "geometry.type")


POLYGON_FILTER = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS type FROM events WHERE event_id % 4 < 2"

# KML


def _kml(spark: SparkSession, d: str) -> str:
    """A KML document: a placemark without a polygon, then one for each region, with extended data and altitudes, some rings
    left open."""
    def ring(tag):
        def text(points):
            closed = F.transform(points, lambda p: F.concat_ws(",", p["lon"].cast("string"), p["lat"].cast("string"), F.lit("5")))
            return F.concat(F.lit(f"<k:{tag}><k:LinearRing><k:coordinates> "), F.array_join(F.slice(closed, F.lit(1), F.size(closed) - 1), "\n "), F.lit(f" </k:coordinates></k:LinearRing></k:{tag}>"))
        return text

    part = lambda p: F.concat(F.lit("<k:Polygon>"), ring("outerBoundaryIs")(F.get(p, F.lit(0))), F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), ring("innerBoundaryIs")), ""), F.lit("</k:Polygon>"))
    mark = F.concat(
        F.lit("<k:Placemark><k:name> "), F.element_at("props", "r_name"), F.lit(' </k:name><k:ExtendedData><k:Data name="key"><k:value>'), F.element_at("props", "key"),
        F.lit("</k:value></k:Data></k:ExtendedData><k:MultiGeometry>"), F.array_join(F.transform("polygons", part), ""), F.lit("</k:MultiGeometry></k:Placemark>"),
    )
    marks = [r["m"] for r in diamonds(spark, d).features.select("fi", mark.alias("m")).orderBy("fi").collect()]  # five regions
    bare = '<k:Placemark><k:ExtendedData><k:SchemaData><k:SimpleData name="depth">3</k:SimpleData></k:SchemaData></k:ExtendedData></k:Placemark>'
    return f'<k:kml xmlns:k="http://www.opengis.net/kml/2.2"><k:Document>{bare}<k:Folder>{"".join(marks)}</k:Folder></k:Document></k:kml>'


def kml_scan(spark: SparkSession, d: str) -> DataFrame:
    return flat(kml.read_kml(spark, put_bytes(spark, f"{shared_folder(spark, 'kml')}/regions.kml", _kml(spark, d).encode())))


def kml_properties(spark: SparkSession, d: str) -> DataFrame:
    read = kml.read_kml(spark, put_bytes(spark, f"{shared_folder(spark, 'kml')}/regions.kml", _kml(spark, d).encode()))
    name = F.coalesce(F.try_element_at("props", F.lit("Name")), F.lit("none"))
    return read.select("fi", name.alias("name"), F.element_at("props", "key").alias("key"), F.array_join("keys", ",").alias("keys"), F.size("warnings").alias("warnings"))


KML_PROPERTIES = "SELECT r_regionkey AS fi, CASE r_regionkey WHEN 2 THEN 'none' ELSE r_name END AS name, CAST(r_regionkey AS VARCHAR) AS key, 'Name,Description,depth,key' AS keys, 1 AS warnings FROM region"


def kmz_scan(spark: SparkSession, d: str) -> DataFrame:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.kml", "<other/>"), z.writestr("doc.kml", _kml(spark, d)), z.writestr("icon.png", b"x")
    return flat(kml.read_kmz(spark, put_bytes(spark, f"{shared_folder(spark, 'kmz')}/regions.kmz", data.getvalue())))


# binary layers, grids, WKB


def _gjbf(spark: SparkSession, d: str) -> str:
    return layer_files.write_layer(diamonds(spark, d).features, f"{shared_folder(spark, 'gjbf')}/regions.gjbf", ["r_name", "key"])


def gjbf_scan(spark: SparkSession, d: str) -> DataFrame:
    return flat(binary.dequantised(binary.read_gjbf(spark, _gjbf(spark, d))))


def gjbf_source(spark: SparkSession, d: str) -> DataFrame:
    """As a data source: properties, keys, raw boxes."""
    layer_files.register(spark)
    read = spark.read.format("gjbf").load(_gjbf(spark, d))
    return read.select("fi", F.element_at("props", "r_name").alias("name"), F.element_at("props", "key").alias("key"), F.array_join("prop_keys", ",").alias("keys"), "bbox.*")


GJBF_SOURCE = f"""WITH r AS ({DIAMOND_RINGS}) SELECT fi, any_value({REGION_NAME}) AS name, CAST(fi AS VARCHAR) AS key, 'r_name,key' AS keys,
 CAST(min(x) AS DOUBLE) AS min_lon, CAST(min(y) AS DOUBLE) AS min_lat, CAST(max(x) AS DOUBLE) AS max_lon, CAST(max(y) AS DOUBLE) AS max_lat FROM r JOIN region ON r_regionkey = fi GROUP BY fi"""


def gjbf_box(spark: SparkSession, d: str) -> DataFrame:
    """Nations that meet a box and are of some numbers, of a layer file read in ranges of four features."""
    path = layer_files.write_layer(tessellation(spark, d).features, f"{shared_folder(spark, 'gjbf')}/nations.gjbf", ["n_name"])
    read = layer_files.read_layer(spark, path, fi=(7, 23), box=(-100, -60, 30, 80), features_per_task=4)
    return read.select("fi", F.element_at("props", "n_name").alias("name"), F.size("parts").alias("parts"), "bbox.min_lon", "bbox.min_lat")


GJBF_BOX = """SELECT CAST(n_nationkey AS INTEGER) AS fi, n_name AS name, 1 AS parts, CAST(-180 + 72 * (n_nationkey % 5) AS DOUBLE) AS min_lon, CAST(-90 + 36 * (n_nationkey // 5) AS DOUBLE) AS min_lat
FROM nation WHERE n_nationkey % 5 BETWEEN 1 AND 2 AND n_nationkey BETWEEN 7 AND 23"""


def grid_rows(spark: SparkSession, d: str) -> DataFrame:
    """Some cells of a grid file: postings of the nations' cells in two rows of the grid."""
    own = grid.cells(tessellation(spark, d).features.select("fi", bbox(F.col("polygons")).alias("bbox")))
    path = layer_files.write_grid(own, f"{shared_folder(spark, 'grid')}/nations.grid")
    return layer_files.read_cells(spark, path, ci=(35, 36), cj=(300, 359), cells_per_task=100).select("ci", "cj", "fi")


GRID_ROWS = """SELECT CAST(ci AS INTEGER) AS ci, CAST(cj AS INTEGER) AS cj, CAST(n_nationkey AS INTEGER) AS fi FROM nation, range(35, 37) a(ci), range(300, 360) b(cj)
WHERE ci BETWEEN 36 * (n_nationkey // 5) AND 36 * (n_nationkey // 5) + 36 AND cj BETWEEN 72 * (n_nationkey % 5) AND 72 * (n_nationkey % 5) + 72"""


def gjbf_to_geojson(spark: SparkSession, d: str) -> DataFrame:
    """Geometry texts of one part and of several."""
    layers = [tessellation(spark, d).features, diamonds(spark, d).features]
    texts = None
    for f in layers:
        one = layer_files.write_layer(f, f"{shared_folder(spark, 'gjbf')}/x.gjbf", [])
        own = binary.geometry_texts(binary.read_gjbf(spark, one))
        texts = own if texts is None else texts.unionByName(own)
    v = F.parse_json("geometry")
    points = F.when(F.variant_get(v, "$.type", "string") == "Polygon", F.flatten(F.try_variant_get(v, "$.coordinates", "array<array<array<double>>>"))).otherwise(F.flatten(F.flatten(F.try_variant_get(v, "$.coordinates", "array<array<array<array<double>>>>"))))
    return texts.select("fi", F.variant_get(v, "$.type", "string").alias("type"), F.size(points).alias("positions"), F.aggregate(points, F.lit(0.0), lambda a, p: a + p[0] * 3 + p[1]).alias("mark"))


GJBF_TO_GEOJSON = f"""WITH t AS (SELECT 'Polygon' AS type, * FROM ({TESS_RINGS}) UNION ALL SELECT 'MultiPolygon', * FROM ({DIAMOND_RINGS}))
SELECT CAST(row_number() OVER (PARTITION BY type ORDER BY fi) - 1 AS INTEGER) AS fi, type, CAST(count(*) AS INTEGER) AS positions, CAST(sum(x * 3 + y) AS DOUBLE) AS mark FROM t GROUP BY type, fi"""


def gjbf_build(spark: SparkSession, d: str) -> DataFrame:
    """White space of values is cleaned where a layer is built; an upload keeps its own."""
    f = diamonds(spark, d).features.withColumn("props", F.create_map(F.lit("v"), F.concat(F.lit("  "), F.element_at("props", "key"), F.lit(" \t\u00a0 x "))))
    out = None
    for kind, clean in (("built", True), ("upload", False)):
        path = layer_files.write_layer(f, f"{shared_folder(spark, 'gjbf')}/x.gjbf", ["v"], clean)
        rows = binary.read_gjbf(spark, path).select(F.lit(kind).alias("kind"), "fi", F.element_at("props", "v").alias("v"))
        out = rows if out is None else out.unionByName(rows)
    return out


GJBF_BUILD = "SELECT kind, r_regionkey AS fi, CASE kind WHEN 'built' THEN r_regionkey || ' x' ELSE '  ' || r_regionkey || ' ' || chr(9) || chr(160) || ' x ' END AS v FROM region, (VALUES ('built'), ('upload')) k(kind)"


def _grid(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    own = grid.cells(boxes(spark, d).select("fi", bbox(F.col("polygons")).alias("bbox")))
    return layer_files.write_grid(own, f"{shared_folder(spark, 'grid')}/boxes.grid"), own


def grid_scan(spark: SparkSession, d: str) -> DataFrame:
    return binary.read_grid(spark, _grid(spark, d)[0])


def grid_source(spark: SparkSession, d: str) -> DataFrame:
    layer_files.register(spark)
    return spark.read.format("ggrid").load(_grid(spark, d)[0])


def pip_given_grid(spark: SparkSession, d: str) -> DataFrame:
    """The join through a grid that was read, not built."""
    layer = Layer(boxes(spark, d), "box", "Box", [("s_name", "Name")], grid=binary.read_grid(spark, _grid(spark, d)[0]))
    p = _t(spark, d, "customer").select("c_custkey", F.expr("20 + CAST((c_custkey * 7) % 100 AS DOUBLE) / 100").alias("lon"), F.expr("10 + CAST((c_custkey * 11) % 100 AS DOUBLE) / 100").alias("lat"))
    return enrich(p, [layer], lat="lat", lon="lon").select("c_custkey", "Box")


def wkb_scan(spark: SparkSession, d: str) -> DataFrame:
    """Polygons with and without heights, multipolygons and points, in a Parquet table of several files."""
    rings: dict = {}
    for r in flat(diamonds(spark, d).features).orderBy("fi", "pg", "r", "i").collect():  # five regions
        rings.setdefault(r["fi"], {}).setdefault(r["pg"], {}).setdefault(r["r"], []).append((r["lon"], r["lat"]))
    rows = []
    for fi, parts in rings.items():
        order, z = ("<", ">")[fi % 2], fi % 3 == 0
        head = lambda k: struct.pack(f"{order}BI", order == "<", k + 1000 * z)
        body = lambda own: head(3) + struct.pack(f"{order}I", len(own)) + b"".join(struct.pack(f"{order}I", len(g)) + b"".join(struct.pack(f"{order}{'ddd' if z else 'dd'}", *p, *([7.0] if z else [])) for p in g) for g in own.values())
        rows += [(2 * fi, f" {fi} ", bytearray(head(6) + struct.pack(f"{order}I", len(parts)) + b"".join(map(body, parts.values())))), (2 * fi + 1, "point", bytearray(struct.pack("<BIdd", 1, 1, 0.0, 0.0)))]
    path = shared_folder(spark, "wkb")
    spark.createDataFrame(rows, "at int, key string, geometry binary").repartitionByRange(3, "at").sortWithinPartitions("at").write.parquet(path)
    read = binary.read_wkb_parquet(spark, path, "geometry", ["key"])
    return flat(read).join(read.select("fi", F.element_at("props", "key").alias("key")), "fi")


WKB_SCAN = f"SELECT *, CAST(fi AS VARCHAR) AS key FROM ({flat_sql(DIAMOND_RINGS)})"

# catalogue, files


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation")
    entry = F.struct(
        F.concat(F.lit("l"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("Layer  of "), "n_name").alias("label"), (F.col("n_regionkey")).cast("string").alias("group"),
        F.concat(F.lit("/old/data/"), "n_name", F.lit(".gjbf")).alias("gjbfUrl"), F.lit("b").alias("defaultPropertyKey"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("suggestion"),
        F.array(*[F.struct(F.lit(k).alias("key"), F.lit(k.upper()).alias("label"), F.col("n_name").alias("example")) for k in "abc"]).alias("properties"),
    )
    path = shared_folder(spark, "manifest")
    n.agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("value")).write.text(path)
    return tables.read_manifest(spark, path)


def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return m.select("id", "label", "group", tables.asset_paths("/base/", F.col("gjbfUrl")).alias("asset"), F.array_join(F.transform("properties", lambda p: p["key"]), ",").alias("keys"), F.col("translationUrl").isNull().alias("untranslated"))


MANIFEST = "SELECT 'l' || n_nationkey AS id, 'Layer  of ' || n_name AS label, CAST(n_regionkey AS VARCHAR) AS \"group\", '/base/data/' || n_name || '.gjbf' AS asset, 'a,b,c' AS keys, true AS untranslated FROM nation"


def layer_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Configurations from catalogue entries, looked up by id."""
    m, out = _manifest(spark, d), []
    features = spark.createDataFrame([], "fi int")
    for r in m.select("id").collect():  # a catalogue's few entries
        own = Layer.from_manifest(tables.manifest_entry(m, r["id"]), features)
        out.append((own.id, own.suggestion, ",".join(own.selected), own.outputs()[0][1]))
    return spark.createDataFrame(out, "id string, suggestion string, selected string, output string")


LAYER_DEFAULTS = r"""SELECT 'l' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE regexp_replace('Layer  of ' || n_name, '\s+', '_', 'g') END AS suggestion, 'b' AS selected,
 regexp_replace(CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Layer  of ' || n_name END, '[^A-Za-z0-9]+', '_', 'g') || '_B' AS output FROM nation"""


def many_files(spark: SparkSession, d: str) -> DataFrame:
    """Several files in one read; one that is missing is left out."""
    path = shared_folder(spark, "many")
    _t(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("k")).write.partitionBy("k").parquet(path)
    return tables.read_many(spark, [f"{path}/k={i}" for i in range(-1, 6)], "parquet")


def cached_layer(spark: SparkSession, d: str) -> DataFrame:
    """A second request finds the table of the first, as does a download that is there."""
    made: list[int] = []
    make = lambda: made.append(1) or _t(spark, d, "nation").select("n_nationkey", "n_name")
    cache, path = LayerCache(spark, shared_folder(spark, "cache")), shared_folder(spark, "fetched")
    for _ in range(2):
        cache.get_or("/a/nation.gjbf", "4", make)
        rows = tables.fetched(spark, path, lambda: cache.get_or("/a/nation.gjbf", "4", make))
    return rows.withColumn("made", F.lit(len(made)))


def utf8_check(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut within a letter or with a byte of another encoding."""
    content = F.when(F.col("doc_id") % 2 == 1, F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.unhex(F.lit("E9")))).otherwise(F.coalesce("text", F.lit("")).cast("binary"))
    return tables.not_utf8(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))


def size_guard(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("o_orderkey") % 160) * 1048576 + F.col("o_orderkey") % 1000 * 1000
    return _t(spark, d, "orders").select("o_orderkey", size_warning(n).alias("warning"), megabytes(n).alias("mb"), percent_done(F.col("o_orderkey") % 1000, F.lit(1000)).alias("percent"))


SIZE_GUARD = """WITH s AS (SELECT o_orderkey, ((o_orderkey % 160) * 1048576 + o_orderkey % 1000 * 1000) / 1048576.0::DOUBLE AS mb FROM orders),
t AS (SELECT *, printf('%.1f', floor(mb * 10 + 0.5) / 10) AS text FROM s)
SELECT o_orderkey, CASE WHEN mb > 100 THEN 'File is ' || text || 'MB — may cause memory issues.' WHEN mb > 50 THEN 'File is ' || text || 'MB — consider using a smaller file.' END AS warning,
 text AS mb, CAST(floor((o_orderkey % 1000) / 1000.0::DOUBLE * 95 + 0.5) AS INTEGER) AS percent FROM t"""

# preparation


def build_projection(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation")
    raw = n.select(F.concat(F.lit(" "), F.regexp_replace("n_name", "A", "   ")).alias("NAME"), F.col("n_name").alias("NAMELSAD"), F.col("n_nationkey").alias("COUNTYFP"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")).alias("STATEFP"))
    return etl.project(raw, "us-counties.geojson")


BUILD_PROJECTION = "SELECT trim(regexp_replace(replace(n_name, 'A', ' '), ' +', ' ', 'g')) AS \"NAME\", CAST(n_nationkey AS VARCHAR) AS \"COUNTY\", CASE WHEN n_regionkey > 1 THEN CAST(n_regionkey AS VARCHAR) ELSE '' END AS \"STATEFP\" FROM nation"


def default_projection(spark: SparkSession, d: str) -> DataFrame:
    """A file without a projection: the first key of the first feature that has any; beside one that has a projection."""
    n = _t(spark, d, "nation")
    props = F.when(F.col("n_nationkey") > 1, F.create_map(F.lit("STUSPS"), F.col("n_name"), F.lit("other"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    features = n.select(F.col("n_nationkey").cast("int").alias("fi"), props.alias("props"))
    texts = lambda source: F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias(source)
    unknown = etl.projected(features, "mine.geojson").select("fi", texts("unknown"))
    return unknown.join(etl.projected(features, "us-states.geojson").select("fi", texts("known")), "fi")


DEFAULT_PROJECTION = """SELECT n_nationkey AS fi, 'STUSPS=' || CASE WHEN n_nationkey > 1 THEN n_name ELSE '' END AS unknown,
 'NAME=,USPS=' || CASE WHEN n_nationkey > 1 THEN n_name ELSE '' END || ',FIPS=' AS known FROM nation"""


def rename_retail(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    return etl.rename_retail(s.select(F.col("s_name").alias("NAME"), F.lit("t").alias("TYPE"), F.lit("WA").alias("STATE"), F.col("s_suppkey").alias("HOLDING_CO"), F.lit("c").alias("CNTRL_AREA"), F.col("s_acctbal").alias("CUSTOMERS"), F.lit(1).alias("RETAIL_MWH")))


RENAME_RETAIL = "SELECT s_name AS name, 't' AS type, 'WA' AS state, s_suppkey AS hold_co, 'c' AS ctrl_area, s_acctbal AS customers FROM supplier"


def distinct_countries(spark: SparkSession, d: str) -> DataFrame:
    return etl.distinct_codes(_t(spark, d, "customer").select(F.when(F.col("c_custkey") % 9 > 0, F.col("c_nationkey")).alias("code")), "code")


def match_stats_strict(spark: SparkSession, d: str) -> DataFrame:
    """In mode all, without counting empty lists as matches."""
    return match_stats(enrich(points(spark, d), [diamonds(spark, d)], mode="all", keep_hidden=True, strict_stats=True))


STATS_STRICT = f"""WITH {POINTS_SQL}, {REGION_HITS}, {cell_sql('join', 'region_hits', 'region', 'r_regionkey', REGION_NAME, 'zone')}
SELECT count(*) AS "totalRows", count(*) FILTER ({OK_SQL} AND coalesce(zone, '') <> '') AS "matchedRows", count(*) FILTER ({OK_SQL} AND coalesce(zone, '') = '') AS "unmatchedRows",
       count(*) FILTER (NOT {OK_SQL}) AS "badCoordRows" FROM points LEFT JOIN zone_cells USING (c_custkey)"""


def grid_options(spark: SparkSession, d: str) -> DataFrame:
    """Another threshold and other subdivisions."""
    own = grid.cells(boxes(spark, d).select("fi", bbox(F.col("polygons")).alias("bbox")), threshold=3, subdivisions=2)
    return own.groupBy("level").agg(F.count("*").alias("postings"), F.count_distinct("ci", "cj", "si", "sj").alias("cells"))


GRID_OPTIONS = """WITH b AS (SELECT s_suppkey AS fi, 20 + CAST((s_suppkey * 37) % 100 AS DOUBLE) / 100 AS x0, 10 + CAST((s_suppkey * 53) % 100 AS DOUBLE) / 100 AS y0 FROM supplier),
base AS (SELECT *, x0 + 0.15::DOUBLE AS x1, y0 + 0.15::DOUBLE AS y1 FROM b),
c AS (SELECT *, count(*) OVER (PARTITION BY ci, cj) AS n FROM base, range(0, 180) p(ci), range(0, 360) q(cj) WHERE ci BETWEEN floor(y0 + 90) AND floor(y1 + 90) AND cj BETWEEN floor(x0 + 180) AND floor(x1 + 180)),
f AS (SELECT 1 AS level, ci, cj, si, sj FROM c, range(0, 2) p(si), range(0, 2) q(sj) WHERE n > 3
  AND si BETWEEN floor((greatest(y0, ci - 90) - (ci - 90)) * 2) AND least(1, floor((least(y1, ci - 89) - (ci - 90)) * 2)) AND sj BETWEEN floor((greatest(x0, cj - 180) - (cj - 180)) * 2) AND least(1, floor((least(x1, cj - 179) - (cj - 180)) * 2))
  UNION ALL SELECT 0, ci, cj, 0, 0 FROM c WHERE n <= 3)
SELECT level, count(*) AS postings, count(DISTINCT (ci, cj, si, sj)) AS cells FROM f GROUP BY level"""

# configuration and display

HEADERS = (("id", "lat", "lon"), ("Latitude", "LONGITUDE"), ("x", "y", "lng"), ("northing", "easting"), ("a", "b"), (" lat ", "long"))


def coordinate_columns(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, *detect_coordinates(list(h))) for i, h in enumerate(HEADERS)], "i int, lat string, lon string")


COORDINATE_COLUMNS = "SELECT * FROM (VALUES (0, 'lat', 'lon'), (1, 'Latitude', 'LONGITUDE'), (2, 'y', 'x'), (3, 'northing', 'easting'), (4, NULL, NULL), (5, ' lat ', NULL)) v(i, lat, lon)"


def layer_config(spark: SparkSession, d: str) -> DataFrame:
    """Selection of properties, uploads, the order of layers, what a run needs, and what colours and labels."""
    features, out = tessellation(spark, d).features, []
    layer = tessellation(spark, d)
    for key in ("n_regionkey", "n_name", "n_regionkey"):
        out.append(("toggle", ",".join(layer.toggle(key).selected)))
    upload, session = Layer.uploaded(features, "My zones", ["n_name", "n_regionkey"], 17), Session()
    out.append(("upload", f"{upload.id}|{upload.suggestion}|{','.join(upload.selected)}|{upload.outputs()[0][1]}"))
    session.add(upload), session.toggle(diamonds(spark, d)), session.toggle(layer)
    out.append(("session", ",".join(x.id for x in session.layers())))
    session.toggle(layer), session.remove(upload.id)
    out.append(("session", ",".join(x.id for x in session.layers())))
    for name, run in (("no layer", lambda: enrich(points(spark, d), [])), ("no columns", lambda: enrich(points(spark, d).drop("lat"), [layer])), ("no property", lambda: Layer(features, "x", "X", []))):
        try:
            run()
        except ValueError:
            out.append(("refused", name))
    out += [("color", display.color_key(*x)) for x in ((["b"], ["a", "b"]), ([], ["a"]), ([], []), (["b"], ["a"], "c"))]
    return spark.createDataFrame([(i, *x) for i, x in enumerate(out)], "i int, kind string, value string")


CONFIG = (
    ("toggle", "n_name,n_regionkey"), ("toggle", "n_regionkey"), ("toggle", "n_regionkey"), ("upload", "uploaded-17|My zones|n_name|My_zones"), ("session", "region,nation,uploaded-17"), ("session", "region"),
    ("refused", "no layer"), ("refused", "no columns"), ("refused", "no property"), ("color", "b"), ("color", "a"), ("color", ""), ("color", "c"),
)
LAYER_CONFIG = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(CONFIG)) + ") v(i, kind, value)"


def popup_rows(spark: SparkSession, d: str) -> DataFrame:
    """Joined columns first, blanks dropped, three rows at most."""
    rows = _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "zone").otherwise("").alias("zone"), F.lit(None).cast("string").alias("none"))
    out = display.popup(rows, rows.columns, ["zone", "absent"], 3)
    return out.select("c_custkey", F.array_join(F.transform("popup", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("popup"), "more")


POPUP_ROWS = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'zone=zone;c_custkey=' || c_custkey || ';c_name=' || c_name ELSE 'c_custkey=' || c_custkey || ';c_name=' || c_name || ';c_mktsegment=' || c_mktsegment END AS popup,
 CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS more FROM customer"""


def polygon_popup(spark: SparkSession, d: str) -> DataFrame:
    out = display.polygon_popup(diamonds(spark, d).features, [("key", "Number")])
    return out.select("fi", F.array_join(F.transform("popup", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("popup"))


POLYGON_POPUP = "SELECT r_regionkey AS fi, 'Number=' || r_regionkey || CASE r_regionkey WHEN 2 THEN '' ELSE ';r_name=' || r_name END AS popup FROM region"


def colored_polygons(spark: SparkSession, d: str) -> DataFrame:
    return display.colored_polygons(diamonds(spark, d).features, "missing", "#3388ff").select("fi", "color")


def base_names(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", base_name(F.concat("p_name", F.lit(".v2."), "p_brand")).alias("name"))


PAIRS = {
    "csv_scan": (csv_scan, CSV_SCAN), "csv_errors": (csv_errors, CSV_ERRORS), "csv_headers": (csv_headers, "SELECT * FROM (VALUES (0, 'key'), (1, 'name')) v(pos, name)"), "delimiter_sniff": (delimiter_sniff, SNIFF), "sample_source": (sample_source, SAMPLE),
    "translation_csv": (translation_csv, TRANSLATION_CSV), "geojson_scan": (geojson_scan, flat_sql(DIAMOND_RINGS)), "geojson_split": (geojson_split, GEOJSON_SPLIT), "geojson_properties": (geojson_properties, GEOJSON_PROPERTIES), "geojson_validation": (geojson_validation, VALIDATION),
    "polygon_filter": (polygon_filter, POLYGON_FILTER), "kml_scan": (kml_scan, flat_sql(DIAMOND_RINGS)), "kml_properties": (kml_properties, KML_PROPERTIES), "kmz_scan": (kmz_scan, flat_sql(DIAMOND_RINGS)),
    "gjbf_scan": (gjbf_scan, flat_sql(DIAMOND_RINGS)), "gjbf_source": (gjbf_source, GJBF_SOURCE), "gjbf_box": (gjbf_box, GJBF_BOX), "grid_rows": (grid_rows, GRID_ROWS), "gjbf_to_geojson": (gjbf_to_geojson, GJBF_TO_GEOJSON), "gjbf_build": (gjbf_build, GJBF_BUILD),
    "pip_given_grid": (pip_given_grid, PIP_REFINED), "wkb_scan": (wkb_scan, WKB_SCAN), "manifest_scan": (manifest_scan, MANIFEST), "layer_defaults": (layer_defaults, LAYER_DEFAULTS),
    "many_files": (many_files, "SELECT n_nationkey, n_name FROM nation"), "cached_layer": (cached_layer, "SELECT n_nationkey, n_name, 1 AS made FROM nation"), "utf8_check": (utf8_check, "SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 2 = 1"),
    "size_guard": (size_guard, SIZE_GUARD), "build_projection": (build_projection, BUILD_PROJECTION), "default_projection": (default_projection, DEFAULT_PROJECTION), "rename_retail": (rename_retail, RENAME_RETAIL),
    "distinct_countries": (distinct_countries, "SELECT count(DISTINCT CASE WHEN c_custkey % 9 > 0 THEN c_nationkey END) + CAST(bool_or(c_custkey % 9 = 0) AS INTEGER) AS countries FROM customer"),
    "match_stats_strict": (match_stats_strict, STATS_STRICT), "grid_options": (grid_options, GRID_OPTIONS), "coordinate_columns": (coordinate_columns, COORDINATE_COLUMNS), "layer_config": (layer_config, LAYER_CONFIG),
    "popup_rows": (popup_rows, POPUP_ROWS), "polygon_popup": (polygon_popup, POLYGON_POPUP), "colored_polygons": (colored_polygons, "SELECT r_regionkey AS fi, '#3388ff' AS color FROM region"),
    "base_names": (base_names, "SELECT p_partkey, p_name || '.v2' AS name FROM part"),
}
