"""GeoJSON polygons: validation, reading, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.geometry import POLYGONS
from .joined import write_text
from .shared import delete

RING = "array<array<array<double>>>"


def _key(v: str, path: str, kind: str = "string") -> str:
    return f"try_variant_get({v}, '{path}', '{kind}')"


def feature_error(f: str, i: str) -> str:
    """SQL of what is wrong with a feature (a variant column) of number i, or null."""
    return f"""CASE WHEN schema_of_variant({f}) NOT LIKE 'OBJECT%' THEN 'Feature ' || {i} || ' is not an object.'
      WHEN variant_get({f}, '$.geometry') IS NULL OR is_variant_null(variant_get({f}, '$.geometry')) THEN 'Feature ' || {i} || ' has no geometry.'
      WHEN {_key(f, '$.geometry.type')} IS NULL THEN 'Feature ' || {i} || ' has no geometry type.'
      WHEN {_key(f, '$.geometry.type')} NOT IN ('Polygon', 'MultiPolygon') THEN 'Feature ' || {i} || ' is not a polygon.'
      WHEN schema_of_variant(variant_get({f}, '$.geometry.coordinates')) LIKE 'ARRAY%' THEN NULL
      ELSE 'Feature ' || {i} || ' has no coordinates.' END"""


def validation_error(v: str) -> Column:
    """The first thing wrong with a parsed text (a variant column), or null. One feature that is not a polygon makes the
    whole file wrong."""
    features = f"try_variant_get({v}, '$.features', 'array<variant>')"
    return F.expr(f"""CASE WHEN {v} IS NULL OR schema_of_variant({v}) NOT LIKE 'OBJECT%' THEN 'Not a JSON object.'
      WHEN coalesce({_key(v, '$.type')}, '') <> 'FeatureCollection' THEN 'Not a FeatureCollection.'
      WHEN coalesce(size({features}), 0) <= 0 THEN 'The collection has no features.'
      ELSE get(filter(transform({features}, (f, i) -> {feature_error('f', 'i')}), m -> m IS NOT NULL), 0) END""")


def read_geojson(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """fi, props, polygons of the files under path, in order of file and place. Positions keep longitude and latitude alone. validate: refuse a file
    at its first error; without it, features that are not polygons are left out, before they are numbered."""
    raw = spark.read.text(path, wholetext=True)
    files = raw.select(F.col("_metadata.file_path").alias("file"), F.expr("try_parse_json(value)").alias("v"))
    if validate:
        wrong = files.select(validation_error("v").alias("e")).where("e is not null").first()
        if wrong:
            raise ValueError(wrong["e"])
    polygonal = f"filter(try_variant_get(v, '$.features', 'array<variant>'), f -> {_key('f', '$.geometry.type')} IN ('Polygon', 'MultiPolygon'))"
    files = files.withColumn("own", F.expr(polygonal)).drop("v")
    if len(raw.inputFiles()) > 1:  # numbers go on from file to file; only their counts are brought together
        before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
        starts = files.select("file", F.coalesce(F.size("own"), F.lit(0)).alias("n")).select("file", F.coalesce(before, F.lit(0)).alias("start"))
        files = files.join(starts, "file")
    else:
        files = files.withColumn("start", F.lit(0))
    return parsed_features(files.select("start", F.posexplode("own").alias("pos", "f")))


def parsed_features(features: DataFrame) -> DataFrame:
    """fi, props, polygons of features (start, pos, f: a variant column of a polygon or multipolygon)."""
    kind = F.expr(_key("f", "$.geometry.type"))
    features = features.withColumn("kind", kind)
    one = F.array(F.expr(f"try_variant_get(f, '$.geometry.coordinates', '{RING}')"))
    many = F.expr(f"try_variant_get(f, '$.geometry.coordinates', 'array<{RING}>')")
    coordinates = F.when(F.col("kind") == "Polygon", one).otherwise(many)
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
    polygons = F.transform(coordinates, lambda part: F.transform(part, lambda ring: F.transform(ring, point)))
    props = F.expr("try_variant_get(f, '$.properties', 'map<string,variant>')")
    texts = F.coalesce(F.transform_values(props, lambda _, v: F.coalesce(v.cast("string"), F.lit(""))), F.create_map().cast("map<string,string>"))
    return features.select((F.col("start") + F.col("pos")).cast("int").alias("fi"), texts.alias("props"), polygons.cast(POLYGONS).alias("polygons"))


def geometry_json(polygons: Column) -> Column:
    coordinates = F.transform(polygons, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))))
    single = F.struct(F.lit("Polygon").alias("type"), F.get(coordinates, F.lit(0)).alias("coordinates"))
    multi = F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))
    return F.when(F.size(polygons) == 1, F.to_json(single)).otherwise(F.to_json(multi))


def feature_lines(features: DataFrame) -> DataFrame:
    """value: one GeoJSON feature per row."""
    text = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json("props"), F.lit(',"geometry":'), geometry_json(F.col("polygons")), F.lit("}"))
    return features.select("fi", text.alias("value"))


def write_geojson(features: DataFrame, path: str, collection: bool = True) -> None:
    """A feature collection in one file of a folder, which tasks write in parts that are joined, or features as lines in many files."""
    lines = feature_lines(features)
    if collection:
        delete(features.sparkSession, path)
        write_text(lines.orderBy("fi").select("value"), f"{path}/part-00000.json", head='{"type":"FeatureCollection","features":[', sep=",", tail="]}\n")
    else:
        lines.select("value").write.mode("overwrite").text(path)
