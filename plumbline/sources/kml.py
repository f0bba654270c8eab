"""KML and KMZ placemarks as polygon features.

Whole files are parsed, one task a file, since a file is refused as a whole: malformed XML, no placemark, or no
polygon at all. Names are compared without prefix and case."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.geometry import POLYGONS

NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def _name(e) -> str:
    return e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""


def _children(e, name: str) -> list:
    return [c for c in e if _name(c) == name.lower()]


def _child(e, *names: str):
    for n in names:
        e = next(iter(_children(e, n)), None) if e is not None else None
    return e


def _text(e) -> str:
    return "".join(e.itertext()).strip() if e is not None else ""


def positions(text: str) -> list[tuple[float, float]] | None:
    """(lon, lat) of a coordinates text, closed; None below three. Numbers are read as far as they go."""
    out = []
    for item in text.split():
        parts = [NUMBER.match(x) for x in item.split(",")[:2]]
        if len(parts) == 2 and all(parts):
            out.append((float(parts[0][0]), float(parts[1][0])))
    if len(out) < 3:
        return None
    return out if out[0] == out[-1] else [*out, out[0]]


def _ring(boundary):
    return positions(_text(_child(boundary, "LinearRing", "coordinates"))) if boundary is not None else None


def polygon(e) -> list | None:
    """Rings of a polygon: an outer of four positions or more, and those inner rings that have as many."""
    outer = _ring(_child(e, "outerBoundaryIs"))
    if not outer or len(outer) < 4:
        return None
    inner = [_ring(b) for b in _children(e, "innerBoundaryIs")]
    return [outer, *(r for r in inner if r and len(r) >= 4)]


def properties(pm) -> dict[str, str]:
    out = {"Name": _text(_child(pm, "name")), "Description": _text(_child(pm, "description"))}
    data = _child(pm, "ExtendedData")
    if data is not None:
        for d in _children(data, "Data"):
            value = _child(d, "value")
            if d.get("name"):
                out[d.get("name")] = _text(value if value is not None else d)
        schema = _child(data, "SchemaData")
        for d in _children(schema, "SimpleData") if schema is not None else []:
            if d.get("name"):
                out[d.get("name")] = _text(d)
    return {k: v for k, v in out.items() if v}


def parse_kml(text: str | bytes) -> tuple[list[tuple[dict, list]], list[str], list[str]]:
    """(features as (props, polygons), property keys, warnings)."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise ValueError(f"Invalid XML: {e}") from None
    marks = [e for e in root.iter() if _name(e) == "placemark"]
    if not marks:
        raise ValueError("No Placemark elements found.")
    out, keys, warnings = [], ["Name", "Description"], []
    for i, pm in enumerate(marks):
        props = properties(pm)
        keys += [k for k in props if k not in keys]  # those of skipped placemarks too
        title = props.get("Name") or f"#{i + 1}"
        one, many = _child(pm, "Polygon"), _child(pm, "MultiGeometry")
        if one is not None:
            rings = polygon(one)
            parts = [rings] if rings else []
            if not parts:
                warnings.append(f"Placemark {title}: polygon without a closed outer ring skipped.")
        elif many is not None:
            parts = [p for p in (polygon(e) for e in many.iter() if _name(e) == "polygon") if p]
            if not parts:
                warnings.append(f"Placemark {title}: no valid polygon, skipped.")
        else:
            parts = []
            warnings.append(f"Placemark {title}: no polygon, skipped.")
        if parts:
            out.append((props, parts))
    if not out:
        raise ValueError("No polygon features found.")
    return out, keys, warnings


def kml_of_kmz(data: bytes) -> bytes:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        name = "doc.kml" if "doc.kml" in names else min((n for n in names if n.endswith(".kml")), default=None)
        if name is None:
            raise ValueError("No .kml file in the archive.")
        return z.read(name)


def _read(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                features, keys, warnings = parse_kml(kml_of_kmz(data) if name.lower().endswith(".kmz") else data)
                polygons = [[[[{"lon": x, "lat": y} for x, y in ring] for ring in part] for part in parts] for _, parts in features]
                n = len(features)
                kind = pa.list_(pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array(range(n), pa.int32()), pa.array([list(p.items()) for p, _ in features], pa.map_(pa.string(), pa.string())), pa.array(polygons, kind), pa.array([keys] * n, pa.list_(pa.string())), pa.array([warnings] * n, pa.list_(pa.string()))],
                    ["file", "pos", "props", "polygons", "keys", "warnings"],
                )

    return files.mapInArrow(run, f"file string, pos int, props map<string,string>, polygons {POLYGONS}, keys array<string>, warnings array<string>")


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """fi, props, polygons, keys, warnings of the KML and KMZ files under path, in order of file and place."""
    rows = _read(spark, path)
    if len(spark.read.format("binaryFile").load(path).inputFiles()) > 1:  # only the files' counts are brought together
        before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
        starts = rows.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(before, F.lit(0)).alias("start"))
        rows = rows.join(starts, "file")
    else:
        rows = rows.withColumn("start", F.lit(0))
    return rows.select((F.col("start") + F.col("pos")).cast("int").alias("fi"), "props", "polygons", "keys", "warnings")


read_kmz = read_kml
