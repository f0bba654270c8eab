"""Readers and writers."""

import json
import zipfile

import pytest

from plumbline.functions.geometry import bbox
from plumbline.operators.enrich import enrich
from plumbline.operators.grid import cells
from plumbline.plans.layer import Layer
from plumbline.sources import binary, geojson, kml, layer_files, tables

KML = """<?xml version="1.0"?><k:kml xmlns:k="http://www.opengis.net/kml/2.2"><k:Document>
<k:Placemark><k:description>only a note</k:description><k:ExtendedData><k:Data name="depth"><k:value>9</k:value></k:Data></k:ExtendedData></k:Placemark>
<k:Folder><k:Placemark><k:name>Kite</k:name><k:ExtendedData><k:Data name="owner"><k:value> harbour </k:value></k:Data></k:ExtendedData>
<k:Polygon><k:outerBoundaryIs><k:LinearRing><k:coordinates>4,0,7 8,5,7 4,14,7 0,5,7</k:coordinates></k:LinearRing></k:outerBoundaryIs></k:Polygon></k:Placemark></k:Folder>
<k:Placemark><k:name>Frame</k:name><k:Polygon><k:outerBoundaryIs><k:LinearRing><k:coordinates>20,-8 41,-8 41,9 20,9 20,-8</k:coordinates></k:LinearRing></k:outerBoundaryIs>
<k:innerBoundaryIs><k:LinearRing><k:coordinates>23,-5 38,-5 38,6 23,6 23,-5</k:coordinates></k:LinearRing></k:innerBoundaryIs></k:Polygon></k:Placemark>
<k:Placemark><k:name>Islets</k:name><k:MultiGeometry><k:Polygon><k:outerBoundaryIs><k:LinearRing><k:coordinates>60,1 63,1 61,6 60,1</k:coordinates></k:LinearRing></k:outerBoundaryIs></k:Polygon>
<k:Polygon><k:outerBoundaryIs><k:LinearRing><k:coordinates>70,-3 75,-3 75,-1 70,-1 70,-3</k:coordinates></k:LinearRing></k:outerBoundaryIs></k:Polygon></k:MultiGeometry></k:Placemark>
</k:Document></k:kml>"""


def collection(*features):
    return {"type": "FeatureCollection", "features": list(features)}


def square(x0, y0, x1, y1, **props):
    return {"type": "Feature", "properties": props, "geometry": {"type": "Polygon", "coordinates": [[[x0, y0, 5], [x1, y0, 5], [x1, y1, 5], [x0, y1, 5], [x0, y0, 5]]]}}


def names(spark, layer, points):
    rows = spark.createDataFrame([(i, str(y), str(x)) for i, (x, y) in enumerate(points)], "id int, lat string, lon string")
    return [r["L"] for r in enrich(rows, [layer]).orderBy("id").collect()]


def test_geojson_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(collection(square(3, -7, 9, -4, name="quay", n=1, ok=True, none=None), square(-31, 44, -28.5, 45, name="Señal"))))
    f = geojson.read_geojson(spark, str(tmp_path / "a.json"))
    rows = f.orderBy("fi").collect()
    assert rows[0]["props"] == {"name": "quay", "n": "1", "ok": "true", "none": ""} and rows[1]["props"]["name"] == "Señal"
    geojson.write_geojson(f, str(tmp_path / "out"))
    again = geojson.read_geojson(spark, str(tmp_path / "out"))
    assert [r["polygons"] for r in again.orderBy("fi").collect()] == [r["polygons"] for r in rows]
    assert names(spark, Layer(again, "l", "L", [("name", "name")]), [(4, -5), (5, 5), (-29, 44.5)]) == ["quay", "", "Señal"]


@pytest.mark.parametrize("bad", ["[1]", '{"type":"X"}', '{"type":"FeatureCollection"}', '{"type":"FeatureCollection","features":[]}', '{"type":"FeatureCollection","features":[3]}',
                                 '{"type":"FeatureCollection","features":[{"type":"Feature"}]}', '{"type":"FeatureCollection","features":[{"geometry":{}}]}',
                                 '{"type":"FeatureCollection","features":[{"geometry":{"type":"Point","coordinates":[1,2]}}]}', '{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon"}}]}', "not json"])
def test_geojson_errors(spark, tmp_path, bad):
    (tmp_path / "a.json").write_text(bad)
    with pytest.raises(ValueError):
        geojson.read_geojson(spark, str(tmp_path / "a.json"))


def test_kml_and_kmz(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    with zipfile.ZipFile(tmp_path / "b.kmz", "w") as z:
        z.writestr("zzz.kml", "<x/>"), z.writestr("doc.kml", KML)
    for name in ("a.kml", "b.kmz"):
        f = kml.read_kml(spark, str(tmp_path / name))
        rows = f.orderBy("fi").collect()
        assert [r["props"]["Name"] for r in rows] == ["Kite", "Frame", "Islets"] and rows[0]["props"]["owner"] == "harbour"
        assert rows[0]["keys"] == ["Name", "Description", "depth", "owner"] and len(rows[0]["warnings"]) == 1  # keys of skipped placemarks too
        assert names(spark, Layer(f, "l", "L", [("Name", "Name")]), [(4, 6), (30, 0), (21, 0), (72, -2), (0, 0)]) == ["Kite", "", "Frame", "Islets", ""]


def test_kml_errors():
    for text, start in (("<a><b></a>", "Invalid XML"), ("<kml></kml>", "No Placemark"), ("<kml><Placemark/></kml>", "No polygon")):
        with pytest.raises(ValueError, match=start):
            kml.parse_kml(text)
    assert kml.positions("1,2 3,4") is None and kml.positions("1,2,9 3,4 5x,6 a,b") == [(1, 2), (3, 4), (5, 6), (1, 2)]


def test_binary_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(collection(square(-6, 3, -2, 8, name="a"), *(square(50.1, 50.1, 50.3, 50.3, name=f"s{i}") for i in range(21)))))
    f = geojson.read_geojson(spark, str(tmp_path / "a.json"))
    layer_files.write_layer(f, str(tmp_path / "a.gjbf"), ["name"])
    read = binary.read_gjbf(spark, str(tmp_path / "a.gjbf"))
    assert [r["polygons"] for r in binary.dequantised(read).orderBy("fi").collect()] == [r["polygons"] for r in f.orderBy("fi").collect()]
    text = binary.geometry_texts(read).where("fi = 0").first()["geometry"]
    assert json.loads(text) == {"type": "Polygon", "coordinates": [[[-6, 3], [-2, 3], [-2, 8], [-6, 8], [-6, 3]]]}
    assert spark.read.format("gjbf").load(str(tmp_path / "a.gjbf")).count() == 22
    (tmp_path / "two").mkdir()
    for x in ("a", "b"):
        (tmp_path / "two" / x).write_bytes((tmp_path / "a.gjbf").read_bytes())
    assert spark.read.format("gjbf").load(f"file:{tmp_path}/two").count() == 44
    own = cells(f.select("fi", bbox(f["polygons"]).alias("bbox")))
    layer_files.write_grid(own, str(tmp_path / "a.grid"))
    again = binary.read_grid(spark, str(tmp_path / "a.grid"))
    assert sorted(map(tuple, spark.read.format("ggrid").load(str(tmp_path / "a.grid")).collect())) == sorted(map(tuple, own.collect()))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, own.collect())) and again.where("level = 1").count() > 0
    with pytest.raises(ValueError, match="Bad magic"):
        list(binary.decode_layer(b"\0" * 40))


def test_wkb(spark, tmp_path):
    import struct

    ring = struct.pack("<I", 4) + b"".join(struct.pack("<ddd", *p, 9) for p in ((0, 0), (2, 0), (2, 2), (0, 0)))
    poly = struct.pack("<BII", 1, 1003, 1) + ring
    multi = struct.pack("<BII", 1, 1006, 2) + poly + poly
    assert len(binary.decode_wkb(multi)) == 2 and binary.decode_wkb(poly)[0][0][1] == [2.0, 0.0] and binary.decode_wkb(struct.pack("<BIdd", 1, 1, 0, 0)) is None
    spark.createDataFrame([(" n ", bytearray(poly)), ("point", bytearray(struct.pack("<BIdd", 1, 1, 0, 0)))], "name string, geometry binary").coalesce(1).write.parquet(str(tmp_path / "w"))
    rows = binary.read_wkb_parquet(spark, str(tmp_path / "w"), "geometry", ["name"]).collect()
    assert len(rows) == 1 and rows[0]["props"] == {"name": "n"}


def test_several_files_are_numbered_in_order(spark, tmp_path):
    for d, text in (("g", json.dumps(collection(square(0, 0, 1, 1), {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}}, square(1, 0, 2, 1)))), ("k", KML)):
        (tmp_path / d).mkdir()
        for x in ("b", "a", "c"):
            (tmp_path / d / x).write_text(text)
    read = geojson.read_geojson(spark, str(tmp_path / "g"), validate=False)
    assert [(r["fi"], r["polygons"][0][0][0]["lon"]) for r in read.orderBy("fi").collect()] == [(i, i % 2) for i in range(6)]
    assert [(r["fi"], r["props"]["Name"]) for r in kml.read_kml(spark, str(tmp_path / "k")).orderBy("fi").collect()] == [(i, ("Kite", "Frame", "Islets")[i % 3]) for i in range(9)]


def test_shared_folder(spark, monkeypatch):
    from plumbline.sources import shared

    class Cluster:
        conf = type("C", (), {"get": lambda self, k, d=None: d})()
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": lambda self: None})()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared.shared_root(Cluster())
    path = shared.put_bytes(spark, f"{shared.shared_folder(spark, 't')}/x", b"abc")
    assert shared.exists(spark, path) and spark.read.format("binaryFile").load(path).first()["content"] == b"abc"
    shared.delete(spark, path)
    assert not shared.exists(spark, path)


def test_csv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(' lat\tlon\tname\n1\t2\t"x ""y"""\n\n3\t\tz\n')
    df = tables.read_csv(spark, str(tmp_path / "a.tsv"))
    assert df.columns == ["lat", "lon", "name"] and [tuple(r) for r in df.collect()] == [("1", "2", 'x "y"'), ("3", "", "z")]
    assert tables.csv_headers(spark, str(tmp_path / "a.tsv")) == ["lat", "lon", "name"]
    tables.write_csv(df, str(tmp_path / "out"), order="lat", bom=True)
    text = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbflat,lon,name\r\n") and text.endswith(b"3,,z\r\n")
    (tmp_path / "b.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "b.csv"), ",").collect()
    (tmp_path / "c.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no data rows"):
        tables.read_csv(spark, str(tmp_path / "c.csv"), ",")
    assert tables.sample_points(spark).count() == 20


def test_manifest_and_translation(spark, tmp_path):
    entry = {"id": "state", "label": "US States", "group": "US", "defaultPropertyKey": "NAME", "properties": [{"key": "NAME", "label": "Name", "example": "x"}]}
    (tmp_path / "m.json").write_text(json.dumps([entry]))
    assert tables.read_manifest(spark, str(tmp_path / "m.json")).first()["properties"][0]["key"] == "NAME"
    own = Layer.from_manifest(entry, spark.createDataFrame([], "fi int"))
    assert own.outputs() == [("NAME", "US_States")] and own.color == "#3498db"
    assert tables.asset_path("/data/", "/old/x/a.gjbf") == "/data/x/a.gjbf"
    t = spark.createDataFrame([("B", 'b "q"', 1), ("A", "a", 0)], "short string, long string, first_fi int")
    tables.write_translation(t, str(tmp_path / "t"))
    assert [tuple(r) for r in tables.read_translation(spark, str(tmp_path / "t")).collect()] == [("A", "a"), ("B", 'b "q"')]


def test_cache(spark, tmp_path):
    from plumbline.plans.cache import LayerCache

    clock = [100.0]
    cache = LayerCache(spark, str(tmp_path / "c"), now=lambda: clock[0])
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert cache.get("a/b", "v1") is None and cache.get_or("a/b", "v1", make).count() == 3
    assert cache.get_or("a/b", "v1", make).count() == 3 and len(made) == 1
    assert cache.get("a/b", "v2") is None
    clock[0] += 24 * 3600 + 1
    assert cache.get("a/b", "v1") is None
