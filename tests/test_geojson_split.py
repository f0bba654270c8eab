"""GeoJSON files in many blocks give what the whole file gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.sources import geojson
from plumbline.sources.geojson_split import Split, read_geojson_split


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def feature(rng, i):
    ring = [[rng.uniform(-9, 9), rng.uniform(-9, 9), 1.0] for _ in range(rng.randrange(3, 7))]
    text = rng.choice(["plain", "}{][", 'quo"te', "back\\slash", "\\", '\\"', "é😀", "a,b", "new\nline", "", '}"features":[{'])
    geometry = rng.choice([{"type": "Polygon", "coordinates": [[*ring, ring[0]]]}, {"type": "MultiPolygon", "coordinates": [[[*ring, ring[0]]]] * 2}])
    return {"type": "Feature", "properties": rng.choice([{"name": text, "n": i, "deep": {"x": [1, {"y": "}"}]}}, {text: None}, {}]), "geometry": geometry}


def write(path, features, rng, **extra):
    top = {"name": 'a "features":[ in a text', "type": "FeatureCollection", "crs": {"properties": {"features": [1, {"a": 2}]}}, "list": [{"z": 1}, {"z": "]"}], "features": features, "bbox": [1, 2], **extra}
    text = json.dumps(top, indent=rng.choice([None, 1]), ensure_ascii=rng.choice([True, False])) + rng.choice(["", "\n", " \r\n"])
    path.write_bytes(text.encode())


def same(spark, path, validate=True):
    rows = lambda df: sorted(map(repr, df.collect()))
    want, got = geojson.read_geojson(spark, path, validate), read_geojson_split(spark, path, validate)
    assert got.schema == want.schema or got.dtypes == want.dtypes
    assert rows(got) == rows(want)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_give_what_the_whole_gives(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    (tmp_path / "d").mkdir()
    for name, n in (("a.json", 25), ("b.json", 1), ("c.json", 12)):
        write(tmp_path / "d" / name, [feature(rng, i) for i in range(n)], rng)
    assert Split(spark, str(tmp_path / "d")).lines.rdd.getNumPartitions() > 8
    got = same(spark, str(tmp_path / "d"))
    assert got.count() == 38 and got.agg(F.countDistinct("fi"), F.max("fi")).first()[:] == (38, 37)


def test_other_geometries(spark, tmp_path, small_blocks):
    rng = random.Random(7)
    odd = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"geometry": None}, 5, None, "x,]}", [], {"geometry": {"type": "Polygon"}}]
    features = [f for i in range(20) for f in (feature(rng, i), rng.choice(odd[:6]))]
    write(tmp_path / "a.json", features, rng)
    assert same(spark, str(tmp_path / "a.json"), validate=False).count() == 20
    with pytest.raises(ValueError) as whole:
        geojson.read_geojson(spark, str(tmp_path / "a.json"))
    with pytest.raises(ValueError) as split:
        read_geojson_split(spark, str(tmp_path / "a.json"))
    assert str(whole.value) == str(split.value) and "Feature 1 " in str(split.value)


GOOD = '{"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}'


@pytest.mark.parametrize("bad", ["[1]", '{"type":"X"}', '{"type":"FeatureCollection"}', '{"type":"FeatureCollection","features":[]}', '{"type":"FeatureCollection","features":[ \n ]}', '{"type":"FeatureCollection","features":[3]}',
                                 '{"type":"FeatureCollection","features":[' + GOOD + ', {"type":"Feature"}]}', '{"type":"FeatureCollection","features":[' + GOOD + ']', '{"type":"X","features":[' + GOOD + ']}',
                                 '{"type":"FeatureCollection","features":[' + GOOD + ',]}', '{"type":"FeatureCollection","features":[' + GOOD + ' 5]}', '{"type":"FeatureCollection","features":{"a":1}}', "not json", '{"a":"'])
def test_errors_are_those_of_the_whole(spark, tmp_path, bad):
    (tmp_path / "a.json").write_text(bad)
    with pytest.raises(ValueError) as whole:
        geojson.read_geojson(spark, str(tmp_path / "a.json"))
    with pytest.raises(ValueError) as split:
        read_geojson_split(spark, str(tmp_path / "a.json"))
    assert str(split.value) == str(whole.value)


def test_result_reads_the_text_once(spark, tmp_path, small_blocks):
    """Whole features come of one pass, beside what Spark keeps of broken ones, and checked features need no numbering; quotes behind many backslashes."""
    rng = random.Random(3)
    features = [feature(rng, i) for i in range(30)]
    for i, f in enumerate(features):
        f["properties"] = {"a": "\\" * (i % 5) + '"}],[' + "\\" * (i % 3), "\\" * (i % 4): "é" * i}
    write(tmp_path / "a.json", features, rng)
    got = same(spark, str(tmp_path / "a.json"))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") <= 2 and "Window" not in plan and "InMemoryTableScan" in plan
