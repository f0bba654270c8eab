"""Layer and grid files: written by tasks, read in ranges, filters pushed down."""

import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.geometry import bbox, rings
from plumbline.operators.grid import cells
from plumbline.sources import binary, layer_files

FEATURE = "fi int, props map<string,string>, polygons array<array<array<struct<lon:double,lat:double>>>>"


def features(spark, n, seed=1):
    rng = random.Random(seed)

    def ring(x, y, k):
        own = [{"lon": round(x + rng.uniform(0, 3), 6), "lat": round(y + rng.uniform(0, 3), 6)} for _ in range(k)]
        return [*own, own[0]]

    rows = []
    for i in range(n):
        x, y = rng.uniform(-170, 160), rng.uniform(-80, 70)
        parts = [[ring(x, y, rng.randrange(3, 9)) for _ in range(rng.randrange(1, 3))] for _ in range(rng.randrange(3))]
        rows.append((i, {"name": f"ñ{i} " * (i % 4), "code": None if i % 5 == 0 else str(i)} if i % 7 else None, parts if i % 11 else None))
    return spark.createDataFrame(rows, FEATURE).repartition(3)


def plainly(df, keys):
    """The file as the codec makes it of collected rows."""
    rows = df.select("fi", "props", bbox(F.col("polygons")).alias("b"), rings(F.col("polygons")).alias("parts")).orderBy("fi").collect()
    inf = float("inf")
    box = lambda b: [inf, inf, -inf, -inf] if b is None or b[0] is None else list(b)
    return binary.encode_layer([(r["props"] or {}, box(r["b"]), [[(x["xs"], x["ys"]) for x in part] for part in r["parts"] or []]) for r in rows], keys)


@pytest.mark.parametrize("n", [0, 1, 60])
def test_tasks_write_the_codecs_bytes(spark, tmp_path, n):
    f = features(spark, n)
    path = layer_files.write_layer(f, str(tmp_path / "a.gjbf"), ["name", "code"])
    assert open(path, "rb").read() == plainly(f, ["name", "code"])
    layer_files.write_layer(f, path, ["code"])  # takes the place of the first
    assert open(path, "rb").read() == plainly(f, ["code"])
    assert os.listdir(tmp_path) == ["a.gjbf"] or sorted(x for x in os.listdir(tmp_path) if not x.endswith(".crc")) == ["a.gjbf"]
    boxes = f.where("polygons is not null").select("fi", bbox(F.col("polygons")).alias("bbox"))
    own = cells(boxes)
    grid = layer_files.write_grid(own, str(tmp_path / "a.grid"))
    assert open(grid, "rb").read() == binary.encode_grid([tuple(r) for r in own.collect()])


def test_refined_cells(spark, tmp_path):
    rows = [(0, ci, cj, 0, 0, fi) for ci in range(3) for cj in range(40) for fi in range(2)] + [(1, 90, 5, si, sj, 9) for si in range(5) for sj in (0, 4)]
    own = spark.createDataFrame(rows, binary.GRID_SCHEMA)
    path = layer_files.write_grid(own, str(tmp_path / "a.grid"))
    assert open(path, "rb").read() == binary.encode_grid(rows)
    for step in (1, 7, 4096):
        got = spark.read.format("ggrid").option("cells_per_task", step).load(path)
        assert sorted(map(tuple, got.collect())) == sorted(rows)
        assert sorted(map(tuple, layer_files.read_cells(spark, path, ci=(2, 90), cells_per_task=step).collect())) == sorted(r for r in rows if r[1] >= 2)
        assert sorted(map(tuple, layer_files.read_cells(spark, path, (0, 1), (3, 5), step).collect())) == sorted(r for r in rows if r[1] < 2 and 3 <= r[2] <= 5)


@pytest.mark.parametrize("step", [1, 7, 100])
def test_ranges_give_what_the_whole_gives(spark, tmp_path, step):
    f = features(spark, 60)
    path = layer_files.write_layer(f, str(tmp_path / "a.gjbf"), ["name", "code"])
    read = spark.read.format("gjbf").option("features_per_task", step).load(path)
    whole = {r["fi"]: r for r in binary.read_gjbf(spark, path).collect()}
    assert {r["fi"]: r for r in read.collect()} == whole
    box = lambda r: (r["bbox"]["min_lon"], r["bbox"]["min_lat"], r["bbox"]["max_lon"], r["bbox"]["max_lat"])
    meets = lambda a, b: a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]
    half, none = (-180.0, 5.0, 20.0, 90.0), (500.0, 0.0, 501.0, 1.0)
    for fi, own in ((None, half), ((41, 44), None), ((7, 7), None), ((12, 50), half), (None, none), ((70, 80), None)):
        some = layer_files.read_layer(spark, path, fi, own, step)
        assert {r["fi"]: r for r in some.collect()} == {i: r for i, r in whole.items() if (not fi or fi[0] <= i <= fi[1]) and (not own or meets(box(r), own))}, (fi, own)
    # bounds of one read are not those of another
    assert read.count() == 60 and layer_files.read_layer(spark, path, (3, 4)).unionByName(layer_files.read_layer(spark, path)).count() == 62


def test_bounds_choose_ranges(spark, tmp_path):
    path = layer_files.write_layer(features(spark, 60), str(tmp_path / "a.gjbf"), ["name"])
    assert layer_files.read_layer(spark, path, features_per_task=5).rdd.getNumPartitions() == 12
    assert layer_files.read_layer(spark, path, (11, 13), features_per_task=5).rdd.getNumPartitions() == 1
    assert layer_files.read_layer(spark, path, (9, 10), features_per_task=5).rdd.getNumPartitions() == 2


def test_a_range_reads_little_of_a_large_file(spark, tmp_path):
    ring = [{"lon": i / 1e4, "lat": (i * i % 997) / 1e3} for i in range(60_000)]
    f = spark.range(40).select(F.col("id").cast("int").alias("fi"), F.create_map().cast("map<string,string>").alias("props"), F.array(F.array(F.lit(None).cast("array<struct<lon:double,lat:double>>"))).alias("polygons"))
    big = spark.createDataFrame([(ring,)], "ring array<struct<lon:double,lat:double>>")
    f = f.crossJoin(big).select("fi", "props", F.array(F.array("ring")).alias("polygons"))
    path = layer_files.write_layer(f, str(tmp_path / "a.gjbf"), [])
    size = os.path.getsize(path)
    reader, read = layer_files.LayerReader({"path": path, "features_per_task": "1"}), []
    take = layer_files.Stream.take

    def counted(self, n):
        before = self.fetched
        out = take(self, n)
        read.append(self.fetched - before)
        return out

    layer_files.Stream.take = counted
    try:
        ranges = reader.partitions()
        assert len(ranges) == 40
        read.clear()
        assert len(next(iter(reader.read(ranges[17])))[4][0][0][0]) == 60_000
    finally:
        layer_files.Stream.take = take
    assert size > 19_000_000 and sum(read) < 3 * layer_files.BLOCK


def test_what_may_not_be_written(spark, tmp_path):
    f = features(spark, 9)
    gaps = f.where("fi <> 4")
    for wrong in (gaps, f.withColumn("fi", F.col("fi") + 1)):
        with pytest.raises(Exception, match="without gaps"):
            layer_files.write_layer(wrong, str(tmp_path / "b.gjbf"), [])
    assert not [x for x in os.listdir(tmp_path) if "writing" in x or x == "b.gjbf"]
    path = layer_files.write_layer(f, str(tmp_path / "a.gjbf"), [])
    with pytest.raises(Exception, match="there already"):
        f.select("fi", "props", bbox(F.col("polygons")).alias("bbox"), F.lit(None).cast("array<array<struct<xs:array<int>,ys:array<int>>>>").alias("parts")).orderBy("fi").write.format("gjbf").mode("append").save(path)
    (tmp_path / "bad").write_bytes(b"\0" * 40)
    for kind, message in (("gjbf", "Bad magic"), ("ggrid", "Bad grid magic")):
        with pytest.raises(Exception, match=message):
            spark.read.format(kind).load(str(tmp_path / "bad")).count()
    whole = open(path, "rb").read()
    (tmp_path / "cut").write_bytes(whole[:200])
    with pytest.raises(Exception, match="too early"):
        spark.read.format("gjbf").load(str(tmp_path / "cut")).count()
