"""The join against a plain restatement, its modes, and its invariants."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.geometry import POLYGONS
from plumbline.operators.enrich import enrich, match_stats, observed
from plumbline.plans.layer import Layer, Session

BOXES = [
    (0, [[(0, 0, 2, 2)]], "A"),
    (1, [[(10, 10, 14, 14), (11, 11, 12, 12), (13, 13, 16, 16)]], "B"),
    (2, [[(20, 20, 24, 24)], [(22, 22, 26, 26)]], "C"),
    (3, [[(1, 1, 3, 3)]], "D"),
]
SCHEMA = f"fi int, props map<string,string>, polygons {POLYGONS}"


def ring(x0, y0, x1, y1):
    return [{"lon": float(x), "lat": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


def layer(spark, boxes=BOXES, **kw):
    rows = [(fi, {"n": v, "k": str(fi)}, [[ring(*r) for r in part] for part in parts]) for fi, parts, v in boxes]
    return Layer(spark.createDataFrame(rows, SCHEMA), "box", "Box", [("n", "Name"), ("k", "Key")], **kw)


GOLDEN = {
    (1, 1): "03", (1.5, 1.5): "03", (2, 2): "3", (0, 0): "0", (0, 1): "0", (1, 0): "0", (2, 1): "3", (1, 2): "3", (11.5, 11.5): "", (13.5, 13.5): "",
    (15, 15): "", (23, 23): "", (21, 21): "2", (25, 25): "2", (10.5, 10.5): "1", (180, 0): "", (0, 90): "", (-180, -90): "",
}


@pytest.mark.parametrize("plan", ["narrow", "joined"])
def test_golden_points(spark, plan):
    points = spark.createDataFrame([(i, str(y), str(x)) for i, (x, y) in enumerate(GOLDEN)], "id int, lat string, lon string")
    out = enrich(points, [layer(spark, selected=["k"])], plan=plan, key="id", threshold=1)
    got = {r["id"]: r["Box_Key"].replace("; ", "") for r in out.collect()}
    assert [got[i] for i in range(len(GOLDEN))] == list(GOLDEN.values())


@pytest.mark.parametrize("values,first,join,all_", [(("A", "B"), "A", "A; B", '["A","B"]'), (("", "B"), "", "B", '["B"]'), (("A", "A"), "A", "A; A", '["A","A"]')])
def test_modes(spark, values, first, join, all_):
    own = layer(spark, [(0, [[(0, 0, 2, 2)]], values[0]), (3, [[(1, 1, 3, 3)]], values[1])])
    points = spark.createDataFrame([("in", "1.5", "1.5"), ("out", "50", "50"), ("bad", "x", "1")], "id string, lat string, lon string")
    for mode, want, none in (("first", first, ""), ("join", join, ""), ("all", all_, "[]")):
        got = {r["id"]: r["Box"] for r in enrich(points, [own], mode=mode).collect()}
        assert got == {"in": want, "out": none, "bad": ""}


def test_stats_and_order(spark):
    points = spark.createDataFrame([(i, lat, "1.5") for i, lat in enumerate(("1.5", "50", "x", "", "91"))], "id int, lat string, lon string")
    for mode, want in (("join", (5, 2, 1, 2)), ("all", (5, 3, 0, 2))):
        assert tuple(match_stats(enrich(points, [layer(spark)], mode=mode, keep_hidden=True)).first()) == want
    df, seen = observed(enrich(points, [layer(spark)], keep_hidden=True))
    assert [r["id"] for r in df.collect()] == [0, 1, 2, 3, 4]
    assert seen.get == {"totalRows": 5, "matchedRows": 2, "unmatchedRows": 1, "badCoordRows": 2}


def brute(parts, x, y):
    def inside(r):
        ok = False
        for (xi, yi), (xj, yj) in zip(r, [r[-1], *r[:-1]]):
            if (yi > y) != (yj > y) and x < xj + (xi - xj) * (y - yj) / (yi - yj):
                ok = not ok
        return ok

    out = False
    for part in parts:
        if inside(part[0]):
            out = not out
            for hole in part[1:]:
                out ^= inside(hole)
    return out


@pytest.mark.parametrize("plan", ["narrow", "joined"])
def test_random_polygons(spark, plan):
    rnd = random.Random(5)
    def poly():
        cx, cy = rnd.uniform(-3, 3), rnd.uniform(-3, 3)
        pts = [(round(cx + rnd.uniform(-2, 2), 2), round(cy + rnd.uniform(-2, 2), 2)) for _ in range(rnd.randint(3, 7))]
        return [*pts, pts[0]]

    shapes = [[[poly() for _ in range(rnd.randint(1, 3))] for _ in range(rnd.randint(1, 2))] for _ in range(60)]
    rows = [(i, {"n": str(i)}, [[[{"lon": x, "lat": y} for x, y in r] for r in p] for p in s]) for i, s in enumerate(shapes)]
    own = Layer(spark.createDataFrame(rows, SCHEMA), "s", "S", [("n", "n")])
    pts = [(i, round(rnd.uniform(-5, 5), rnd.choice((0, 2))), round(rnd.uniform(-5, 5), rnd.choice((0, 2)))) for i in range(150)]
    out = enrich(spark.createDataFrame([(i, str(y), str(x)) for i, x, y in pts], "id int, lat string, lon string"), [own], plan=plan, key="id")
    got = {r["id"]: r["S"] for r in out.collect()}
    q = lambda v: int(v * 1e6 + (0.5 if v >= 0 else -0.5))
    scaled = [[[[(q(x), q(y)) for x, y in r] for r in p] for p in s] for s in shapes]
    for i, x, y in pts:
        assert got[i] == "; ".join(str(k) for k, s in enumerate(scaled) if brute(s, q(x), q(y)))


def test_layers_and_names(spark):
    own = layer(spark)
    assert own.toggle("k").outputs() == [("n", "Box"), ("k", "Box_Key")] and own.toggle("n").toggle("k").selected == ["k"]
    with pytest.raises(ValueError):
        Layer(own.features, "x", "东", [("n", "n")]).outputs()
    with pytest.raises(ValueError):
        enrich(spark.range(1), [own])
    s = Session()
    s.toggle(own), s.add(Layer.uploaded(own.features, "Up", ["n"], 7))
    assert [x.id for x in s.layers()] == ["box", "uploaded-7"]
    s.toggle(own), s.remove("uploaded-7")
    assert s.layers() == []


def test_narrow_plan_keeps_points_in_place(spark):
    points = spark.range(1000).select("id", (F.col("id") % 90).cast("string").alias("lat"), F.lit("1").alias("lon"))
    plan = enrich(points, [layer(spark)], plan="narrow")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("BroadcastHashJoin")[0] and "Python" not in plan


def test_stream(spark, tmp_path):
    from plumbline.streaming.enrich import enrich_stream

    spark.createDataFrame([("1.5", "1.5"), ("9", "9")], "lat string, lon string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("lat string, lon string").parquet(str(tmp_path / "in"))
    q = enrich_stream(stream, [layer(spark)]).writeStream.format("memory").queryName("enriched").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["Box"] for r in spark.table("enriched").collect()) == ["", "A; D"]


def test_salted_cells_and_given_grid(spark):
    """Lists of cells too large to broadcast are salted; a grid that is given is used instead of a built one."""
    from plumbline.operators.grid import cells
    from plumbline.plans import queries

    d = "/root/testdata/sf0.001"
    rows, layer = queries.points(spark, d), queries.diamonds(spark, d)
    plain = lambda df: sorted(map(tuple, df.select("c_custkey", "Zone").collect()))
    want = plain(enrich(rows, [layer], plan="narrow"))
    assert plain(enrich(rows, [layer], plan="joined", key="c_custkey", cell_edges=0)) == want
    layer.grid = cells(layer.indexed())
    assert plain(enrich(rows, [layer])) == want
    layer.grid = layer.grid.where("false")
    assert {z for _, z in plain(enrich(rows, [layer], plan="narrow"))} == {""}


def test_crowded_cells_are_tested_once_a_place(spark):
    """Rows do not carry the candidates of a crowded cell; results are those of the narrow plan, also for equal rows and bad ones."""
    own = layer(spark, [(i, [[(i % 7 / 10, i % 11 / 20, 1 + i % 3, 1)], *([[(0.2, 0.2, 0.4, 0.3)]] if i % 5 == 0 else [])], "" if i % 4 == 0 else f"v{i}") for i in range(150)], selected=["n", "k"])
    rows = [("x" if i % 20 == 0 else str(i % 6 / 10), str(i % 9 / 10)) for i in range(400)] + [("50", "50"), ("0.3", None)]
    points = spark.createDataFrame([*rows, *rows[:5]], "lat string, lon string")
    made = enrich(points, [own, layer(spark)], keep_hidden=True)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_c0") == enrich(points, [layer(spark)], plan="narrow")._jdf.queryExecution().executedPlan().toString().count("_c0")
    for mode in ("first", "join", "all"):
        got, want = (sorted(map(tuple, enrich(points, [own], mode=mode, plan=p, keep_hidden=True).collect())) for p in ("auto", "narrow"))
        assert got == want and len(got) == 407
    assert sorted(map(tuple, enrich(points, [own], cell_edges=0).collect())) == sorted(map(tuple, enrich(points, [own], plan="narrow").collect()))
