"""Scalar functions at their edges."""

import math

from pyspark.sql import functions as F

from plumbline.functions import coords, text
from plumbline.operators import display, etl


def test_numbers(spark):
    cases = {"45.5": 45.5, " 45.5 ": 45.5, "": 0.0, "  ": 0.0, "0x10": 16.0, "0b11": 3.0, "0o17": 15.0, ".5": 0.5, "5.": 5.0, "1e1": 10.0, "abc": None, "1.0d": None, "inf": None, "1_000": None, "-0x10": None, "Infinity": math.inf}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", coords.js_number(F.col("s")).alias("v")).collect()
    for r in rows:
        assert (math.isnan(r["v"]) if cases[r["s"]] is None else r["v"] == cases[r["s"]]), r
    assert math.isnan(spark.range(1).select(coords.js_number(F.lit(None).cast("string"))).first()[0])


def test_quantize(spark):
    got = [r[0] for r in spark.createDataFrame([(-2.5e-6,), (2.5e-6,), (-180.0,), (1.0000005,)], "d double").select(coords.quantize(F.col("d"))).collect()]
    assert got == [-2, 3, -180000000, 1000001]


def test_colors_and_texts(spark):
    rows = spark.createDataFrame([("SEATTLE CITY LIGHT",), ("",), ("Doña Ana",), ("a😀",)], "s string")
    assert [text.PALETTE.index(r[0]) for r in rows.select(text.auto_color(F.col("s"))).collect()] == [6, 7, 6, 13]
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v"))).first()[0]
    assert one(text.first_segment, "A; B") == "A" and one(text.clean_space, " a  b\n") == "a b" and one(text.base_name, "x.y.json") == "x.y"
    assert one(text.slug, " Área 51!") == "rea_51" and text.slug_name(" Área 51!") == "rea_51"
    assert text.detect_coordinates(["id", "Latitude", "LNG", "x"]) == ("Latitude", "LNG")
    assert text.output_names("Control_Area", [("NAME", "Name"), ("ID", "EIA ID")], ["ID", "NAME"]) == [("NAME", "Control_Area"), ("ID", "Control_Area_EIA_ID")]


def test_sentinels(spark):
    rows = spark.createDataFrame([("NOT AVAILABLE", -999999.0), ("n/a", None), (" NULL", 308485.0), ("x", 1.5)], "t string, n double")
    assert [tuple(r) for r in etl.clean_columns(rows, ["t"], ["n"]).collect()] == [("", ""), ("", ""), ("", "308485"), ("x", "1.5")]


def test_popups(spark):
    df = spark.createDataFrame([("1", "", "z")], "a string, b string, zone string")
    r = display.popup(df, ["a", "b", "zone"], ["zone"], rows=1).first()
    assert [tuple(x) for x in r["popup"]] == [("zone", "z")] and r["more"] == 1
    f = spark.createDataFrame([(0, {"k": "v", "n": "", "x": "y"})], "fi int, props map<string,string>")
    assert [tuple(x) for x in display.polygon_popup(f, [("n", "Name"), ("k", "Key")]).first()["popup"]] == [("Key", "v"), ("x", "y")]
    assert display.color_key([], ["a"]) == "a" and display.color_key(["b"], ["a"], "c") == "c"


def test_simplify_ring():
    import numpy as np

    from plumbline.functions.simplify import kept, simplify_ring

    t = np.linspace(0, 2 * np.pi, 200)
    ring = np.column_stack([np.cos(t), np.sin(t)])
    ring[-1] = ring[0]
    out = simplify_ring(ring, 2000.0)
    assert 4 <= len(out) < 60 and (out[0] == out[-1]).all()
    assert len(simplify_ring(ring, 1e9)) == 4
    line = np.array([[0.0, 0], [1, 0.25001], [2, 0.5], [3, 0.24999], [4, 0]])
    assert kept(line, 200.0).tolist() == [True, False, True, False, True] and kept(line[:3], 200.0).sum() == 2
    assert kept(line, 1e9, 1).tolist() == [True, False, True, False, True] and kept(line[:2], 1.0, 3).all()


def test_control(spark):
    from plumbline.operators.control import cancellable, progress

    with cancellable(spark) as cancel:
        assert spark.range(10).count() == 10
        assert cancel() == []
    seen = []
    assert progress(spark, seen.append) in range(101) and seen
