"""Simplified layers: shared borders, islands, collapsing rings, odd geometries."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators.topology import nodes, open_rings, simplify_layer

KIND = "fi int, name string, polygons array<array<array<struct<lon:double,lat:double>>>>"


def layer(spark, *features):
    rows = [(i, f"f{i}", None if f is None else [[[{"lon": float(x), "lat": float(y)} for x, y in ring] for ring in part] for part in f]) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, KIND)


def simplified(spark, features, metres):
    out = simplify_layer(features, metres)
    assert out.columns == features.columns
    return {r["fi"]: r["polygons"] and [[[(p["lon"], p["lat"]) for p in ring] for ring in part] for part in r["polygons"]] for r in out.collect()}


def undirected(rings):
    return {frozenset(s) for part in rings for ring in part for s in zip(ring, ring[1:])}


def wavy(x0, y0, x1, y1, n=30, seed=0):
    """Points of a line from one end to the other that strays by up to 0.02 degrees."""
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 1, n)
    line = np.column_stack([x0 + t * (x1 - x0), y0 + t * (y1 - y0)]) + rng.uniform(-0.02, 0.02, (n, 2)) * (np.arange(n) % (n - 1) > 0)[:, None]
    return [tuple(p) for p in line.round(6).tolist()]


def test_neighbours_keep_their_border(spark):
    border = wavy(1, 0, 1, 1, seed=3)
    left = [(0.0, 0.0), *border, (0.0, 1.0), (0.0, 0.0)]
    right = [border[-1], *reversed(border[:-1]), (2.0, 0.0), (2.0, 1.0), border[-1]]  # the other way around, from another point
    out = simplified(spark, layer(spark, [[left]], [[right]]), 1000.0)
    shared = undirected(out[0]) & undirected(out[1])
    assert 1 < len(shared) < len(border) - 1
    # the shared line is one that Douglas-Peucker makes of the border alone, in one of its directions
    from plumbline.functions.simplify import kept

    own = np.array(min(border, border[::-1]))
    line = [tuple(p) for p in own[kept(own, 1000.0)].tolist()]
    assert shared == {frozenset(s) for s in zip(line, line[1:])}


def test_islands_in_holes_share_them(spark):
    t = np.linspace(0, 2 * np.pi, 90)[:-1]
    hole = [(round(float(np.cos(a)), 6), round(float(np.sin(a)), 6)) for a in t]
    around = [[[(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5)], [*hole, hole[0]]]]
    turned = [*hole[40:], *hole[:41]][::-1]
    out = simplified(spark, layer(spark, around, [[turned]]), 3000.0)
    assert undirected([[out[0][0][1]]]) == undirected(out[1]) and 3 < len(out[1][0][0]) < 40


def test_rings_never_collapse(spark):
    thin = [(0.0, 0.0), (0.5, 0.00001), (1.0, 0.0), (0.5, -0.00001), (0.0, 0.0)]
    above = [(0.0, 0.0), (0.5, 0.00001), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    out = simplified(spark, layer(spark, [[thin]], [[above]]), 50_000.0)
    assert len(set(out[0][0][0])) >= 3 and out[0][0][0][0] == out[0][0][0][-1]
    assert (0.5, 0.00001) in out[0][0][0] and (0.5, 0.00001) in out[1][0][0]  # what one keeps, the other keeps
    tiny = simplified(spark, layer(spark, [[[(0, 0), (1e-5, 0), (1e-5, 1e-5), (0, 1e-5), (0, 0)]]]), 1e6)
    assert len(set(tiny[0][0][0])) == 3


def test_odd_geometries(spark):
    box = [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]
    eight = [[(0, 0), (1, 1), (2, 0), (2, 2), (1, 1), (0, 2), (0, 0)]]
    out = simplified(spark, layer(spark, None, [], [box, [[(7, 7), (8, 7), (8, 8), (7, 7)]]], [eight], [[[(3, 3), (3, 3)]]]), 10.0)
    assert out[0] is None and out[1] == [] and undirected(out[2][:1]) == undirected([box]) and len(out[2]) == 2
    assert undirected(out[3]) == undirected([eight]) and len(out[4]) == 1
    assert simplify_layer(layer(spark, None).limit(0)).count() == 0
    repeated = layer(spark, [[[(0, 0), (0, 0), (1, 0), (1, 1), (1, 1), (0, 1), (0, 0)]]])
    assert simplified(spark, repeated, 10.0)[0] == [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]]


def test_nodes_are_where_borders_meet(spark):
    boxes = [[[[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]]] for x in (0, 1) for y in (0, 1)]
    found = {(r["p"]["lon"], r["p"]["lat"]) for r in nodes(open_rings(layer(spark, *boxes))).collect()}
    assert found == {(1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 1.0), (1.0, 2.0)}


def test_no_python_per_row(spark):
    plan = simplify_layer(layer(spark, [[[(0, 0), (1, 0), (1, 1), (0, 0)]]]))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "MapInArrow" in plan and "BatchEvalPython" not in plan and "Cartesian" not in plan
