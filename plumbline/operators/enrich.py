"""The spatial join: every row is kept once, and gets the selected properties of the polygons that contain it.

Layers are small beside the rows. The default plan is narrow: a layer's candidates are gathered per grid cell, rows
look their cell up (a hash join on the cell, one entry per cell, so rows are never multiplied or shuffled), and the
exact test filters the cell's candidates in place. Gathering repeats a feature's geometry in each of its cells;
where that would pass ``cell_edges`` edges, or where a cell has more than ``CROWD`` candidates, which every row in it would
carry, the joined plan is used instead: rows are dealt by place, each place is tested once for all rows that are there (for up
to ``SALTS`` shares of them), candidates whose box holds it are joined with their features and tested, and rows take the output cells
of their place. Its cost grows with the places times the candidates of their cells, and with what comes out.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.coords import js_number, quantize, valid_coord
from ..functions.geometry import contains
from ..functions.text import detect_coordinates
from ..plans.layer import Layer
from .grid import THRESHOLD, point_keys


class Mode(str, Enum):
    FIRST, JOIN, ALL = "first", "join", "all"


def with_coordinates(rows: DataFrame, lat: str, lon: str, blank_as_zero: bool = True) -> DataFrame:
    """rows with _lat, _lon, _valid and the cell keys. Missing cells become empty texts."""
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c, t in rows.dtypes if t == "string"}
    kinds = dict(rows.dtypes)
    number = lambda c: js_number(F.col(c), blank_as_zero) if kinds[c] == "string" else F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    out = rows.withColumns(texts).withColumns({"_lat": number(lat), "_lon": number(lon)})
    ok = valid_coord(F.col("_lat"), F.col("_lon"))
    out = out.withColumns({"_valid": ok, "_plat": F.when(ok, F.col("_lat")), "_plon": F.when(ok, F.col("_lon"))})
    keys = point_keys(F.col("_plat"), F.col("_plon"))
    return out.withColumns({f"_{k}": c for k, c in keys.items()} | {"_x": quantize(F.col("_plon")).cast("double"), "_y": quantize(F.col("_plat")).cast("double")})


HIDDEN = ["_lat", "_lon", "_valid", "_plat", "_plon", "_ci", "_cj", "_si", "_sj", "_x", "_y"]


def outcome(hits: Column, i: int, mode: Mode, valid: Column) -> Column:
    """One output cell from the values arrays of the containing features, in their order."""
    values = F.filter(F.transform(hits, lambda h: F.get(h, F.lit(i))), lambda v: v != "")
    if mode is Mode.FIRST:  # the first containing feature decides, even if its value is empty
        out = F.coalesce(F.get(F.get(hits, F.lit(0)), F.lit(i)), F.lit(""))
    elif mode is Mode.JOIN:
        out = F.array_join(values, "; ")
    else:
        out = F.to_json(values)
    return F.when(valid, out).otherwise(F.lit(""))


def _narrow(points: DataFrame, indexed: DataFrame, cell_rows: DataFrame) -> DataFrame:
    held = cell_rows.join(indexed.select("fi", "parts", "values"), "fi")
    held = held.groupBy("level", "ci", "cj", "si", "sj").agg(F.array_sort(F.collect_list(F.struct("fi", "parts", "values"))).alias("_c"))
    base = held.where("level = 0").select(F.col("ci").alias("_ci"), F.col("cj").alias("_cj"), F.col("_c").alias("_c0"))
    fine = held.where("level = 1").select(*[F.col(k).alias(f"_{k}") for k in ("ci", "cj", "si", "sj")], F.col("_c").alias("_c1"))
    # bounded by cell_edges, checked before
    joined = points.join(F.broadcast(base), ["_ci", "_cj"], "left").join(F.broadcast(fine), ["_ci", "_cj", "_si", "_sj"], "left")
    near = F.coalesce("_c0", "_c1")
    inside = F.filter(near, lambda f: contains(f["parts"], F.col("_x"), F.col("_y")))
    none = F.array().cast("array<array<string>>")
    return joined.withColumn("_hits", F.coalesce(F.transform(inside, lambda f: f["values"]), none)).drop("_c0", "_c1")


CROWD, SALTS = 64, 16
CELL = ["_ci", "_cj", "_si", "_sj"]


def _reach(parts: Column) -> list[Column]:
    """The box of a feature's outer rings, outside which it holds no point."""
    outer = lambda k: F.transform(parts, lambda p: F.get(p, F.lit(0))["bbox"][k].cast("double"))
    return [f(outer(k)).alias(f"_{k}") for f, k in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))]


def _joined(points: DataFrame, indexed: DataFrame, cell_rows: DataFrame, columns, own: list[str], most: int) -> DataFrame:
    """points with columns(hits, valid). Rows of a place are dealt over salts by their own columns, so many of them are no one task's."""
    salt = F.xxhash64("_x", *[F.col(f"`{c}`") for c, t in points.dtypes if c in own and not any(k in t for k in ("map<", "variant"))])
    place = [*CELL, "_x", "_y", "_salt"]
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).repartition(tasks, *place)
    places = dealt.where("_valid").select(*place).distinct()
    # level 0 cells have no parts: -1, as no point's
    levels = F.array(F.struct(*CELL), F.struct("_ci", "_cj", F.lit(-1).alias("_si"), F.lit(-1).alias("_sj")))
    keyed = places.withColumn("_k", F.explode(levels)).select(*place, *[F.col(f"_k.{c}").alias(f"_k{c}") for c in CELL])
    part = lambda c: F.when(F.col("level") == 1, F.col(c)).otherwise(F.lit(-1))
    cells = cell_rows.select("fi", F.col("ci").alias("_k_ci"), F.col("cj").alias("_k_cj"), part("si").alias("_k_si"), part("sj").alias("_k_sj"))
    cells = cells.join(indexed.select("fi", *_reach(F.col("parts"))), "fi")
    on = [f"_k{c}" for c in CELL]
    if cell_rows.count() * 4 <= most:  # a number and a box take about four edges' bytes
        near = keyed.join(F.broadcast(cells), on)
    else:  # many places may lie in one cell
        near = keyed.join(cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"])
    near = near.where("_x between _x0 and _x1 and _y between _y0 and _y1").select(*place, "fi")
    features = indexed.select("fi", "parts", "values")
    size = indexed.agg(F.sum(_edges(F.col("parts")) + 8)).first()[0] or 0  # and a feature without its edges about eight
    hit = near.join(F.broadcast(features) if size <= most else features, "fi").where(contains(F.col("parts"), F.col("_x"), F.col("_y")))
    hits = hit.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("fi", "values"))).alias("_h"))
    found = columns(F.transform("_h", lambda h: h["values"]), F.lit(True))
    none = columns(F.array().cast("array<array<string>>"), F.col("_valid"))
    # by place as both are dealt already; a broadcast would hold all texts, which Spark does not foresee
    back = dealt.join(hits.select(*place, *[c.alias(k) for k, c in found.items()]).hint("merge"), place, "left")
    return back.withColumns({k: F.coalesce(F.col(k), c) for k, c in none.items()}).drop("_salt")


def _edges(parts: Column) -> Column:
    return F.aggregate(F.flatten(parts), F.lit(0).cast("long"), lambda a, r: a + F.size(r["edges"]))


def edges_in_cells(indexed: DataFrame, cell_rows: DataFrame) -> tuple[int, int]:
    """Edges of all cells' candidates, and the candidates of the fullest cell."""
    sized = indexed.select("fi", _edges(F.col("parts")).alias("n"))
    cell = cell_rows.join(sized, "fi").groupBy("level", "ci", "cj", "si", "sj").agg(F.sum("n").alias("n"), F.count("*").alias("own"))
    return tuple(x or 0 for x in cell.agg(F.sum("n"), F.max("own")).first())


def enrich(rows: DataFrame, layers: list[Layer], lat: str | None = None, lon: str | None = None, mode: Mode | str = Mode.JOIN, key: str | None = None, plan: str = "auto", cell_edges: int = 2_000_000, keep_hidden: bool = False, blank_as_zero: bool = True, threshold: int = THRESHOLD, strict_stats: bool = False) -> DataFrame:
    """rows with a column for each selected property of each layer, and _matched and _valid where keep_hidden is set. The
    result is lazy, but with plan "auto" each layer's size is counted at once, and what plan "joined" broadcasts; "narrow" counts
    nothing. strict_stats: in mode all an empty list is no match.

    Layers follow one another; a column that is there already is overwritten in its place. key is no longer needed, as rows
    find the result of their place again by that place."""
    mode = Mode(mode)
    found = detect_coordinates(rows.columns)
    lat, lon = lat or found[0], lon or found[1]
    if not lat or not lon or not layers:
        raise ValueError("enrich needs a latitude and a longitude column and at least one layer")
    points = with_coordinates(rows, lat, lon, blank_as_zero)
    matched = F.lit(False)
    names = [c for c in points.columns if c not in HIDDEN]
    for n, layer in enumerate(layers):
        indexed, cell_rows = layer.prepared(threshold)
        how = plan
        if plan == "auto":
            edges, crowd = edges_in_cells(indexed, cell_rows)
            how = "narrow" if edges <= cell_edges and crowd <= CROWD else "joined"
        columns = lambda hits, valid, n=n, size=len(layer.outputs()): {f"_o{n}_{i}": outcome(hits, i, mode, valid) for i in range(size)}
        if how == "narrow":
            points = _narrow(points, indexed, cell_rows)
            points = points.withColumns(columns(F.col("_hits"), F.col("_valid")))
        else:
            points = _joined(points, indexed, cell_rows, columns, rows.columns, cell_edges)
        own = [f"_o{n}_{i}" for i in range(len(layer.outputs()))]
        points = points.withColumn("_any", F.coalesce(F.col("_any") if n else F.lit(False), F.lit(False)) | _any(own, strict_stats and mode is Mode.ALL))
        points = points.withColumns({name: F.col(f"_o{n}_{i}") for i, (_, name) in enumerate(layer.outputs())}).drop(*own, "_hits")
        names += [name for _, name in layer.outputs() if name not in names]
        matched = F.col("_any")
    out = points.select(*names, *([matched.alias("_matched"), "_valid"] if keep_hidden else []))
    return out


def _any(columns: list[str], strict: bool) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(c).isin("", *(["[]"] if strict else []))
    return out


def counters() -> list[Column]:
    """Aggregates of rows enriched with keep_hidden."""
    bad, hit = F.count_if(~F.col("_valid")), F.count_if(F.col("_matched"))
    total = F.count(F.lit(1))
    return [total.alias("totalRows"), hit.alias("matchedRows"), (total - hit - bad).alias("unmatchedRows"), bad.alias("badCoordRows")]


def match_stats(enriched: DataFrame) -> DataFrame:
    """One row of counters. In mode all an empty list is a text like any other, so every valid row counts as matched, unless the
    rows were enriched with strict_stats."""
    return enriched.agg(*counters())


def observed(enriched: DataFrame, name: str = "match_stats") -> tuple[DataFrame, Observation]:
    """The rows, and their counters taken in the same pass."""
    seen = Observation(name)
    return enriched.observe(seen, *counters()), seen


def preview(df: DataFrame, order: str, n: int = 50) -> DataFrame:
    return df.orderBy(order).limit(n)
