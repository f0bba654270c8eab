"""Candidates of points: a 1 degree grid, refined to 0.2 degrees where cells are dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD, SUBDIVISIONS = 20, 5


def _span(lo: Column, hi: Column, most: int) -> tuple[Column, Column]:
    return F.greatest(F.floor(lo), F.lit(0)), F.least(F.floor(hi), F.lit(most))


def _explode(df: DataFrame, name: str, lo: Column, hi: Column) -> DataFrame:
    return df.withColumn("_lo", lo.cast("int")).withColumn("_hi", hi.cast("int")).where("_lo <= _hi").withColumn(name, F.explode(F.expr("sequence(_lo, _hi)"))).drop("_lo", "_hi")


def base_cells(boxes: DataFrame) -> DataFrame:
    """(fi, bbox, ci, cj): every cell that a feature's raw box meets. boxes: fi, bbox."""
    b = boxes.where("bbox.min_lon is not null")
    b = _explode(b, "ci", *_span(F.col("bbox.min_lat") + 90.0, F.col("bbox.max_lat") + 90.0, 179))
    return _explode(b, "cj", *_span(F.col("bbox.min_lon") + 180.0, F.col("bbox.max_lon") + 180.0, 359))


def cells(boxes: DataFrame, threshold: int = THRESHOLD, subdivisions: int = SUBDIVISIONS) -> DataFrame:
    """(level, ci, cj, si, sj, fi). A cell of more than threshold candidates exists at level 1 only, in its parts."""
    base = base_cells(boxes.select("fi", "bbox"))
    dense = base.groupBy("ci", "cj").agg(F.count("*").alias("n")).where(F.col("n") > threshold).select("ci", "cj", F.lit(True).alias("_dense"))
    base = base.join(dense, ["ci", "cj"], "left")
    whole = base.where("_dense is null").select(F.lit(0).alias("level"), "ci", "cj", F.lit(0).alias("si"), F.lit(0).alias("sj"), "fi")
    size = F.lit(1.0 / subdivisions)
    lat, lon = F.col("ci") - 90.0, F.col("cj") - 180.0
    part = lambda lo, hi, o: _span((F.greatest(lo, o) - o) / size, (F.least(hi, o + 1.0) - o) / size, subdivisions - 1)
    fine = base.where("_dense")
    fine = _explode(fine, "si", *part(F.col("bbox.min_lat"), F.col("bbox.max_lat"), lat))
    fine = _explode(fine, "sj", *part(F.col("bbox.min_lon"), F.col("bbox.max_lon"), lon))
    return whole.unionByName(fine.select(F.lit(1).alias("level"), "ci", "cj", "si", "sj", "fi"))


def point_keys(lat: Column, lon: Column, subdivisions: int = SUBDIVISIONS) -> dict[str, Column]:
    """The cells of a point. Latitude 90 and longitude 180 are in no cell."""
    ci, cj = F.floor(lat + 90.0), F.floor(lon + 180.0)
    sub = lambda v, o: F.floor((v - o) / F.lit(1.0 / subdivisions)).cast("int")
    return {"ci": ci.cast("int"), "cj": cj.cast("int"), "si": sub(lat, ci - 90.0), "sj": sub(lon, cj - 180.0)}


def statistics(cell_rows: DataFrame) -> DataFrame:
    """non_empty and refined base cells, and postings."""
    return cell_rows.agg(
        F.countDistinct("ci", "cj").alias("non_empty"),
        F.countDistinct(F.when(F.col("level") == 1, F.struct("ci", "cj"))).alias("refined"), F.count("*").alias("postings"),
    )
