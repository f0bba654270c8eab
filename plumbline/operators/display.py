"""What a map shows of a result: colours, extent, labels, popups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.coords import finite
from ..functions.text import auto_color, color_or, first_segment

LABELS, POPUP_ROWS = 60, 12


def color_key(selected: list[str], available: list[str], label_key: str | None = None) -> str:
    """The property that labels and colours: the configured one, else the first selected, else the first there is."""
    return label_key or next(iter(selected), None) or next(iter(available), "")


def matched_value(df: DataFrame, column: str) -> Column:
    return first_segment(F.col(column)) if column in df.columns else F.lit("")


def colored_points(df: DataFrame, lat: str, lon: str, column: str) -> DataFrame:
    """Rows with finite coordinates, in range or not, coloured by the first matched value."""
    shown = df.where(finite(F.col(lat), F.col(lon)))
    return shown.withColumn("color", color_or(matched_value(df, column)))


def colored_polygons(features: DataFrame, key: str, color: str) -> DataFrame:
    value = F.coalesce(F.element_at("props", key), F.lit(""))
    return features.withColumn("color", F.when(value != "", auto_color(value)).otherwise(F.lit(color)))


def extent(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.agg(F.min(lat).alias("min_lat"), F.min(lon).alias("min_lon"), F.max(lat).alias("max_lat"), F.max(lon).alias("max_lon"))


def in_view(boxes: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    b = F.col("bbox")
    return boxes.where((b["min_lon"] <= max_lon) & (b["max_lon"] >= min_lon) & (b["min_lat"] <= max_lat) & (b["max_lat"] >= min_lat))


def labels(boxes: DataFrame, view: tuple[float, float, float, float], n: int = LABELS) -> DataFrame:
    """The largest features in view, by the area of their boxes."""
    b = F.col("bbox")
    area = (b["max_lon"] - b["min_lon"]) * (b["max_lat"] - b["min_lat"])
    return in_view(boxes, *view).withColumn("box_area", area).orderBy(F.desc("box_area"), "fi").limit(n)


def popup(df: DataFrame, columns: list[str], joined: list[str], rows: int = POPUP_ROWS) -> DataFrame:
    """popup: the filled cells, joined columns first, at most rows of them; more: how many are left out."""
    order = [c for c in joined if c in columns] + [c for c in columns if c not in set(joined)]
    cells = F.array(*[F.struct(F.lit(c).alias("key"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in order])
    filled = F.filter(cells, lambda x: x["value"] != "")
    return df.withColumns({"popup": F.slice(filled, 1, rows), "more": F.greatest(F.size(filled) - rows, F.lit(0))})


def polygon_popup(features: DataFrame, properties: list[tuple[str, str]]) -> DataFrame:
    """Pairs of a feature: labelled properties in their order, then the others."""
    own = F.array(*[F.struct(F.lit(label).alias("key"), F.coalesce(F.element_at("props", k), F.lit("")).alias("value")) for k, label in properties])
    known = [k for k, _ in properties]
    rest = F.transform(F.filter(F.map_keys("props"), lambda k: ~k.isin(*known)), lambda k: F.struct(k.alias("key"), F.element_at("props", k).alias("value")))
    return features.withColumn("popup", F.filter(F.concat(own, rest), lambda x: x["value"] != ""))


def group_headings(catalog: DataFrame, position: str, group: str) -> DataFrame:
    """heading: whether an entry begins a section, its group being another than the entry's before it."""
    before = F.lag(group).over(Window.orderBy(position))
    return catalog.withColumn("heading", ~F.col(group).eqNullSafe(before))


def property_keys(features: DataFrame) -> DataFrame:
    """key, first_fi, first_pos: all keys in the order in which they are first seen."""
    keys = features.select("fi", F.posexplode(F.map_keys("props")).alias("pos", "key")).where("key <> ''")
    return keys.groupBy("key").agg(F.min(F.struct("fi", "pos")).alias("_m")).select("key", F.col("_m.fi").alias("first_fi"), F.col("_m.pos").alias("first_pos"))
