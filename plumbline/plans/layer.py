"""Polygon layers and their configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import bbox, prepared
from ..functions.text import output_names
from ..operators.grid import SUBDIVISIONS, THRESHOLD, cells

#: Columns of a features table. fi is the order of features; the lowest containing one is first.
FEATURES = "fi int, props map<string,string>, polygons array<array<array<struct<lon:double,lat:double>>>>"
#: Map colours of the catalogue's layers.
LAYER_COLORS = {
    "country": "#e74c3c", "state": "#3498db", "county": "#2ecc71", "zcta": "#f39c12", "ba": "#9b59b6",
    "nerc": "#1abc9c", "province": "#e67e22", "retail": "#e84393", "control": "#34495e",
}


@dataclass
class Layer:
    """features: columns of FEATURES. properties: (key, label) in order, the first being the default. selected: keys to
    append; a key that the layer lacks takes the default's values. grid: the layer's cells, if they are known (a read grid
    file, or a table of them); else they are made from the features."""

    features: DataFrame
    id: str
    suggestion: str
    properties: list[tuple[str, str]]
    selected: list[str] = field(default_factory=list)
    label: str = ""
    color: str = ""
    grid: DataFrame | None = None
    _prepared: dict = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self):
        if not self.properties:
            raise ValueError(f"layer {self.id} has no properties")
        self.selected = self.selected or [self.properties[0][0]]
        self.label = self.label or self.id
        self.color = self.color or LAYER_COLORS.get(self.id, "")

    @classmethod
    def from_manifest(cls, entry: dict, features: DataFrame) -> Layer:
        """Defaults of a catalogue entry: the default property selected, the label's words joined as the base name."""
        props = [(p["key"], p["label"]) for p in entry["properties"]]
        base = entry.get("suggestion") or "_".join(entry["label"].split())
        return cls(features, entry["id"], base, props, [entry["defaultPropertyKey"]], entry["label"], entry.get("color") or "")

    @classmethod
    def uploaded(cls, features: DataFrame, name: str, keys: list[str], at_ms: int) -> Layer:
        if not keys:
            raise ValueError("an uploaded layer needs a property")
        return cls(features, f"uploaded-{at_ms}", name, [(k, k) for k in keys], [keys[0]], name)

    def toggle(self, key: str) -> Layer:
        """Selects or deselects a property; one always stays."""
        if key not in self.selected:
            self.selected = [*self.selected, key]
        elif len(self.selected) > 1:
            self.selected = [k for k in self.selected if k != key]
        return self

    def outputs(self) -> list[tuple[str, str]]:
        return output_names(self.suggestion, self.properties, self.selected)

    def keys(self) -> list[str]:
        return [k for k, _ in self.properties]

    def value(self, key: str):
        """A selected property of a feature as text; never null."""
        own = F.try_element_at("props", F.lit(key if key in self.data_keys() else self.properties[0][0]))
        return F.coalesce(own, F.lit(""))

    def data_keys(self) -> set[str]:
        return set(self._data_keys) if hasattr(self, "_data_keys") else set(self.keys())

    def having(self, keys: list[str]) -> Layer:
        """The keys that the data really have, where a catalogue may offer more."""
        self._data_keys = keys
        return self

    def indexed(self) -> DataFrame:
        """fi, bbox in raw degrees, parts ready for the exact test, and the selected values in order."""
        values = F.array(*[self.value(k) for k, _ in self.outputs()])
        return self.features.select("fi", bbox(F.col("polygons")).alias("bbox"), prepared(F.col("polygons")).alias("parts"), values.alias("values"))


    def prepared(self, threshold: int = THRESHOLD, subdivisions: int = SUBDIVISIONS) -> tuple[DataFrame, DataFrame]:
        """indexed() and the layer's cells, worked out once for all joins with this layer. A layer is small beside the rows; Spark keeps both
        in memory or on disk until release(), and works lost parts out again."""
        key = (threshold, subdivisions, tuple(self.selected), tuple(sorted(self.data_keys())))
        if key not in self._prepared:
            indexed = self.indexed().persist()
            self._prepared[key] = indexed, cells(indexed, threshold, subdivisions).persist()
        indexed, made = self._prepared[key]
        return indexed, made if self.grid is None else self.grid

    def release(self) -> None:
        """Lets go of what prepared() keeps; results that are not written yet work it out again."""
        for frames in self._prepared.values():
            for df in frames:
                df.unpersist()
        self._prepared.clear()


class Session:
    """The layers in use, built-in ones first and in the order they were switched on, then uploads."""

    def __init__(self):
        self.built_in: dict[str, Layer] = {}
        self.uploads: dict[str, Layer] = {}

    def toggle(self, layer: Layer) -> None:
        if self.built_in.pop(layer.id, None) is None:
            self.built_in[layer.id] = layer

    def add(self, layer: Layer) -> None:
        self.uploads[layer.id] = layer

    def remove(self, layer_id: str) -> None:
        self.uploads.pop(layer_id, None)

    def layers(self) -> list[Layer]:
        return [*self.built_in.values(), *self.uploads.values()]
