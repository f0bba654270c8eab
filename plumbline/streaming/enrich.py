"""Enrichment of a stream of rows against static layers.

Every row is looked up and tested by itself, so no state and no watermark is needed. The layers are gathered when
the query starts; a changed layer needs a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.enrich import Mode, enrich
from ..plans.layer import Layer


def enrich_stream(rows: DataFrame, layers: list[Layer], lat: str | None = None, lon: str | None = None, mode: Mode | str = Mode.JOIN, **settings) -> DataFrame:
    if not rows.isStreaming:
        raise ValueError("rows must be a stream; use enrich for tables")
    return enrich(rows, layers, lat, lon, mode, plan="narrow", **settings)
