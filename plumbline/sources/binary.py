"""The compact binary layer and grid formats (their codec; the data sources are in layer_files), and WKB geometries.

Layout of a layer file (little endian): magic, version, counts of features, parts, rings and keys; keys; raw boxes;
values by key; offsets of parts, rings and features; rings as counted int32 pairs in millionths; ring boxes. A grid
file: header, a table of 180 x 360 offsets, then posting lists, refined cells holding a table of their own."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.geometry import POLYGONS, from_quantised

#: Fixed values of the formats.
LAYER_MAGIC, LAYER_VERSION, GRID_MAGIC, GRID_VERSIONS, EMPTY = 0x46424A47, 4, 0x44495247, (1, 2), 0xFFFFFFFF
LAYER_SCHEMA = "fi int, props map<string,string>, prop_keys array<string>, bbox struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>, parts array<array<struct<xs:array<int>,ys:array<int>>>>"
GRID_SCHEMA = "level int, ci int, cj int, si int, sj int, fi int"


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, kind: str, n: int = 1) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def u32(self) -> int:
        return int(self.take("<u4")[0])

    def text(self) -> str:
        n = self.u32()
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8")


def decode_layer(data: bytes) -> Iterator[tuple]:
    c = _Cursor(data)
    if (magic := c.u32()) != LAYER_MAGIC:
        raise ValueError(f"Bad magic: {magic:#x}")
    if (version := c.u32()) != LAYER_VERSION:
        raise ValueError(f"Bad version: {version} (expected {LAYER_VERSION})")
    n, n_parts, n_rings, n_keys = (c.u32() for _ in range(4))
    keys = [c.text() for _ in range(n_keys)]
    boxes = c.take("<f8", 4 * n).reshape(-1, 4).tolist()
    values = [[c.text() for _ in range(n)] for _ in keys]
    parts, ring_at, _ = c.take("<u4", n + 1).tolist(), c.take("<u4", n_parts + 1).tolist(), c.take("<u4", n_rings)
    coords = [c.take("<i4", 2 * c.u32()).reshape(-1, 2) for _ in range(n_rings)]
    for i in range(n):
        own = [[{"xs": coords[r][:, 0].tolist(), "ys": coords[r][:, 1].tolist()} for r in range(ring_at[p], ring_at[p + 1])] for p in range(parts[i], parts[i + 1])]
        yield i, {k: v[i] for k, v in zip(keys, values)}, keys, dict(zip(("min_lon", "min_lat", "max_lon", "max_lat"), boxes[i])), own


def encode_layer(features: list[tuple], keys: list[str]) -> bytes:
    """features: (props, bbox as four numbers, parts as rings as (xs, ys))."""
    text = lambda s: struct.pack("<I", len(b := s.encode())) + b
    parts = [len(f[2]) for f in features]
    ring_counts = [len(p) for f in features for p in f[2]]
    coords = [np.column_stack(r).astype("<i4") for f in features for p in f[2] for r in p]
    owner = [i for i, f in enumerate(features) for p in f[2] for _ in p]
    box = lambda a: [*a.min(0), *a.max(0)] if len(a) else [0, 0, 0, 0]
    return b"".join([
        struct.pack("<6I", LAYER_MAGIC, LAYER_VERSION, len(features), len(ring_counts), len(coords), len(keys)), *map(text, keys),
        np.array([f[1] for f in features], "<f8").tobytes(), *(text(f[0].get(k) or "") for k in keys for f in features),
        np.r_[0, np.cumsum(parts)].astype("<u4").tobytes(), np.r_[0, np.cumsum(ring_counts)].astype("<u4").tobytes(), np.array(owner, "<u4").tobytes(),
        *(struct.pack("<I", len(a)) + a.tobytes() for a in coords), np.array([box(a) for a in coords], "<i4").tobytes(),
    ])


def decode_grid(data: bytes) -> Iterator[tuple]:
    c = _Cursor(data)
    if (magic := c.u32()) != GRID_MAGIC:
        raise ValueError(f"Bad grid magic: {magic:#x}")
    if (version := c.u32()) not in GRID_VERSIONS:
        raise ValueError(f"Bad grid version: {version}")
    size, lat, lon = c.take("<f8", 3).tolist()
    if (size, lat, lon, c.u32(), c.u32()) != (1.0, -90.0, -180.0, 180, 360):
        raise ValueError("A grid of another size or origin")
    if version == 2:
        c.u32()
    table = c.take("<u4", 180 * 360)
    flat = np.frombuffer(data, "<u4", offset=c.at)
    for cell in np.flatnonzero(table != EMPTY).tolist():
        at, (ci, cj) = int(table[cell]), divmod(cell, 360)
        if flat[at]:
            for fi in flat[at + 1 : at + 1 + int(flat[at])].tolist():
                yield 0, ci, cj, 0, 0, fi
            continue
        sub, n = int(flat[at + 1]), int(flat[at + 2])
        lists = at + 3 + n
        for k, off in enumerate(flat[at + 3 : lists].tolist()):
            if off != EMPTY:
                own = lists + off
                for fi in flat[own + 1 : own + 1 + int(flat[own])].tolist():
                    yield 1, ci, cj, *divmod(k, sub), fi


def cell_words(level: int, lists: dict[int, list[int]], subdivisions: int) -> list[int]:
    """A cell's words: a counted list, or (refined) a table of offsets to counted lists. lists: by part of the cell, 0 if whole."""
    if level == 0:
        return [len(lists[0]), *lists[0]]
    n, sub, at = subdivisions**2, [EMPTY] * subdivisions**2, 0
    for k, own in sorted(lists.items()):
        sub[k] = at
        at += 1 + len(own)
    return [0, subdivisions, n, *sub, *(x for _, own in sorted(lists.items()) for x in (len(own), *own))]


def encode_grid(rows: list[tuple], subdivisions: int = 5) -> bytes:
    """rows: (level, ci, cj, si, sj, fi)."""
    table, flat, by = np.full(180 * 360, EMPTY, "<u4"), [], {}
    for level, ci, cj, si, sj, fi in sorted(rows):
        by.setdefault((ci, cj), (level, {}))[1].setdefault(si * subdivisions + sj, []).append(fi)
    for (ci, cj), (level, lists) in sorted(by.items()):
        table[ci * 360 + cj] = len(flat)
        flat += cell_words(level, lists, subdivisions)
    return struct.pack("<IIdddIII", GRID_MAGIC, 2, 1.0, -90.0, -180.0, 180, 360, len(by)) + table.tobytes() + np.array(flat, "<u4").tobytes()


def read_gjbf(spark: SparkSession, path: str) -> DataFrame:
    """fi, props, prop_keys, bbox and quantised parts of layer files in any store."""
    return _decoded(spark, path, decode_layer, LAYER_SCHEMA)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark, path, decode_grid, GRID_SCHEMA)


def _decoded(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    names = spark.createDataFrame([], schema).columns

    def run(batches):
        for b in batches:
            for data in b["content"]:
                yield pd.DataFrame(list(decode(bytes(data))), columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def dequantised(layer: DataFrame) -> DataFrame:
    """A read layer as features in degrees."""
    point = lambda x, y: F.struct((x / F.lit(1e6)).alias("lon"), (y / F.lit(1e6)).alias("lat"))
    polygons = F.transform("parts", lambda part: F.transform(part, lambda r: F.zip_with(r["xs"], r["ys"], point)))
    return layer.select("fi", "props", polygons.cast(POLYGONS).alias("polygons"))


def geometry_texts(layer: DataFrame) -> DataFrame:
    """fi, props and the GeoJSON geometry of a read layer: a polygon if it has one part, else a multipolygon."""
    return layer.select("fi", "props", from_quantised(F.col("parts")).alias("geometry"))


def decode_wkb(data: bytes) -> list | None:
    """Polygon or multipolygon, with or without Z, M and SRID, as parts of rings of (lon, lat); None for others."""
    parts = _wkb_parts(data)
    return None if parts is None else [[ring.tolist() for ring in part] for part in parts]


def _wkb_parts(data: bytes) -> list[list[np.ndarray]] | None:
    def one(at: int) -> tuple[list | None, int]:
        order = "<" if data[at] == 1 else ">"
        kind = struct.unpack_from(f"{order}I", data, at + 1)[0]
        at += 5 + (4 if kind & 0x20000000 else 0)
        base, flags = (kind & 0x1FFFFFFF) % 1000, (kind & 0x1FFFFFFF) // 1000
        dims = 2 + bool(kind & 0x80000000 or flags in (1, 3)) + bool(kind & 0x40000000 or flags in (2, 3))
        count = struct.unpack_from(f"{order}I", data, at)[0]
        at += 4
        if base == 3:
            rings_ = []
            for _ in range(count):
                n = struct.unpack_from(f"{order}I", data, at)[0]
                rings_.append(np.frombuffer(data, f"{order}f8", n * dims, at + 4).reshape(-1, dims)[:, :2].astype(float))
                at += 4 + 8 * n * dims
            return [rings_], at
        if base == 6:
            parts = []
            for _ in range(count):
                own, at = one(at)
                parts += own or []
            return parts, at
        return None, at

    return one(0)[0]


def wkb_polygons(df: DataFrame, column: str, out: str = "polygons") -> DataFrame:
    """A WKB column decoded into polygons, a batch at a time; other geometries become null."""
    rest = [c for c in df.columns if c != out]
    packed = df.select(F.struct(*rest).alias("_row"), F.col(column).alias("_wkb"))
    kind = pa.list_(pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _decoded_wkb(b.column(1)).cast(kind)], ["_row", out])

    made = packed.mapInArrow(run, f"_row {packed.schema['_row'].dataType.simpleString()}, {out} {POLYGONS}")
    return made.select(*[F.col("_row").getField(c).alias(c) for c in rest], out)


def _decoded_wkb(column) -> pa.Array:
    """Polygons of a batch of geometries, built from whole arrays of coordinates."""
    xy, ring_at, part_at, row_at, none = [], [0], [0], [0], []
    for b in column.to_pylist():
        parts = _wkb_parts(b) if b is not None else None
        none.append(parts is None)
        for part in parts or ():
            for ring in part:
                xy.append(ring)
                ring_at.append(ring_at[-1] + len(ring))
            part_at.append(len(ring_at) - 1)
        row_at.append(len(part_at) - 1)
    flat = np.concatenate(xy) if xy else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, 0])), pa.array(np.ascontiguousarray(flat[:, 1]))], ["lon", "lat"])
    rings_ = pa.ListArray.from_arrays(pa.array(ring_at, pa.int32()), points)
    parts_ = pa.ListArray.from_arrays(pa.array(part_at, pa.int32()), rings_)
    return pa.ListArray.from_arrays(pa.array(row_at, pa.int32()), parts_, mask=pa.array(none, pa.bool_()))


def wkb_kind(c: Column) -> Column:
    """The kind of a WKB geometry without dimensions and flags: 3 a polygon, 6 a multipolygon."""
    h = F.hex(F.substring(c, 1, 5))
    little = F.concat(F.substring(h, 9, 2), F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2))
    kind = F.conv(F.when(F.substring(h, 1, 2) == "01", little).otherwise(F.substring(h, 3, 8)), 16, 10).cast("long")
    return kind.bitwiseAND(0x1FFFFFFF) % 1000


def read_wkb_parquet(spark: SparkSession, path: str, geometry: str, props: list[str]) -> DataFrame:
    """fi, props, polygons of a Parquet table with WKB geometries, in order of file and row; only the columns named are
    read, and only the places of rows are brought together to number them."""
    table = spark.read.parquet(path).select(*props, geometry, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    table = table.where(wkb_kind(F.col(geometry)).isin(3, 6))
    ids = table.select(F.col("_file").alias("_f"), F.col("_at").alias("_a"), (F.row_number().over(Window.orderBy("_file", "_at")) - 1).cast("int").alias("fi"))
    rows = wkb_polygons(table.join(ids, (F.col("_file") == F.col("_f")) & (F.col("_at") == F.col("_a"))), geometry)
    texts = F.map_from_arrays(F.array(*map(F.lit, props)), F.array(*[F.trim(F.coalesce(F.col(p).cast("string"), F.lit(""))) for p in props]))
    return rows.select("fi", texts.alias("props"), "polygons")
