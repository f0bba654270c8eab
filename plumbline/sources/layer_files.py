"""Layer and grid files as Spark data sources: read in ranges, with filters pushed down, and written by tasks.

Reading: ``partitions`` walks over a file's lengths once, holding none of it, and notes where every ``features_per_task``-th feature
begins in each section; tasks read only their ranges. Bounds on fi and on the box (cells: ci, cj) are options: ranges without a
feature within them are not opened, and other features are not decoded. They are no pushed-down filters, as Spark 4.1 keeps what a
Python source was pushed and applies it to later queries of the same DataFrame as well (a count of all rows
after one of a filter gave the filter's).

Writing: tasks encode the sections of their features into files of their own, which are joined (see joined), counts being added up
to the offsets on the way. The driver holds a task's few numbers (of a grid, its cells: 64,800 at most), no feature.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geometry import bbox, rings
from ..functions.text import clean_space
from .binary import EMPTY, GRID_MAGIC, GRID_SCHEMA, GRID_VERSIONS, LAYER_MAGIC, LAYER_SCHEMA, LAYER_VERSION, cell_words
from .joined import BLOCK, JoiningWriter, Written, open_store

class Stream:
    """A file read onwards through one buffer; long skips are seeks."""

    def __init__(self, file, at: int = 0):
        self.file, self.at, self.data, self.start, self.fetched = file, at, b"", at, 0

    def take(self, n: int) -> bytes:
        off = self.at - self.start
        if off + n > len(self.data):
            rest = self.data[off:] if 0 <= off <= len(self.data) else b""
            self.file.seek(self.at + len(rest))
            more = self.file.read(max(n - len(rest), BLOCK))
            self.fetched += len(more)
            self.data, self.start, off = rest + more, self.at, 0
        if off + n > len(self.data):
            raise ValueError("the file ends too early")
        self.at += n
        return self.data[off : off + n]

    def skip(self, n: int) -> None:
        self.at += n

    def u32(self) -> int:
        return struct.unpack("<I", self.take(4))[0]

    def text(self) -> str:
        return self.take(self.u32()).decode("utf-8")


def _within(options, name: str, values: np.ndarray) -> np.ndarray:
    """Which values lie between the options name_from and name_to, ends included, where these are given."""
    out = np.ones(len(values), bool)
    if options.get(f"{name}_from") is not None:
        out &= values >= int(options[f"{name}_from"])
    if options.get(f"{name}_to") is not None:
        out &= values <= int(options[f"{name}_to"])
    return out


def _meets(options, boxes: np.ndarray) -> np.ndarray:
    """Which boxes meet the one of the option box (four numbers, comma-joined)."""
    if options.get("box") is None:
        return np.ones(len(boxes), bool)
    lon0, lat0, lon1, lat1 = map(float, options["box"].split(","))
    return (boxes[:, 0] <= lon1) & (boxes[:, 2] >= lon0) & (boxes[:, 1] <= lat1) & (boxes[:, 3] >= lat0)


def _files(uri: str) -> list[str]:
    from pyarrow import fs

    store, path = open_store(uri)
    if store.get_file_info(path).type == fs.FileType.File:
        return [uri]
    names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.base_name[0] not in "._")
    return [f"{uri.rstrip('/')}/{x}" for x in names]


@dataclass
class LayerRange(InputPartition):
    """Features lo to hi of a file, and where their sections begin."""

    uri: str
    keys: list[str]
    lo: int
    hi: int
    boxes: int
    values: list[int]
    parts: int
    ring_offsets: int
    part_lo: int
    part_hi: int
    ring_lo: int
    ring_hi: int
    coords: int
    wanted: list[int]


class LayerReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.step = options["path"], int(options.get("features_per_task", 2048))
        self.options = dict(options)

    def partitions(self):
        return [p for uri in _files(self.uri) for p in self._ranges(uri)]

    def _ranges(self, uri: str):
        store, path = open_store(uri)
        with store.open_input_file(path) as f:
            s = Stream(f)
            if (magic := s.u32()) != LAYER_MAGIC:
                raise ValueError(f"Bad magic: {magic:#x}")
            if (version := s.u32()) != LAYER_VERSION:
                raise ValueError(f"Bad version: {version} (expected {LAYER_VERSION})")
            n, n_parts, n_rings, n_keys = (s.u32() for _ in range(4))
            keys = [s.text() for _ in range(n_keys)]
            boxes, starts = s.at, list(range(0, n, self.step))
            wanted = []
            for lo in starts:
                m = min(self.step, n - lo)
                own = np.frombuffer(s.take(32 * m), "<f8").reshape(-1, 4)
                wanted.append(np.flatnonzero(_within(self.options, "fi", np.arange(lo, lo + m)) & _meets(self.options, own)).tolist())
            values = []
            for _ in keys:
                marks = []
                for i in range(n):
                    if i % self.step == 0:
                        marks.append(s.at)
                    s.skip(s.u32())
                values.append(marks)
            parts, ring_offsets = s.at, s.at + 4 * (n + 1)
            s.skip(4 * (n + 1) + 4 * (n_parts + 1) + 4 * n_rings)
            coords_at = s.at
            at = lambda base, i: struct.unpack("<I", Stream(f, base + 4 * i).take(4))[0]
            edges = [at(parts, i) for i in [*starts, n]] if n else []
            rings_ = [at(ring_offsets, p) for p in edges]
            ring, out, s = 0, [], Stream(f, coords_at)
            for j, lo in enumerate(starts):
                while ring < rings_[j]:
                    s.skip(8 * s.u32())
                    ring += 1
                if wanted[j]:
                    out.append(LayerRange(
                        uri=uri, keys=keys, lo=lo, hi=min(n, lo + self.step), boxes=boxes + 32 * lo, values=[v[j] for v in values], parts=parts + 4 * lo, ring_offsets=ring_offsets,
                        part_lo=edges[j], part_hi=edges[j + 1], ring_lo=rings_[j], ring_hi=rings_[j + 1], coords=s.at, wanted=wanted[j],
                    ))
            return out

    def read(self, p: LayerRange | None):
        if p is None:  # no range at all
            return
        store, path = open_store(p.uri)
        with store.open_input_file(path) as f:
            numbers = lambda kind, at, n: np.frombuffer(f.read_at(n * np.dtype(kind).itemsize, at), kind)
            boxes = numbers("<f8", p.boxes, 4 * (p.hi - p.lo)).reshape(-1, 4).tolist()
            first_part = numbers("<u4", p.parts, p.hi - p.lo + 1).tolist()
            first_ring = numbers("<u4", p.ring_offsets + 4 * p.part_lo, p.part_hi - p.part_lo + 1).tolist()
            streams, s, ring = [Stream(f, at) for at in p.values], Stream(f, p.coords), p.ring_lo
            wanted = set(p.wanted)
            for i in range(p.hi - p.lo):
                props = {k: v.text() for k, v in zip(p.keys, streams)} if i in wanted else [v.skip(v.u32()) for v in streams]
                own = []
                for part in range(first_part[i], first_part[i + 1]):
                    lists = []
                    for _ in range(first_ring[part - p.part_lo], first_ring[part - p.part_lo + 1]):
                        n = s.u32()
                        if i in wanted:
                            xy = np.frombuffer(s.take(8 * n), "<i4").reshape(-1, 2)
                            lists.append((xy[:, 0].tolist(), xy[:, 1].tolist()))
                        else:
                            s.skip(8 * n)
                        ring += 1
                    own.append(lists)
                if i in wanted:
                    yield p.lo + i, props, p.keys, tuple(boxes[i]), own


class LayerWriter(JoiningWriter):
    """Rows of fi, props, bbox, parts, in order of fi over the tasks, numbered from 0 without gaps. A null box is that of no points."""

    def __init__(self, options, overwrite: bool):
        super().__init__(options, overwrite)
        self.keys = json.loads(options.get("keys", "[]"))

    def write(self, rows):
        stem, first, n, n_parts, n_rings, files = self._stem(), -1, 0, 0, 0, {}
        sections = ["box", *(f"v{k}" for k in range(len(self.keys))), "parts", "rings", "owner", "xy", "rbox"]
        held = {x: bytearray() for x in sections}

        def flush(least: int) -> None:
            for name, data in held.items():
                if len(data) > least:
                    if name not in files:
                        files[name] = self._open(stem, name)
                    files[name].write(bytes(data))
                    data.clear()

        try:
            for row in rows:
                fi, props, box, parts = row["fi"], row["props"] or {}, row["bbox"], row["parts"] or []
                first = fi if first < 0 else first
                if fi != first + n:
                    raise ValueError(f"features of a layer file are numbered without gaps: {fi} follows {first + n - 1}")
                held["box"] += struct.pack("<4d", *(box if box is not None and box[0] is not None else (float("inf"), float("inf"), float("-inf"), float("-inf"))))
                for k, key in enumerate(self.keys):
                    text = (props.get(key) or "").encode()
                    held[f"v{k}"] += struct.pack("<I", len(text)) + text
                held["parts"] += struct.pack("<I", len(parts))
                for part in parts:
                    held["rings"] += struct.pack("<I", len(part))
                    for xs, ys in part:
                        xy = np.column_stack([xs, ys]).astype("<i4") if len(xs) else np.zeros((0, 2), "<i4")
                        held["owner"] += struct.pack("<I", fi)
                        held["xy"] += struct.pack("<I", len(xy)) + xy.tobytes()
                        held["rbox"] += struct.pack("<4i", *(map(int, [*xy.min(0), *xy.max(0)] if len(xy) else [0] * 4)))
                    n_rings += len(part)
                n_parts += len(parts)
                n += 1
                flush(BLOCK)
            if n:
                flush(-1)
        finally:
            for f in files.values():
                if f is not None:
                    f.close()
        return Written(stem, first, n, n_parts, n_rings)

    def join(self, out, own: list[Written]) -> None:
        n = sum(m.n for m in own)
        if own and [m.first for m in own] != np.cumsum([0, *(m.n for m in own[:-1])]).tolist():
            raise ValueError("features of a layer file are numbered from 0 without gaps")
        text = lambda s: struct.pack("<I", len(b := s.encode())) + b
        out.write(struct.pack("<6I", LAYER_MAGIC, LAYER_VERSION, n, sum(m.parts for m in own), sum(m.rings for m in own), len(self.keys)) + b"".join(map(text, self.keys)))
        for section in ("box", *(f"v{k}" for k in range(len(self.keys)))):
            for m in own:
                self._copy(out, m.stem, section)
        for section in ("parts", "rings"):
            before = 0

            def summed(data: bytes) -> bytes:
                nonlocal before
                ends = before + np.cumsum(np.frombuffer(data, "<u4").astype(np.int64))
                before = int(ends[-1])
                return ends.astype("<u4").tobytes()

            out.write(struct.pack("<I", 0))
            for m in own:
                self._copy(out, m.stem, section, summed)
        for section in ("owner", "xy", "rbox"):
            for m in own:
                self._copy(out, m.stem, section)


class GridWriter(JoiningWriter):
    """Rows of level, ci, cj, si, sj, fi, all of a cell in one task, in order of cell, part of cell and fi."""

    def __init__(self, options, overwrite: bool):
        super().__init__(options, overwrite)
        self.subdivisions = int(options.get("subdivisions", 5))

    def write(self, rows):
        stem, cells, at, file = self._stem(), [], 0, None
        now, level, lists = None, 0, {}

        def close() -> None:
            nonlocal at
            words = np.array(cell_words(level, lists, self.subdivisions), "<u4")
            cells.append((now, at))
            at += len(words)
            file.write(words.tobytes())

        try:
            for row in rows:
                cell = row["ci"] * 360 + row["cj"]
                if cell != now:
                    if now is None:
                        file = self._open(stem, "flat")
                    else:
                        close()
                        if cell < now:
                            raise ValueError("cells of a grid file come in order")
                    now, level, lists = cell, row["level"], {}
                lists.setdefault(row["si"] * self.subdivisions + row["sj"], []).append(row["fi"])
            if now is not None:
                close()
        finally:
            if file is not None:
                file.close()
        return Written(stem, cells[0][0] if cells else -1, at, cells=cells)

    def join(self, out, own: list[Written]) -> None:
        table, base = np.full(180 * 360, EMPTY, "<u4"), 0
        for m in own:
            for cell, at in m.cells:
                if table[cell] != EMPTY:
                    raise ValueError("a cell of a grid file is in two tasks")
                table[cell] = base + at
            base += m.n
        out.write(struct.pack("<IIdddIII", GRID_MAGIC, 2, 1.0, -90.0, -180.0, 180, 360, int((table != EMPTY).sum())) + table.tobytes())
        for m in own:
            self._copy(out, m.stem, "flat")


@dataclass
class CellRange(InputPartition):
    """Cells of a grid file, with where their words begin and where the range ends."""

    uri: str
    cells: list
    end: int


class GridReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.step = options["path"], int(options.get("cells_per_task", 4096))
        self.options = dict(options)

    def partitions(self):
        return [p for uri in _files(self.uri) for p in self._ranges(uri)]

    def _ranges(self, uri: str):
        store, path = open_store(uri)
        with store.open_input_file(path) as f:
            s = Stream(f)
            if (magic := s.u32()) != GRID_MAGIC:
                raise ValueError(f"Bad grid magic: {magic:#x}")
            if (version := s.u32()) not in GRID_VERSIONS:
                raise ValueError(f"Bad grid version: {version}")
            if (*struct.unpack("<3d", s.take(24)), s.u32(), s.u32()) != (1.0, -90.0, -180.0, 180, 360):
                raise ValueError("A grid of another size or origin")
            if version == 2:
                s.u32()
            table = np.frombuffer(s.take(4 * 180 * 360), "<u4")
            base, size = s.at, f.size()
        cells = np.flatnonzero(table != EMPTY)
        cells = cells[np.argsort(table[cells], kind="stable")]
        starts = base + 4 * table[cells].astype(np.int64)
        ends = np.append(starts[1:], size)
        good = np.flatnonzero(_within(self.options, "ci", cells // 360) & _within(self.options, "cj", cells % 360))
        groups = [good[at : at + self.step] for at in range(0, len(good), self.step)]
        return [CellRange(uri, [(int(cells[i]), int(starts[i])) for i in own], int(ends[own[-1]])) for own in groups]

    def read(self, p: CellRange | None):
        if p is None:
            return
        store, path = open_store(p.uri)
        with store.open_input_file(path) as f:
            s = Stream(f)
            for cell, at in p.cells:
                s.at, (ci, cj) = at, divmod(cell, 360)
                if n := s.u32():
                    for fi in np.frombuffer(s.take(4 * n), "<u4").tolist():
                        yield 0, ci, cj, 0, 0, fi
                    continue
                sub, n = s.u32(), s.u32()
                table = np.frombuffer(s.take(4 * n), "<u4").tolist()
                lists = s.at
                for k, off in enumerate(table):
                    if off != EMPTY:
                        s.at = lists + 4 * off
                        for fi in np.frombuffer(s.take(4 * s.u32()), "<u4").tolist():
                            yield 1, ci, cj, *divmod(k, sub), fi


class LayerSource(DataSource):
    """Options: path; reading: features_per_task, fi_from, fi_to, box; writing: keys (a JSON list)."""

    @classmethod
    def name(cls):
        return "gjbf"

    def schema(self):
        return LAYER_SCHEMA

    def reader(self, schema):
        return LayerReader(self.options)

    def writer(self, schema, overwrite):
        return LayerWriter(self.options, overwrite)


class GridSource(DataSource):
    """Options: path; reading: cells_per_task, ci_from, ci_to, cj_from, cj_to; writing: subdivisions."""

    @classmethod
    def name(cls):
        return "ggrid"

    def schema(self):
        return GRID_SCHEMA

    def reader(self, schema):
        return GridReader(self.options)

    def writer(self, schema, overwrite):
        return GridWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session."""
    spark.dataSource.register(LayerSource)
    spark.dataSource.register(GridSource)


def read_layer(spark: SparkSession, path: str, fi: tuple[int, int] | None = None, box: tuple[float, float, float, float] | None = None, features_per_task: int = 2048) -> DataFrame:
    """A layer file, or all of a folder's, in ranges; of a span of numbers, and of features whose box meets box alone, if given."""
    register(spark)
    reader = spark.read.format("gjbf").option("features_per_task", features_per_task)
    reader = reader.options(fi_from=fi[0], fi_to=fi[1]) if fi else reader
    return (reader.option("box", ",".join(map(repr, map(float, box)))) if box else reader).load(path)


def read_cells(spark: SparkSession, path: str, ci: tuple[int, int] | None = None, cj: tuple[int, int] | None = None, cells_per_task: int = 4096) -> DataFrame:
    """A grid file, or all of a folder's, in ranges of cells; those of some rows and columns of the grid alone, if given."""
    register(spark)
    reader = spark.read.format("ggrid").option("cells_per_task", cells_per_task)
    reader = reader.options(ci_from=ci[0], ci_to=ci[1]) if ci else reader
    return (reader.options(cj_from=cj[0], cj_to=cj[1]) if cj else reader).load(path)


def write_layer(features: DataFrame, path: str, keys: list[str], normalize: bool = False) -> str:
    """Writes features (fi, props, polygons; fi from 0 without gaps) as one layer file, in order of fi. normalize: white space of the
    values is cleaned, as in built-in layers; uploads stay as they are."""
    register(features.sparkSession)
    if normalize:
        features = features.withColumn("props", F.transform_values("props", lambda _, v: clean_space(v)))
    parts = F.transform(rings(F.col("polygons")), lambda part: F.transform(part, lambda r: F.struct(r["xs"].alias("xs"), r["ys"].alias("ys"))))
    rows = features.select("fi", "props", bbox(F.col("polygons")).alias("bbox"), parts.alias("parts")).orderBy("fi")
    rows.write.format("gjbf").mode("overwrite").option("keys", json.dumps(keys)).save(path)
    return path


def write_grid(cell_rows: DataFrame, path: str, subdivisions: int = 5) -> str:
    """Writes a grid's rows as one grid file; cells are dealt to tasks by range."""
    register(cell_rows.sparkSession)
    rows = cell_rows.select("level", "ci", "cj", "si", "sj", "fi").repartitionByRange("ci", "cj").sortWithinPartitions("ci", "cj", "si", "sj", "fi")
    rows.write.format("ggrid").mode("overwrite").option("subdivisions", subdivisions).save(path)
    return path
