"""One GeoJSON file read by many tasks.

Spark cuts the file into blocks, and these at closing braces, wherever they stand. What a brace, bracket or comma means depends on all text
before it, so there are three passes. In the first, every block tells how it changes nesting, and whether it ends within a string,
for either case at its beginning; the driver adds these few numbers up. In the second, each block knows its
beginning, tells where the top level's arrays open and close, and counts the commas between their elements. In the third, blocks cut the
features out with their numbers; a feature that runs over blocks is joined of its parts, and only parts are shuffled. What is
left of the file, without its features, is checked by itself. The third pass is made once for what is no whole feature, which Spark keeps
(about two pieces a block), once for the check of features, and once for the result.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .geojson import feature_error, parsed_features, validation_error

QUOTE, BACKSLASH, BRACE, COMMA = 34, 92, 125, 44
#: By byte: how it changes the depth of braces and of brackets, and whether it is any of these or a comma.
BRACES, BRACKETS = np.zeros(256, np.int64), np.zeros(256, np.int64)
BRACES[[123, 125]] = BRACKETS[[91, 93]] = 1, -1
MARKS = (BRACES != 0) | (BRACKETS != 0)
MARKS[COMMA] = True
KEY = re.compile(rb'"features"\s*:\s*$')


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "}").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")


def _texts(batches):
    """(file, block, size of the file, bytes) of a task, whole lines at a time; the brace that a line was cut at is put back."""
    for b in batches:
        keys = [b.column(c) for c in ("file", "block", "size")]
        values = b.column("value").cast(pa.large_binary())
        off = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)
        first = [pc.run_end_encode(k).run_ends.to_numpy() for k in keys[:2]]
        ends = np.union1d(*first).tolist() if len(values) else []
        for at, end in zip([0, *ends], ends):
            own, cuts = raw[off[at] : off[end]], off[at + 1 : end + 1] - off[at]
            yield *(k[at].as_py() for k in keys), np.insert(own, cuts, BRACE).tobytes()


class Place:
    """Where a text stands: within a string or not, and how deep."""

    def __init__(self, inside: int = 0, braces: int = 0, brackets: int = 0):
        self.inside, self.braces, self.brackets = inside, braces, brackets

    def read(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The places of braces, brackets and commas outside strings, these bytes, and the depths after each; moves on behind the data."""
        a, flips = _strings(data)
        at = np.flatnonzero(MARKS[a] & (flips % 2 == self.inside))
        c = a[at]
        braces, brackets = self.braces + np.cumsum(BRACES[c]), self.brackets + np.cumsum(BRACKETS[c])
        if len(a):
            self.inside = int((flips[-1] + self.inside) % 2)
        if len(at):
            self.braces, self.brackets = int(braces[-1]), int(brackets[-1])
        return at, c, braces, brackets


def _strings(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, and how many strings have begun or ended up to each, modulo 256."""
    a = np.frombuffer(data, np.uint8)
    quotes = a == QUOTE
    back = np.flatnonzero(a == BACKSLASH)
    if len(back):
        begins = np.r_[True, back[1:] != back[:-1] + 1]
        run = back - np.maximum.accumulate(np.where(begins, back, 0)) + 1  # backslashes up to each
        after = back[(run % 2 == 1)] + 1
        quotes[after[after < len(a)]] = False
    return a, np.cumsum(quotes, dtype=np.uint8)


def _nesting(batches):
    seen, bytes_ = {}, {}
    for file, block, size, data in _texts(batches):
        bytes_[file, block] = size, bytes_.get((file, block), (0, 0))[1] + len(data)
        for place in seen.setdefault((file, block), (Place(0), Place(1))):
            place.read(data)
    rows = [(*k, *(x for p in v for x in (p.inside, p.braces, p.brackets)), *bytes_[k]) for k, v in seen.items()]
    names = ["file", "block", "s0", "b0", "k0", "s1", "b1", "k1", "size", "n"]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(10)], names)


def _events(place: Place, data: bytes):
    """(offset, kind) of the top level: "[" of the features, "(" of another array, "]" of either, "," between elements."""
    at, c, braces, brackets = place.read(data)
    top = (braces == 1) & (((c == 91) & (brackets == 1)) | ((c == 93) & (brackets == 0)) | ((c == COMMA) & (brackets == 1)))
    for i, kind in zip(at[top].tolist(), map(chr, c[top].tolist())):
        yield i, "(" if kind == "[" and not KEY.search(data, max(0, i - 200), i) else kind


class Split:
    """.features(): file, number, text of every element of the files' features; .rest(): file, text of what else they hold."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.lines = spark, _chunks(spark, path)
        known, read, sizes, now = {}, {}, {}, None
        for r in sorted(self.lines.mapInArrow(_nesting, "file string, block long, s0 long, b0 long, k0 long, s1 long, b1 long, k1 long, size long, n long").collect()):
            if r["file"] != now:
                now, inside, braces, brackets = r["file"], 0, 0, 0
            read[now], sizes[now] = read.get(now, 0) + r["n"], r["size"]
            known[now, r["block"]] = inside, braces, brackets
            s, b, k = (r["s1"], r["b1"], r["k1"]) if inside else (r["s0"], r["b0"], r["k0"])
            inside, braces, brackets = s, braces + b, brackets + k
        # a file that does not end in a brace was given one more (a byte order mark of three bytes is not read)
        self.longer = [f for f, n in read.items() if n - sizes[f] in (1, -2)]
        places = spark.sparkContext.broadcast(known)

        def outline(batches):
            seen: dict = {}
            for file, block, _, data in _texts(batches):
                place, kinds, commas = seen.setdefault((file, block), (Place(*places.value[file, block]), [], [0]))
                for _, kind in _events(place, data):
                    if kind == ",":
                        commas[-1] += 1
                    else:
                        kinds.append(kind)
                        commas.append(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64()), pa.array(["".join(v[1]) for v in seen.values()], pa.string()), pa.array([v[2] for v in seen.values()], pa.list_(pa.int64()))],
                ["file", "block", "kinds", "commas"],
            )

        self.starts, now = {}, None
        for r in sorted(self.lines.mapInArrow(outline, "file string, block long, kinds string, commas array<long>").collect()):
            if r["file"] != now:
                now, active, number = r["file"], False, 0
            self.starts[now, r["block"]] = (*known[now, r["block"]], active, number)
            for commas, kind in zip(r["commas"], r["kinds"] + " "):
                number += commas if active else 0
                if kind == "[":
                    active = True
                elif kind == "]" and active:
                    active, number = False, number + 1
        self.pieces = self._pieces()
        self.broken = self.pieces.where("not whole").persist()

    def _pieces(self) -> DataFrame:
        """file, block, part (in order within the block), number (-1: not of a feature), text, whole."""
        held = self.spark.sparkContext.broadcast(self.starts)

        def cut(batches):
            at, place, active, number, begun, parts, rows, part = None, None, False, 0, False, [], [], 0

            def close(whole: bool) -> None:
                nonlocal part
                if parts:
                    rows.append((*at, part, number if active else -1, b"".join(parts).decode(), active and begun and whole))
                    parts.clear()
                    part += 1

            def made():
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "block", "part", "number", "text", "whole"])
                rows.clear()
                return out

            for file, block, _, data in _texts(batches):
                if (file, block) != at:
                    close(False)
                    at, begun, part = (file, block), False, 0
                    inside, braces, brackets, active, number = held.value[at]
                    place = Place(inside, braces, brackets)
                last = 0
                for i, kind in _events(place, data):
                    if kind == "[":
                        parts.append(data[last : i + 1])
                        close(False)
                        active, begun, last = True, True, i + 1
                    elif active:
                        parts.append(data[last:i])
                        close(True)
                        begun, number = True, number + 1
                        last = i + 1 if kind == "," else i
                        active = kind == ","
                if last < len(data):
                    parts.append(data[last:])
                if rows and sum(len(r[4]) for r in rows) > 1 << 20:
                    yield made()
            close(False)
            if rows:
                yield made()

        return self.lines.mapInArrow(cut, "file string, block long, part long, number long, text string, whole boolean")

    @staticmethod
    def _joined(pieces: DataFrame, keys: list[str]) -> DataFrame:
        own = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("p"))
        return own.select(*keys, F.array_join(F.transform("p", lambda p: p["text"]), "").alias("text"))

    def features(self) -> DataFrame:
        whole = self.pieces.where("whole").select("file", "number", "text")
        parts = self._joined(self.broken.where("number >= 0"), ["file", "number"])
        # an empty array has one element of white space
        return whole.unionByName(parts.select(*whole.columns)).where(~((F.col("number") == 0) & F.col("text").rlike(r"^\s*$")))

    def rest(self) -> DataFrame:
        """A file's text with an empty list of features. It is one row a file, as small as the file is without them."""
        own = self._joined(self.broken.where("number < 0"), ["file"])
        return own.select("file", F.when(F.col("file").isin(self.longer), F.regexp_replace("text", r"\}$", "")).otherwise(F.col("text")).alias("text"))


def read_geojson_split(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """The rows of read_geojson, a file being read by as many tasks as it has blocks."""
    split = Split(spark, path)
    # within brackets, as what follows a value would be passed over
    parsed = split.features().select("file", "number", F.expr("try_variant_get(try_parse_json('[' || text || ']'), '$[0]', 'variant')").alias("f"))
    if not validate:
        polygonal = F.expr("coalesce(try_variant_get(f, '$.geometry.type', 'string') IN ('Polygon', 'MultiPolygon'), false)")
        kept = parsed.where(polygonal).withColumn("run", F.expr("number div 4096"))
        runs = kept.groupBy("file", "run").count()
        before = F.sum("count").over(Window.orderBy("file", "run").rowsBetween(Window.unboundedPreceding, -1))
        runs = runs.select("file", "run", F.coalesce(before, F.lit(0)).alias("start"))
        inside = F.row_number().over(Window.partitionBy("file", "run").orderBy("number")) - 1
        return parsed_features(kept.withColumn("pos", inside).join(runs, ["file", "run"]))
    files = split.rest().select("file", F.expr("try_parse_json(text)").alias("v"))
    numbered = parsed.select("file", F.col("number").alias("i"), "f")
    wrong = F.expr(feature_error("f", "i"))
    counts = numbered.groupBy("file").agg(F.count("*").alias("n"), F.min(F.when(F.col("f").isNull(), F.col("i"))).alias("bad"), F.min_by(wrong, F.when(wrong.isNotNull(), F.col("i"))).alias("wrong"))
    # with features cut out, a whole file's only fault may be to have none
    none = F.expr("try_parse_json('{\"type\":\"FeatureCollection\",\"features\":[]}')")
    own = F.when(F.col("bad").isNotNull(), F.lit("Not a JSON object.")).otherwise(validation_error("v"))
    empty = files.select(validation_error("v").alias("e"), none.alias("v")).select(validation_error("v")).limit(1)
    said = sorted(files.join(counts, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("n"), own.alias("e"), "wrong").collect())
    missing = empty.first()[0] if said else None
    for r in said:
        if r["e"] is not None and not (r["e"] == missing and r["n"]):
            raise ValueError(r["e"])
    for r in said:
        if r["wrong"] is not None:
            raise ValueError(r["wrong"])
    # all are polygons, so a feature's number is its place
    starts = list(accumulate((r["n"] for r in said), initial=0))
    if len(said) > 1:
        own_starts = spark.createDataFrame([(r["file"], n) for r, n in zip(said, starts)], "file string, start long")
        parsed = parsed.join(F.broadcast(own_starts), "file")  # a row a file, as were collected
    else:
        parsed = parsed.withColumn("start", F.lit(0))
    return parsed_features(parsed.withColumnRenamed("number", "pos"))
