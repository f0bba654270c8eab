"""CSV files read by many tasks, with row numbers, though quoted cells hold line ends.

Spark cuts files into blocks and these into physical lines. Whether a line begins inside a quoted cell depends on all lines before
it, so every block is read twice: first each block tells, for either case at its beginning, in which case it ends and how many records begin
in it (a line maps the cases to cases; lines without quotes change nothing). The driver strings these few numbers of all
blocks together, after which every task knows how its block begins and its first record's number. Then
records are put together; one that runs over blocks is joined from its parts, and only those parts are shuffled.
"""

from __future__ import annotations

import csv
import io
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Messages that users of such files know.
EMPTY, NO_ROWS = "CSV file appears empty.", "CSV has no data rows."
TOO_FEW, TOO_MANY = "Too few fields: expected {n} fields but parsed {m}", "Too many fields: expected {n} fields but parsed {m}"
UNCLOSED = "Quoted field unterminated"


class Lines:
    """How physical lines change between outside (0) and inside (1) a quoted cell."""

    def __init__(self, sep: str):
        s = re.escape(sep)
        self.whole = re.compile(rf'(^|{s})"(?:[^"]|"")*"(?={s}|$)')
        self.opens = re.compile(rf'(?:^|{s})"')
        self.closes = re.compile(r'(?:[^"]|"")*"')

    def after(self, line: str) -> tuple[int, int]:
        """The case after the line, of one that begins outside and one that begins inside."""
        line = line.rstrip("\r")
        closed = self.closes.match(line)
        return self._outside(line), self._outside(line[closed.end() :]) if closed else 1

    def _outside(self, line: str) -> int:
        return int(bool(self.opens.search(self.whole.sub(r"\1", line))))

    def before(self, values: pa.Array, case: int) -> tuple[np.ndarray, int]:
        """The case before each line, and after the last."""
        out, at = np.empty(len(values), np.int8), 0
        for i in np.flatnonzero(pc.count_substring(values, '"').to_numpy(zero_copy_only=False)):
            out[at : i + 1] = case
            case, at = self.after(values[int(i)].as_py())[case], i + 1
        out[at:] = case
        return out, case


def _runs(batch: pa.RecordBatch):
    """(file, block, values) for each stretch of a batch's lines that lies in one block."""
    files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy(zero_copy_only=False)
    edges = [0, *(i for i in range(1, len(files)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]), len(files)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield files[a], int(blocks[a]), batch.column("value").slice(a, b - a)


def _filled(values: pa.Array) -> np.ndarray:
    """Lines that are not empty."""
    return pc.not_equal(pc.utf8_rtrim(values, "\r"), "").to_numpy(zero_copy_only=False)


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def block_starts(lines: DataFrame, sep: str) -> tuple[dict, dict, bool]:
    """{(file, block): (case, first record)}, {file: records}, records counted from 0 in each file, and whether every block and
    file ends outside quotes."""

    def summary(batches):
        known, seen = Lines(sep), {}
        for b in batches:
            for file, block, values in _runs(b):
                own, filled = seen.setdefault((file, block), [0, 1, 0, 0]), _filled(values)
                for h in (0, 1):
                    before, own[h] = known.before(values, own[h])
                    own[2 + h] += int(((before == 0) & filled).sum())
        rows = [(*k, *v) for k, v in seen.items()]
        names = ["file", "block", "end0", "end1", "n0", "n1"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    starts, totals, now, whole = {}, {}, None, True
    for r in sorted(lines.mapInArrow(summary, "file string, block long, end0 int, end1 int, n0 long, n1 long").collect()):
        if r["file"] != now:
            now, case = r["file"], 0
            totals[now] = 0
        starts[now, r["block"]] = case, totals[now]
        totals[now] += (r["n0"], r["n1"])[case]
        case = (r["end0"], r["end1"])[case]
        whole = whole and not case
    return starts, totals, whole


def records(lines: DataFrame, sep: str, starts: dict, all_whole: bool) -> DataFrame:
    """file, record, text: all records, their inner line ends kept."""
    spark = lines.sparkSession
    held = spark.sparkContext.broadcast(starts)

    def assemble(batches):
        known, at = Lines(sep), None
        case, number, parts, begun = 0, 0, [], False
        rows: list[tuple] = []

        def close(whole: bool) -> None:
            if parts:
                text = "\n".join(parts)
                rows.append((*at, number - 1, text, begun and whole))
                parts.clear()

        def made():
            names, kinds = ["file", "block", "record", "text", "whole"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
            rows.clear()
            return out

        for b in batches:
            for file, block, values in _runs(b):
                if (file, block) != at:
                    close(case == 0)
                    at = file, block
                    (case, number), begun = held.value[at], False
                before, case = known.before(values, case)
                for value, inside, filled in zip(values.to_pylist(), before.tolist(), _filled(values).tolist()):
                    if inside:
                        parts.append(value)
                        continue
                    close(True)
                    begun = True
                    if filled:
                        number += 1
                        parts.append(value)
                if len(rows) > 5_000:
                    yield made()
        if at is not None:
            close(case == 0)
        if rows:
            yield made()

    out = lines.mapInArrow(assemble, "file string, block long, record long, text string, whole boolean")
    whole = out.where("whole").select("file", "record", "text")
    if not all_whole:  # some record runs over blocks, or a file ends in one
        parts = out.where("not whole").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))
        whole = whole.unionByName(parts.select("file", "record", F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("text")))
    text = F.regexp_replace(F.col("text"), "\r$", "")
    return whole.select("file", "record", F.when(F.col("record") == 0, F.regexp_replace(text, "^﻿", "")).otherwise(text).alias("text"))


def unquoted(text: Column, sep: str) -> Column:
    """A record without its quoted cells."""
    s = re.escape(sep)
    return F.regexp_replace(text, rf'(^|{s})"(?:[^"]|"")*"(?={s}|$)', "$1")


def fields(text: Column, sep: str) -> Column:
    """How many fields a record has."""
    bare = unquoted(text, sep)
    return F.char_length(bare) - F.char_length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


class CsvFile:
    """Files of one header. .names; .rows(): row (counted from 0 over a file's data rows), file, and the cells as texts; .errors():
    rows of another number of fields than the header."""

    def __init__(self, spark: SparkSession, path: str, sep: str):
        self.sep, self.lines = sep, physical_lines(spark, path)
        starts, totals, whole = block_starts(self.lines, sep)
        if not any(totals.values()):
            raise ValueError(EMPTY)
        self.totals = {f: n - 1 for f, n in totals.items() if n}
        self.all = records(self.lines, sep, starts, whole)
        first = self.all.where((F.col("record") == 0) & (F.col("file") == min(self.totals))).first()["text"]
        self.names = [c.strip() for c in next(csv.reader(io.StringIO(first, newline=""), delimiter=sep))]
        if not any(self.totals.values()):
            raise ValueError(NO_ROWS)

    def _parsed(self) -> DataFrame:
        cells = ", ".join(f"c{i} string" for i in range(len(self.names)))
        options = dict(sep=self.sep, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", maxCharsPerColumn="-1", maxColumns=str(max(20_480, len(self.names) + 1)))
        data = self.all.where("record > 0").select((F.col("record") - 1).alias("row"), "file", "text", F.from_csv("text", f"{cells}, _bad string", options).alias("v"))
        m = fields(F.col("text"), self.sep)
        n = len(self.names)
        few, many = (F.lit(t.format(n=n, m="")) for t in (TOO_FEW, TOO_MANY))
        said = F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(": "), F.when(m < n, few).otherwise(many), m.cast("string"))
        unclosed = F.when(unquoted(F.col("text"), self.sep).rlike(rf'(^|{re.escape(self.sep)})"'), F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(f": {UNCLOSED}")))
        return data.select("row", "file", "v", F.coalesce(unclosed, F.when(m != n, said)).alias("error"))

    def rows(self, strict: bool = True) -> DataFrame:
        """strict: reading a row of another number of fields is an error; without it missing cells are empty and further
        ones go."""
        names = self.names
        cell = lambda i: F.coalesce(F.col(f"v.c{i}"), F.lit(""))
        safe = lambda i: F.when(F.col("error").isNull(), cell(i)).otherwise(F.raise_error(F.col("error")).cast("string"))
        return self._parsed().select("row", "file", *[(safe(i) if strict else cell(i)).alias(c) for i, c in enumerate(names)])

    def errors(self) -> DataFrame:
        """row, file, message."""
        return self._parsed().where("error is not null").select("row", "file", F.col("error").alias("message"))
