"""CSV files in many blocks, against the csv module of Python; rows of another width; files written in parts."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from plumbline.sources import tables
from plumbline.sources.csv_split import CsvFile, Lines, block_starts, physical_lines


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "90", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def text(seed, rows, end="\n", odd=True):
    rng, out = random.Random(seed), ["id,note,last"]
    cells = ["plain", '"quoted, cell"', '"two\nlines"', '"a ""b"" c"', '""', "", ' x ', '"\n\n"', "ünï", '"ends with quote"""', '""""', '"long ' + "y" * 120 + '\nmore"']
    if odd:
        cells += ['st"ray', 'a""b', '5" tall']
    for i in range(rows):
        out.append(f"{i},{rng.choice(cells)},{rng.choice(cells)}")
        if rng.random() < 0.1:
            out.append("")
    return end.join(out) + rng.choice(["", end])


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n"), (4, "\r\n")])
def test_blocks_give_what_the_whole_gives(spark, tmp_path, small_blocks, seed, end):
    t = text(seed, 60, end)
    (tmp_path / "a.csv").write_bytes(t.encode())
    file = CsvFile(spark, str(tmp_path / "a.csv"), ",")
    assert file.lines.rdd.getNumPartitions() > 20
    want = [r for r in csv.reader(io.StringIO(t, newline="")) if r != [] and r != [""]]
    assert file.names == want[0]
    got = file.rows().orderBy("row").collect()
    assert [list(r)[2:] for r in got] == want[1:] and [r["row"] for r in got] == list(range(60))
    assert file.errors().count() == 0
    starts, totals, whole = block_starts(file.lines, ",")
    assert list(totals.values()) == [61] and any(case for case, _ in starts.values()) and not whole


def test_rows_of_another_width(spark, tmp_path, small_blocks):
    lines = ["a,b,c"] + [",".join(f"v{i}" if j else f'"x\n{i}"' for j in range(2 + (i % 5 == 0) + 2 * (i % 7 == 3) + (i % 5 > 0) * (i % 7 != 3) - (i % 11 == 0))) for i in range(40)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    width = [x.count(",") + 1 for x in lines[1:]]
    want = {i: f"Row {i}: Too {'few' if m < 3 else 'many'} fields: expected 3 fields but parsed {m}" for i, m in enumerate(width) if m != 3}
    assert len(want) > 5 and {m < 3 for m in width if m != 3} == {True, False}
    assert {r["row"]: r["message"] for r in tables.csv_errors(spark, str(tmp_path / "a.csv"), ",").collect()} == want
    with pytest.raises(Exception, match=r"Row \d+: Too (few|many) fields"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), ",").collect()
    loose = CsvFile(spark, str(tmp_path / "a.csv"), ",").rows(strict=False).orderBy("row").collect()
    assert len(loose) == 40 and all(r["c"] == "" for r, m in zip(loose, width) if m < 3)


def test_several_files_and_empty_ones(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, t in (("a", "﻿k,v\n1,x\n2,y"), ("b", ""), ("c", "k,v\n"), ("e", "k,v\n9,z\n")):
        (tmp_path / "d" / name).write_text(t)
    rows = CsvFile(spark, str(tmp_path / "d"), ",").rows().collect()
    assert sorted((r["row"], r["k"], r["v"]) for r in rows) == [(0, "1", "x"), (0, "9", "z"), (1, "2", "y")]
    (tmp_path / "none").write_text("\n\n")
    (tmp_path / "head").write_text("k,v\n")
    for name, message in (("none", "appears empty"), ("head", "no data rows")):
        with pytest.raises(ValueError, match=message):
            CsvFile(spark, str(tmp_path / name), ",")
    (tmp_path / "open").write_text('k,v\n1,"never closed\n2,x\n')
    unclosed = CsvFile(spark, str(tmp_path / "open"), ",")
    assert unclosed.all.count() == 2 and [r["message"] for r in unclosed.errors().collect()] == ["Row 0: Quoted field unterminated"]


def test_how_lines_change():
    known = Lines(",")
    for line, want in (("a,b", (0, 1)), ('"a', (1, 0)), ('a,"b', (1, 0)), ('a"b', (0, 0)), ('x",y', (0, 0)), ('x","y', (1, 1)), ('"a ""b"', (0, 1)), ('""', (0, 1)), ('"",""', (0, 1)), ('"""', (1, 1)), ("", (0, 1))):
        # inside, a line that holds no closing quote stays inside
        assert known.after(line)[0] == want[0], line
    assert known.after('x",y')[1] == 0 and known.after('x","y')[1] == 1 and known.after("a,b")[1] == 1 and known.after('a""b')[1] == 1


def test_files_in_parts_are_one_file(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", 'q"q', "c,d", "e\nf", " lead", "tail ", "", None, "\r", "é"]), i / 8) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, note string, x double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that several tasks write
    try:
        assert df.orderBy("id").rdd.getNumPartitions() > 1
        tables.write_csv(df, str(tmp_path / "out"), order="id", bom=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (name,) = [x for x in (tmp_path / "out").iterdir() if not x.name.startswith(".")]
    got = name.read_bytes().decode("utf-8-sig")
    back = list(csv.reader(io.StringIO(got, newline="")))
    assert back == [["id", "note", "x"], *([str(i), n or "", str(x)] for i, n, x in rows)] and got.startswith("id,note,x\r\n0,")
    tables.write_csv(df.limit(0), str(tmp_path / "none"))
    assert [x for x in (tmp_path / "none").iterdir() if not x.name.startswith(".")][0].read_bytes() == b"id,note,x\r\n"
    again = tables.read_csv(spark, str(tmp_path / "out"), ",")
    assert sorted((int(r["id"]), r["note"]) for r in again.collect()) == [(i, n or "") for i, n, _ in rows]
    assert physical_lines(spark, str(tmp_path / "out")).where(F.col("value").contains("q")).count() > 0
