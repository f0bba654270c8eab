"""CSV, manifest and sample tables; CSV output."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .csv_split import EMPTY, CsvFile
from .joined import write_text
from .shared import delete, exists

#: Delimiters to guess from, in order of preference, and the sample of twenty US cities.
DELIMITERS = (",", "\t", "|", ";", "\x1e", "\x1f")
SAMPLE = (
    ("New York NY", "40.7128", "-74.0060"), ("Los Angeles CA", "34.0522", "-118.2437"), ("Chicago IL", "41.8781", "-87.6298"), ("Houston TX", "29.7604", "-95.3698"),
    ("Phoenix AZ", "33.4484", "-112.0740"), ("Philadelphia PA", "39.9526", "-75.1652"), ("San Antonio TX", "29.4241", "-98.4936"), ("San Diego CA", "32.7157", "-117.1611"),
    ("Dallas TX", "32.7767", "-96.7970"), ("San Jose CA", "37.3382", "-121.8863"), ("Austin TX", "30.2672", "-97.7431"), ("Jacksonville FL", "30.3322", "-81.6557"),
    ("Fort Worth TX", "32.7555", "-97.3308"), ("Columbus OH", "39.9612", "-82.9988"), ("Charlotte NC", "35.2271", "-80.8431"), ("San Francisco CA", "37.7749", "-122.4194"),
    ("Indianapolis IN", "39.7684", "-86.1581"), ("Seattle WA", "47.6062", "-122.3321"), ("Denver CO", "39.7392", "-104.9903"), ("Boston MA", "42.3601", "-71.0589"),
)


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter that splits the first lines alike into most fields; a comma where none does."""
    lines = [r["value"] for r in spark.read.text(path).where("value <> ''").limit(10).collect()]
    def fields(d):
        counts = [len(x.split(d)) for x in lines]
        return counts[0] if counts and min(counts) == max(counts) > 1 else 0

    return max(DELIMITERS, key=fields) if any(map(fields, DELIMITERS)) else ","


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """All columns as texts, missing cells empty, header names trimmed. A file without rows, or with a row of another
    number of fields than the header, is an error (the latter when it is read)."""
    file = CsvFile(spark, path, delimiter or sniff(spark, path))
    return file.rows().select(*[F.col(f"`{c}`") for c in file.names])


def csv_errors(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """row, file, message: all rows of another number of fields than the header."""
    return CsvFile(spark, path, delimiter or sniff(spark, path)).errors()


def csv_headers(spark: SparkSession, path: str, delimiter: str | None = None) -> list[str]:
    names = [c.strip() for c in spark.read.option("sep", delimiter or sniff(spark, path)).csv(path, header=True).columns]
    if not names:
        raise ValueError(EMPTY)
    return names


def csv_cell(c: Column) -> Column:
    """A cell as a CSV writes it: quoted if it holds a comma, a quote or a line end, or begins or ends with white space."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\\r\\n]|^[\\s\ufeff]|[\\s\ufeff]$'), quoted).otherwise(text)


def write_csv(df: DataFrame, path: str, order: str | None = None, single: bool = True, bom: bool = False) -> None:
    """A CSV with a header and CRLF line ends, in a folder. single: one file, in order, which tasks write in parts that are joined; without
    it, as many as there are partitions. bom: the first header cell is preceded by a byte order mark."""
    spark, rows = df.sparkSession, df.orderBy(order) if order else df
    header = spark.range(1).select(F.concat_ws(",", *[csv_cell(F.lit(c)) for c in df.columns])).first()[0]
    head = ("\ufeff" if bom else "") + header + "\r\n"
    lines = rows.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in df.columns]).alias("value"))
    if single:
        delete(spark, path)
        write_text(lines, f"{path}/part-00000.csv", head=head, end="\r\n")
    else:
        out = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if bom else rows
        out.write.mode("overwrite").options(header=True, escape='"', emptyValue="", lineSep="\r\n").csv(path)


def sample_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(str(i + 1), lat, lon, city) for i, (city, lat, lon) in enumerate(SAMPLE)], "id string, lat string, lon string, city string")


MANIFEST = (
    "id string, label string, `group` string, sourceUrl string, gjbfUrl string, gridUrl string, labelKey string, translationUrl string, defaultPropertyKey string, "
    "properties array<struct<key:string,label:string,example:string>>, translatedFrom string, translatedTo string, suggestion string, color string"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of layers, one entry per row."""
    return spark.read.option("multiLine", True).schema(MANIFEST).json(path)


def manifest_entry(manifest: DataFrame, layer_id: str) -> dict | None:
    """The catalogue's entry of a layer."""
    found = manifest.where(F.col("id") == layer_id).first()
    return found.asDict(recursive=True) if found else None


def asset_path(base: str, path: str) -> str:
    """An asset's path below base: the first segment of a rooted path is the old base."""
    return base.rstrip("/") + re.sub(r"^/[^/]+/", "/", path)


def asset_paths(base: str, path: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/")), F.regexp_replace(path, "^/[^/]+/", "/"))


def read_many(spark: SparkSession, paths: list[str], fmt: str, **options) -> DataFrame:
    """Several files at once; missing ones are left out."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        raise ValueError("none of the files is there")
    return spark.read.format(fmt).options(ignoreMissingFiles=True, **options).load(there)


def fetched(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at path, made and written by the first call that does not find it whole."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def not_utf8(files: DataFrame) -> DataFrame:
    """Of files (path, content) the paths of those that are not valid UTF-8."""
    return files.where(~F.is_valid_utf8("content")).select("path")


def read_utf8(spark: SparkSession, path: str) -> DataFrame:
    """path and value of whole text files. A file in another encoding is an error, not a text with replaced letters."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    bad = not_utf8(files).first()
    if bad:
        raise ValueError(f"{bad['path']} is not valid UTF-8 (likely Latin-1 or CP1252): re-encode it first")
    return files.select("path", F.col("content").cast("string").alias("value"))


def read_translation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="short string, long string", escape='"')


def write_translation(table: DataFrame, path: str) -> None:
    """short,long with quoted values, in order of first_fi where the table has it."""
    t = table.orderBy("first_fi") if "first_fi" in table.columns else table
    t.select("short", "long").coalesce(1).write.mode("overwrite").options(header=True, quoteAll=True, escape='"').csv(path)


def translation_download(spark: SparkSession, manifest: DataFrame, layer_id: str, base: str, folder: str) -> str | None:
    """Copies a layer's translation table to folder/{id}-translations.csv; None if it has none, or none can be read."""
    entry = manifest_entry(manifest, layer_id)
    if not entry or not entry["translationUrl"] or not exists(spark, asset_path(base, entry["translationUrl"])):
        return None
    out = f"{folder}/{layer_id}-translations.csv"
    write_translation(read_translation(spark, asset_path(base, entry["translationUrl"])), out)
    return out
