"""Working tables, table loading and small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shared import delete, shared_folder

#: What words are made of, as in the contracts (Java and RE2 syntax alike).
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of this process's operator calls, for clear_work.
FOLDERS: list[str] = []


def clear_work(spark: SparkSession) -> None:
    """Deletes the working tables of all operator calls so far. Results are lazy and read them, so call it once results
    are written or no longer needed."""
    while FOLDERS:
        delete(spark, FOLDERS.pop())


class Work:
    """Working tables of one operator call, as Parquet in the shared folder: they cut lineage, survive
    lost executors, and are dropped as soon as a later table replaces them; clear_work drops what results still read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = shared_folder(spark, name)
        FOLDERS.append(self.base)
        self.paths: dict[int, str] = {}
        self.n = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = path
        self._keep = getattr(self, "_keep", []) + [out]
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes working tables that no later plan reads."""
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                delete(self.spark, path)
                self._keep = [x for x in self._keep if x is not df]
        self.tidy()

    def tidy(self) -> None:
        """Lets Spark's cleaner remove shuffle files of plans that are done."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def by_groups(rows: DataFrame, groups: DataFrame, keys: list[str], share: int = 10_000, total: int | None = None, others: Callable[[DataFrame], DataFrame] | None = None, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with groups, a written table with a row for each key and n, the number of rows that have it. Groups of
    more than one in ``share`` of all grouped rows, so fewer than ``share`` of them at any size, are broadcast, and their rows
    stay where they are; only rows of smaller groups are shuffled by key. total: the sum of n, if it is known. others:
    what is done with the rows of no large group before they are joined."""
    if total is None:
        total = groups.agg(F.sum("n")).first()[0] or 0
    most = total // share
    large, rest = groups.where(F.col("n") > most).drop("n"), groups.where(F.col("n") <= most).drop("n")
    small = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    small = others(small) if others else small
    return rows.join(F.broadcast(large), keys).unionByName(small.join(rest.hint("merge"), keys, how))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Python tasks of what is written in this block get at most so many rows at a time; for rows that are long texts or arrays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


FAN_IN = 32


def tree_sum(rows: DataFrame, parts: int) -> DataFrame:
    """rows (segment, part, counts: 64-bit integers, as many in all rows of a segment), summed over the parts, which are
    numbered from 0, at most FAN_IN arrays in a group of each step."""

    def add(group: pa.Table) -> pa.Table:
        total = np.frombuffer(b"".join(group.column("counts").to_pylist()), "<i8").reshape(group.num_rows, -1).sum(0)
        return pa.table([group.column("segment").slice(0, 1), group.column("part").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["segment", "part", "counts"])

    while True:
        parts = -(-parts // FAN_IN)
        rows = rows.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("segment", "part").applyInArrow(add, "segment int, part int, counts binary")
        if parts <= 1:
            return rows


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def crc_mod3(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % 3


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
