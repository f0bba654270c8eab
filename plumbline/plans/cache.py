"""Layers kept as Parquet, by key and version, with a time to live."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession

TTL_S = 24 * 3600


class LayerCache:
    """Entries below root, one folder per key, version and time of expiry; a failed write only means no entry."""

    def __init__(self, spark: SparkSession, root: str, now=time.time):
        self.spark, self.root, self.now = spark, root.rstrip("/"), now

    def _folder(self, key: str, version: str) -> str:
        return f"{self.root}/{re.sub('[^A-Za-z0-9]+', '_', key)}/{re.sub('[^A-Za-z0-9.]+', '_', version)}"

    def _entries(self, folder: str) -> list[tuple[int, str]]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = [n for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
        return sorted((int(n), f"{folder}/{n}") for n in done)

    def put(self, key: str, version: str, df: DataFrame, ttl_s: int = TTL_S) -> bool:
        try:
            df.write.parquet(f"{self._folder(key, version)}/{int(self.now() + ttl_s)}")
            return True
        except Exception:  # a full or read-only store must not stop the query that fills it
            return False

    def get(self, key: str, version: str) -> DataFrame | None:
        alive = [p for expiry, p in self._entries(self._folder(key, version)) if expiry > self.now()]
        return self.spark.read.parquet(alive[-1]) if alive else None

    def get_or(self, key: str, version: str, make) -> DataFrame:
        found = self.get(key, version)
        if found is None:
            made = make()
            found = (self.get(key, version) or made) if self.put(key, version, made) else made
        return found
