"""Every registered spatial query against its SQL."""

import pytest
from conftest import DATA, same_rows

from plumbline import catalog


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    same_rows(catalog.QUERIES[name](spark, DATA), catalog.ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_crowded_cells_multiply_no_rows(spark, tmp_path):
    """With many boxes and points in the refined cells, points meet counts of candidates; results stay those of the SQL."""
    from conftest import TABLES
    from pyspark.sql import functions as F

    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        if t in ("supplier", "customer"):
            key = {"supplier": "s_suppkey", "customer": "c_custkey"}[t]
            df = df.crossJoin(spark.range(20).withColumnRenamed("id", "copy")).withColumn(key, F.col(key) + F.col("copy") * 10_000).drop("copy")
        df.coalesce(1).write.parquet(str(tmp_path / "parts" / t))
        next((tmp_path / "parts" / t).glob("*.parquet")).rename(tmp_path / f"{t}.parquet")
    made = catalog.QUERIES["grid_candidates"](spark, str(tmp_path))
    joined = made._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    assert "count(" not in joined and "sum(" in joined
    for name in ("grid_candidates", "pip_refined", "pip_given_grid"):
        same_rows(catalog.QUERIES[name](spark, str(tmp_path)), catalog.ORACLE[name], str(tmp_path))
