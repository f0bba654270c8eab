import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    root = tmp_path_factory.mktemp("spark")
    os.environ.setdefault("PYTHONPATH", sys.path[0])
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(root / "cp"))
        .config("spark.sql.warehouse.dir", str(root / "wh")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(df, sql: str, data: str = DATA) -> None:
    """Compares a query with its SQL, rows in any order."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    order = sorted(names)
    assert sorted(df.columns) == order
    want = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in out.fetchall())
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*order).collect())
    assert got == want
