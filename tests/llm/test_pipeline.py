"""The corpus pipeline, stage by stage, against brute force and on odd rows."""

import corpus_pipeline as p
from conftest import DATA, same_rows
from pyspark.sql import functions as F
from test_corpus_operators import brute_components, brute_hits, brute_lines, odd  # noqa: F401

from plumbline.llm import quality


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    table = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    one = p.STAGES[0][1](spark, docs, DATA).cache()
    assert one.columns == docs.columns and sorted(table(one)) == sorted(r["doc_id"] for r in quality.judge(docs).where("kept").collect())
    two = p.STAGES[1][1](spark, one, DATA).cache()
    assert two.columns == docs.columns and table(two) == {i: t for i, _, _, t in brute_lines(list(table(one).items()))}
    assert two.where("n_chars <> char_length(text)").count() == 0
    three = p.STAGES[2][1](spark, two, DATA).cache()
    assert three.columns == docs.columns and sorted(table(three)) == sorted(i for i, _, c in brute_components(table(two), 5, 80) if i == c)
    four = p.STAGES[3][1](spark, three, DATA).cache()
    hits = brute_hits(list(table(three).items()), bench)
    assert four.columns == docs.columns and sorted(table(four)) == sorted(i for i, h in hits.items() if not h[4])
    five = p.STAGES[4][1](spark, four, DATA)
    mixed = five.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("source_size").alias("s"), F.sum("size").alias("size")).collect()
    assert mixed and all(r["taken"] == int(r["target"]) and r["s"] == r["size"] for r in mixed)
    run = p.run(spark, DATA)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, five.collect())) and run.count() == four.count()
    same_rows(run, p.ORACLE_SQL)


def test_odd_rows(spark, odd):  # noqa: F811
    docs = odd
    for name, stage in p.STAGES:
        out = stage(spark, docs, DATA)
        assert name == "source_mixing" or out.columns == odd.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    empty = odd.where("false")
    for name, stage in p.STAGES:
        assert stage(spark, empty, DATA).count() == 0
