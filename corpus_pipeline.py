"""The corpus pipeline: documents through quality rules, line dedup, near-duplicate removal, benchmark
decontamination and source mixing. Each stage works on all that the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. Between
stages ``run`` writes a table in the shared folder, so a lost executor never repeats more than a stage. Defined cases
are those of the operators; a document whose lines all go stays with an empty text, and n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import contamination, jaccard, lines, mixing, quality
from plumbline.llm.common import Work, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, but in their largest holder."""
    out = lines.drop_repeated_lines(spark, docs, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity of 0.8 or more."""
    return jaccard.keep_one(spark, docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return contamination.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document that is left."""
    return mixing.mix(spark, docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]
#: The stages one after the other, each over the rows that the one before keeps.
ORACLE_SQL = f"""
WITH good AS (SELECT doc_id, source, text FROM ({quality.judge_sql("documents", "doc_id, source, text")}) WHERE kept),
short AS (SELECT doc_id, source, kept AS text FROM good JOIN ({lines.dedup_sql("good")}) USING (doc_id)),
single AS (SELECT short.* FROM short JOIN ({jaccard.components_sql("short", words=5, percent=80)}) USING (doc_id) WHERE component_id = doc_id),
clean AS (SELECT single.* FROM single JOIN ({contamination.report_sql("single")}) USING (doc_id) WHERE NOT contaminated)
SELECT * FROM ({mixing.mix_sql("clean")})
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    work, last = Work(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
        if last is not None:
            work.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
