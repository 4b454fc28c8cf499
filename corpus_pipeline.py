"""A training-corpus pipeline: quality rules, near duplicates, benchmark decontamination, personal data, source mix.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and is written as Parquet before the next one
reads it.  All stages but the last return the columns of documents; the last one returns a row per document with the words the mix
takes of it.  The learned quality rules and the 64-bit hashes of the shingles have no counterpart in SQL, so ORACLE_SQL is None
and tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm.common import fresh_path, table
from latticework.llm.decontaminate import remove_contaminated
from latticework.llm.mixing import mix_sources
from latticework.llm.pii import sanitise
from latticework.llm.quality import keep_good
from latticework.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = fresh_path(spark, f"pipeline-{k}-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    raise AssertionError("the pipeline has stages")
