"""From raw documents to packed training sequences, by five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. All but the last return the columns of documents:

- quality_rules drops rejected documents,
- near_duplicates keeps one document of each group of similar ones,
- repeated_passages cuts passages out that an earlier document has,
- decontamination drops documents that contain a benchmark item,
- packing gives the pieces of the packed sequences.

Null or empty texts fail the quality rules; an empty table stays empty through
all stages; repeated rows are near duplicates, one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from classledger.llm import decontamination, jaccard, packing, quality, substrings
from classledger.llm.tables import materialise, read

SHINGLE_WORDS = 5
PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, SHINGLE_WORDS, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.cut_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates),
          ("repeated_passages", repeated_passages), ("decontamination", decontaminate), ("packing", pack)]

#: Decision lists, components and packing are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
