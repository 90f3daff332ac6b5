"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token files.

Each stage takes the documents that the one before it kept.  All but the last return the columns of documents, those
of clashing names included.  An empty table stays one through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notarium.llm import decontam, mixing, neardup, rules, tokens
from notarium.llm.common import fresh_dir, table
from notarium.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove failing lines and the documents that the rules reject.

    Null, empty and blank texts have fewer words than asked for and go; repeated rows are judged one by one.
    """
    return rules.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each group of near-duplicates.

    A document without words is linked with nothing and stays; of rows that repeat doc_id and text, one stays.
    """
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of the benchmark.

    Null and empty texts hold none and stay; an empty benchmark drops nothing.
    """
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources come near their target weights.

    A null source is a source of its own; a source without words is left out whole; copies are equal rows.
    """
    return mixing.repeat_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return, from them, each document's place and checksum.

    A null or empty text is its end id alone; copies of a document are encoded and placed one after the other.
    """
    return tokens.encode_and_read(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: The tokenizer and the near-duplicate sets of a changed corpus are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_dir(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
