"""From raw documents to packed training sequences: five stages, each written before the next one reads it.

Every stage but the last returns the columns of documents. A run deletes a stage's scratch tables, and the rows that it read, once
its own rows are written.

Defined cases: those of the stages' operators, in turn. A null or empty text fails the quality rules, so it ends there; rows with a
null doc_id stay but for their text's sake (quality, repeated passages, benchmark items), as no other document can name them; of rows
with equal doc_id all or none are kept as copies; empty tables give no pieces; extra columns are carried to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagestrata.llm import decontaminate, jaccard, packing, quality, shared, substrings

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def _substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.dedup(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", _quality),
    ("n-gram Jaccard join", _near_duplicates),
    ("substring dedup", _substrings),
    ("benchmark decontamination", _decontaminate),
    ("packing", _pack),
]

#: MinHash, SimHash and the tokenizer can't be expressed in SQL; the pipeline is tested against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all documents."""
    docs, used = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        mark = len(shared.paths_since(0))
        out = stage(spark, docs, sf_dir)
        used += shared.paths_since(mark)
        path = shared.new_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        shared.release(spark, used)
        used = [path]
    return docs
