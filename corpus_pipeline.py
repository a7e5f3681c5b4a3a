"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns what it keeps.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmint.llm import decontaminate, jaccard_join, packing, quality, suffix_dedup
from segmint.llm.common import kept, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality rules reject go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays: the one with the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start in a document with a smaller doc_id are cut out; n_chars follows."""
    out = suffix_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left, packed into sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_items),
    ("packing", pack),
]

#: Tokenizer ids, components and suffix spans can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
