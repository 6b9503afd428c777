"""A corpus pipeline of five stages: quality rules, quality classifier, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four return the columns of ``documents``:

* quality_rules drops what the base rule fails or the weak labels call bad;
* quality_classifier drops what the scorer puts below its threshold;
* near_dup keeps of each component the document with the smallest doc_id;
* benchmark_leaks cuts the benchmark's passages out of the texts (n_chars follows) and drops a document of which no word is left;
* byte_bpe returns doc_id, n_tokens, ids and digests of the ids and of the bytes that they decode to.

Null texts and rows that repeat are handled as each operator's docstring says; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import benchmark_leaks, byte_bpe, near_dup, quality_classifier, quality_rules
from skyloom.llm.scratch import materialize


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = benchmark_leaks.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.filter(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_dup", duplicates), ("benchmark_leaks", leaks), ("byte_bpe", tokens)]

#: The scorer of the second stage can't be stated in SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
