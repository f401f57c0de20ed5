"""A corpus pipeline: stages over documents, each written and read again before the next.

Quality classifier, near-duplicates, benchmark decontamination, mixing to target weights, token ids. All but the last return
the columns of documents; the last returns doc_id, start, n_tokens, ids_crc32 of each document of the mix, read back from
the files of ids that it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexshard.llm import decontaminate, mixing, neardup, quality
from lexshard.llm.queries import token_files
from lexshard.llm.shared import written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within the threshold of their language."""
    return quality.drop(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return neardup.drop(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is, or nearly is, an item of the benchmark."""
    return decontaminate.drop(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Files of token ids, read back: a row for each document of the mix."""
    return token_files(docs)


STAGES = [
    ("quality classifier", classify),
    ("near-duplicates", deduplicate),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources", mix_sources),
    ("token ids", tokenize),
]
#: SQL has neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each to the table that the one before it left in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
