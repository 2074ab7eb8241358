"""A corpus pipeline of five of the operators: run(spark, sf_dir) takes the documents through STAGES.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents; repeated rows and rows with nulls pass as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, langid, mixing, ngramjoin, quality
from tessera.llm.common import scratch, table
from tessera.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak supervision of the rules keeps."""
    return quality.passing(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised."""
    return langid.recognised(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8 or more."""
    return ngramjoin.one_of_each(docs, size=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy that the mix takes, in the order of training."""
    return mixing.curriculum(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every copy."""
    return bpe.digests(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("n-gram Jaccard join", ngram_join), ("mixing sources", mix_sources), ("BPE", bpe_tokens)]

#: Language identification and BPE can't be stated in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
