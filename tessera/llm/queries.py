"""The registered queries of the operators; each applies its operator with production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hnsw, langid, linkgraph, mixing, ngramjoin, quality, sitebayes, tokenfile, warczip
from .common import table

OP6 = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.roundtrip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warczip.roundtrip(table(spark, sf_dir, "pages"))


def op4_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"], light=True).select("doc.doc_id", *[f"mix.{c}" for c in ("size", "source_size", "target", "copies", "taken")], F.round("mix.position", 9).alias("position"))


def op6_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(*OP6, F.round("quality", 6).alias("quality"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"))


def op8_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitebayes.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_token_ids, op2_url_trust, op3_warc_zip, op4_language_filters, op5_mix_curriculum, op6_quality_votes, op7_ngram_join, op8_bpe_tree, op9_site_quality, op10_hnsw_dedup, pipeline)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_zip": warczip.sql(), "op5_mix_curriculum": mixing.sql(), "op6_quality_votes": quality.sql(keep=", ".join(OP6) + ", round(quality, 6) as quality"), "op7_ngram_join": ngramjoin.sql()}
