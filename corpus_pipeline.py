"""A training corpus from `documents`: toxic and poor documents go, one of each group of copies stays, sources are mixed to
their weights, and what remains is encoded. Each stage's rows are written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import bpe, cotrain, mixing, simhash, toxicity
from tilewright.llm.common import cut, table
from tilewright.llm.queries import WORD_BPE, tokenizer_file, toxic_model


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is 0.5 or more."""
    return toxicity.keep_clean(docs, toxic_model(spark, docs, sf_dir))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are likelier bad than good."""
    return cotrain.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of exact and near copies the one with the smallest id: SimHash over five-word shingles, deletion
    variants of its segments as an index, and an exact Jaccard similarity of 0.8."""
    return simhash.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for."""
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document that the mix took."""
    return bpe.digests(docs, tokenizer_file(WORD_BPE))


STAGES = [
    ("toxicity", toxic_stage),
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("mixing", mix_stage),
    ("BPE encoding and decoding", encode_stage),
]

#: The stages learn models, draw numbers and merge pairs, which SQL cannot say; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
