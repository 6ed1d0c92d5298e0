"""The ten operators over their whole tables, as registered queries; SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import audio, bpe, cotrain, htmlmain, mixing, repair, rules, simhash, toxicity, urlfilter
from tilewright.llm.common import table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxic_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Fitted:
    return toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxic_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "neighbours", "cosines")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.decide(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE))


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_digest(audio.store_text(table(spark, sf_dir, "documents")))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.contract(table(spark, sf_dir, "documents"))


def op7_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read(repair.store(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE), byte_pattern()))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(table(spark, sf_dir, "pages"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return cotrain.judge(table(spark, sf_dir, "documents"), labels).withColumn("kept", F.col("predicted") == 1)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_bpe, op4_audio, op5_urls, op6_simhash, op7_repair, op8_html, op9_rules, op10_quality, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op5_urls": urlfilter.sql()}
