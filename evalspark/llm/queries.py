"""One registered query per operator: production parameters, whole tables, and the columns that are checked."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.decontamination import LEAKS, find_leaks, question_and_answer
from evalspark.llm.language import identify_language
from evalspark.llm.line_quality import judge_lines
from evalspark.llm.oracle import ORACLE
from evalspark.llm.packing import pack_documents
from evalspark.llm.quality import classify_quality
from evalspark.llm.repeats import find_repeats
from evalspark.llm.secret_scan import scan_secrets
from evalspark.llm.sharding import shard_records
from evalspark.llm.simhash import simhash_near_dedup
from evalspark.llm.spelling import spelling_variants
from evalspark.llm.toxicity import classify_toxicity
from evalspark.llm.url_templates import filter_urls
from evalspark.llm.whitening import whiten_embeddings


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(documents(spark, sf_dir), items, *question_and_answer(F.col("text")), rules=LEAKS)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(documents(spark, sf_dir), length=100)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, allow=["com/", "www.example.com/en/"], block=["example.com/en/", "net/es/", "net/fr/"])


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_lines(documents(spark, sf_dir), least_documents=20, share=0.01, kept_share=0.5)
    return found.drop("removed_lines")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(documents(spark, sf_dir), parts=4, part=2)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(documents(spark, sf_dir), labels(spark, sf_dir), rows=20_000, parts=3, part=1, threshold=0.5)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(documents(spark, sf_dir), shingle_words=3, distance=2)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(documents(spark, sf_dir), labels(spark, sf_dir), rows=16_000, parts=4, part=2, threshold=0.3)


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(documents(spark, sf_dir), weights=[1.0] * 40)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir), least=0.5)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir), one_in=97, shortest=5, least=3, ratio=2)


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long holds, which takes some 10^6 rows of these tables, is null here and whole in the operator."""
    found = whiten_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=8)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


__all__ = ["ORACLE", "QUERIES"]

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pack": op2_pack,
    "op3_repeats": op3_repeats,
    "op4_urls": op4_urls,
    "op5_lines": op5_lines,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_shard": op10_shard,
    "op11_secrets": op11_secrets,
    "op12_spelling": op12_spelling,
    "op13_whiten": op13_whiten,
}
