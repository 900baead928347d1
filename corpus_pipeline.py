"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again by the next one.
All but the last return the columns of documents. The stages call the operators of evalspark.llm.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import evalspark
from evalspark.llm.decontamination import LEAKS, decontaminate, question_and_answer
from evalspark.llm.packing import pack_documents
from evalspark.llm.quality import fit_quality, quality_score
from evalspark.llm.repeats import remove_repeats
from evalspark.llm.simhash import near_duplicates_removed
from evalspark.staging import stage, use_own_folder

# Python workers may start in another folder, so they get the functions themselves.
cloudpickle.register_pickle_by_value(evalspark)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones, learned from the labelled rows that are not held out."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rows=20_000, parts=3, part=1)
    return docs.filter(quality_score(F.col("text"), model) >= 0.5)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id."""
    return near_duplicates_removed(docs, shingle_words=3, distance=2)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that occur earlier; n_chars follows the text."""
    return remove_repeats(docs, length=100).withColumn("n_chars", F.length("text").cast("long"))


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items, *question_and_answer(F.col("text")), rules=LEAKS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("repeats", without_repeats),
    ("decontamination", without_test_items),
    ("packing", packed),
]

#: Learned models, fingerprints and tokens are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on the written result of the one before, in the shared folder."""
    use_own_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name=name)
    return STAGES[-1][1](spark, docs, sf_dir)
