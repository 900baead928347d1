"""Load, clean, match, land and write both splits of the questions."""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark import schemas
from evalspark.functions.files import bronze_key, rewrite_path
from evalspark.operators.aggregates import attachment_summary, ingest_summary
from evalspark.operators.joins import join_attachments
from evalspark.operators.shaping import conform_schema, split_rejects
from evalspark.sources.objects import Reader, bronze_ingest, read_bronze
from evalspark.sources.tables import overwrite_table, prepare_questions, read_table
from evalspark.staging import stage


class Ingest(NamedTuple):
    questions: DataFrame
    rejects: DataFrame
    attachments: DataFrame
    summary: DataFrame


def conformed(raw: DataFrame, files: DataFrame, bucket: str, created: Column | None = None) -> DataFrame:
    """Raw questions brought to the table's schema, with ``found`` and ``reject_reason``."""
    matched = join_attachments(prepare_questions(raw, created=created), files)
    key = bronze_key(F.col("dataset_split"), F.col("file_name"))
    located = matched.withColumn("file_path", rewrite_path(F.col("found"), bucket, key, F.col("file_path")))
    tagged = conform_schema(located, schemas.QUESTIONS, schemas.QUESTION_LIMITS, ["found", "number_reject"])
    reason = F.nullif(F.concat_ws("; ", "number_reject", "reject_reason"), F.lit(""))
    return tagged.withColumn("reject_reason", reason).drop("number_reject")


def run_ingest(
    spark: SparkSession, raw: DataFrame, files: DataFrame, bucket: str, table_path: str, bronze_path: str,
    written: int, created: Column | None = None, splits: Sequence[str] = schemas.SPLITS, read: Reader | None = None,
) -> Ingest:
    """Replace the splits of the questions table, add a batch to the bronze table, and report on this load.

    ``files`` is (dataset_split, file_name, path) with ``content``, or without it and with a
    function that reads a path. The joined rows are staged once; table, rejects and reports all
    read them back.
    """
    tagged = stage(conformed(raw, files.select("dataset_split", "file_name"), bucket, created), name="ingest")
    good, rejects = split_rejects(tagged)
    bronze_ingest(files, tagged, bronze_path, written, read)
    overwrite_table(good.drop("found"), table_path, splits)
    questions = read_table(spark, table_path, schemas.QUESTIONS)
    landed = read_bronze(spark, bronze_path, written)
    stored = questions.where(F.col("dataset_split").isin(list(splits)))
    return Ingest(questions, rejects, attachment_summary(tagged), ingest_summary(tagged, rejects, landed, stored))
