"""From landed documents and recognised blocks to the silver table of texts."""

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from evalspark.functions.files import PYMUPDF_METHOD, TEXTRACT_METHOD, is_pdf
from evalspark.operators.aggregates import concat_lines, extract_counts
from evalspark.operators.documents import Extractor, extract_texts
from evalspark.sources.objects import silver_write
from evalspark.staging import stage


class Extraction(NamedTuple):
    failed: DataFrame
    counts: DataFrame


def run_extract(
    bronze: DataFrame, blocks: DataFrame, extractor: Extractor, silver_path: str, written: int,
    case_sensitive: bool = True, part_bytes: int = 16 << 20,
) -> Extraction:
    """Extract the PDFs of the bronze table by both methods and add their texts to the silver log.

    ``blocks`` is (dataset_split, file_name, pos, block_type, text, job_status); ``written``
    numbers the batch. Recognised texts are stored in parts of about ``part_bytes``. A document that fails is logged and reported with its error and does not
    stop the others.
    """
    keys = ["dataset_split", "file_name"]
    pdfs = bronze.where(is_pdf(F.col("file_name"), case_sensitive))
    pages = stage(extract_texts(pdfs, extractor), name="texts")
    read = pages.select(
        F.lit(PYMUPDF_METHOD).alias("method"), "dataset_split", F.col("file_name").alias("path"),
        F.lit(0).cast("long").alias("part"), "text", "error",
    )
    lines = concat_lines(blocks, keys, part_bytes=part_bytes).select(
        F.lit(TEXTRACT_METHOD).alias("method"), "dataset_split", F.col("file_name").alias("path"), "part", "text",
        F.lit(None).cast("string").alias("error"),
    )
    silver_write(read.unionByName(lines), silver_path, written)

    status = F.when(F.col("error").isNull(), "SUCCEEDED").otherwise("FAILED")
    jobs = blocks.select(*keys, "job_status").distinct()
    documents = pages.select(F.lit("pymupdf").alias("method"), status.alias("job_status")).unionByName(
        jobs.select(F.lit("textract").alias("method"), "job_status")
    )
    return Extraction(pages.where(F.col("error").isNotNull()).drop("text"), extract_counts(documents))
