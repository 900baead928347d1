"""Extraction of documents as they arrive."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from evalspark import schemas
from evalspark.functions.files import PYMUPDF_METHOD, base_name, is_pdf, method_folder
from evalspark.operators.documents import Extractor, extract_texts
from evalspark.operators.joins import key_join
from evalspark.sources.objects import newest_rows, qualified, read_silver_log, relative_name, silver_write
from evalspark.staging import stage
from evalspark.streaming.results import batch_number

_BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

def read_files(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Stream of the files below ``root/{split}/``, each read once."""
    folder = qualified(spark, f"{root.rstrip('/')}/{split}")
    files = (spark.readStream.schema(_BINARY_FILE).format("binaryFile")
             .option("recursiveFileLookup", "true").load(folder))
    return files.select(
        relative_name(F.col("path"), folder).alias("file_name"), "length", "content",
        F.lit(split).alias("dataset_split"),
    )


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Stream of the files landed in the bronze table; every landing adds files, so each is read once."""
    return spark.readStream.schema(schemas.BRONZE).parquet(path)


def _extracted_once(wanted: DataFrame, extractor: Extractor, log_path: str, method: str, number: int) -> DataFrame:
    """Log rows of a batch; texts come from the batches before ``number`` where these have the same bytes.

    Only names and digests meet in joins. The contents that are extracted are picked by name and stay where they are.
    """
    keys = ["dataset_split", "file_name"]
    log = read_silver_log(wanted.sparkSession, log_path).where(
        (F.col("written") < number) & F.col("error").isNull() & (F.col("method") == method_folder(F.lit(method)))
    )
    named = stage(wanted.select(*keys, F.sha2("content", 256).alias("digest")), name="landed")
    known = log.where(F.col("digest").isNotNull()).select("digest").distinct()
    fresh = key_join(named, known, ["digest"], "left_anti")
    first = fresh.groupBy("digest").agg(F.min(F.struct(*keys)).alias("f")).select("f.*", "digest")
    picked = key_join(wanted.withColumn("digest", F.sha2("content", 256)), first, [*keys, "digest"], "left_semi")
    # Two landings of one name may be in a batch with equal bytes.
    done = stage(extract_texts(picked, extractor, ["digest"]).dropDuplicates(["digest"]), name="texts")
    extracted = key_join(fresh.distinct(), done, ["digest"], "inner")
    newest = log.groupBy("dataset_split", "base_name").agg(F.max(F.struct("written", "path", "digest"))["digest"].alias("digest"))
    again = key_join(named, known, ["digest"], "left_semi").distinct().withColumn("base_name", base_name(F.col("file_name")))
    moved = key_join(again, newest, ["dataset_split", "base_name", "digest"], "left_anti").drop("base_name")
    texts = key_join(log, moved.select("digest").distinct(), ["digest"], "left_semi").select("digest", "text").dropDuplicates(["digest"])
    copied = key_join(moved, texts, ["digest"], "inner").withColumn("error", F.lit(None).cast("string"))
    return extracted.unionByName(copied).select(
        F.lit(method).alias("method"), "dataset_split", F.col("file_name").alias("path"), "text", "error", "digest"
    )


def stream_documents(
    files: DataFrame, extractor: Extractor, log_path: str, checkpoint: str, method: str = PYMUPDF_METHOD,
    pdf_only: bool = True, run: int = 0, once_per_content: bool = False,
) -> StreamingQuery:
    """Start a run that extracts the documents that have arrived since the last one into the silver log.

    Each batch has its own folder, so a replay rewrites it. ``run`` comes before the batch in the
    order of writing: give a higher one with a new checkpoint, whose batches count from 0 again.
    Failing documents are logged with their error beside the texts.

    With ``once_per_content`` the log tells by the digest of their bytes which documents have been extracted before, under
    whatever name and checkpoint: equal bytes are then extracted once, in a batch and over all batches, and a document
    that lands again as it was writes nothing. Failed ones are tried again. This costs a digest of every document and
    a read of the log's narrow columns for each batch; give it from the first run on, as older rows have no digest.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        wanted = batch.where(is_pdf(F.col("file_name"))) if pdf_only else batch
        if "written" in wanted.columns:
            # A batch that holds several landings of a file, as after a lost checkpoint, takes the last.
            wanted = newest_rows(wanted, ["dataset_split", "file_name"], "written")
        if once_per_content:
            silver_write(_extracted_once(wanted, extractor, log_path, method, batch_number(run, batch_id)), log_path, batch_number(run, batch_id))
            return
        done = extract_texts(wanted, extractor).select(
            F.lit(method).alias("method"), "dataset_split", F.col("file_name").alias("path"), "text", "error",
        )
        silver_write(done, log_path, batch_number(run, batch_id))

    return (files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
