"""Feed of result updates, into a store or into a log.

Into a store of results (``stream_store``) every batch is applied as it comes, at the cost of the parts it touches.

Into a log (``stream_results``) a batch is folded to its latest update per key and written to its own folder, so its
cost follows the batch and not the table, and replaying it rewrites the same folder. The
current results are the base table with the log applied; compaction writes that as a new base.
Rows carry the seq that wrote them, so applying an old log again changes nothing.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from evalspark import schemas
from evalspark.operators.mutations import checked_updates, latest_updates, upsert_results
from evalspark.sources.results import apply_updates
from evalspark.staging import stage


_LOGGED = T.StructType(schemas.RESULT_UPDATES.fields + [T.StructField("batch", T.LongType())])


def read_updates(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Stream of update files, all that have arrived in one batch unless a number of files is given."""
    reader = spark.readStream.schema(schemas.RESULT_UPDATES).format(fmt)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def batch_number(run: int, batch_id: int) -> int:
    """Order of a batch among those of all runs; batches of a new checkpoint count from 0 again."""
    return run << 32 | batch_id


def write_batch(batch: DataFrame, number: int, log_path: str) -> None:
    """Log one batch. Updates outside the accepted splits go to a folder of their own."""
    good, bad = checked_updates(stage(batch, name="batch"))
    latest_updates(good).write.mode("overwrite").parquet(f"{log_path}/accepted/batch={number}")
    bad.write.mode("overwrite").parquet(f"{log_path}/rejected/batch={number}")


def stream_results(updates: DataFrame, log_path: str, checkpoint: str, run: int = 0) -> StreamingQuery:
    """Start a run over all updates that have arrived; the next one goes on from its checkpoint.

    Give a higher ``run`` with a new checkpoint, or its batches would replace the logged ones.
    """
    return (
        updates.writeStream.foreachBatch(
            lambda batch, batch_id: write_batch(batch, batch_number(run, batch_id), log_path)
        )
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_store(
    updates: DataFrame, root: str, checkpoint: str, run: int = 0, source: str = "feed", created: Column | None = None
) -> StreamingQuery:
    """Start a run that applies all updates that have arrived to a store of results, batch by batch.

    The store remembers the last batch of the source that it took, so a replayed one changes nothing. Updates outside
    the accepted splits go to a folder of their own, see ``read_rejected``.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, number = batch.sparkSession, batch_number(run, batch_id)
        good, bad = checked_updates(stage(batch, name="batch"))
        bad.write.mode("overwrite").parquet(f"{root}/rejected/batch={number}")
        apply_updates(spark, root, good, created, source, number)

    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, log_path: str, after: int = -1) -> DataFrame:
    """Logged updates; those of the batches up to ``after``, compacted before, are not read."""
    logged = spark.read.schema(_LOGGED).parquet(f"{log_path}/accepted")
    return logged.where(F.col("batch") > after).drop("batch")


def read_rejected(spark: SparkSession, log_path: str) -> DataFrame:
    """Updates that were not accepted, with the reason."""
    schema = T.StructType([*_LOGGED.fields, T.StructField("reject_reason", T.StringType())])
    return spark.read.schema(schema).parquet(f"{log_path}/rejected").drop("batch")


def current_results(base: DataFrame, log: DataFrame, created: Column | None = None) -> DataFrame:
    return upsert_results(base, log, created)


def compact(base: DataFrame, log: DataFrame, new_base_path: str, created: Column | None = None) -> DataFrame:
    """Write the current results as a new base, beside the one being read."""
    current_results(base, log, created).write.mode("overwrite").partitionBy("dataset_split").parquet(new_base_path)
    stored = base.sparkSession.read.schema(schemas.USER_RESULTS).parquet(new_base_path)
    return stored.select(*schemas.USER_RESULTS.fieldNames())
