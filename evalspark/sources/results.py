"""The results as a store of versions, changed by copying the parts that a batch touches.

A result lies in the part of its user's and its task's bucket. A batch reads and writes only the parts its keys fall
in and publishes them with the others, which stay where they are, so its cost follows the batch; a user with very many
results is spread over the task buckets. The number of results per user, split and status is kept beside them: every
change takes one from the status before and adds one to the status after. Both are published in one version.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from evalspark import schemas
from evalspark.operators.joins import key_join
from evalspark.operators.mutations import BEFORE, CHANGE, latest_updates, merged_results
from evalspark.sources import versions
from evalspark.sources.versions import Version, part_name, publish, write_parts
from evalspark.staging import stage

RESULTS, COUNTS = "results", "counts"
PARTED_BY = {RESULTS: ["user_bucket", "task_bucket"], COUNTS: ["user_bucket"]}
COUNTED = ["user_id", "dataset_split", "user_result_status"]

# User and task buckets of a store unless it is made with others.
BUCKETS = (64, 8)

KEPT_COUNTS = T.StructType([T.StructField(name, T.StringType()) for name in COUNTED] + [T.StructField("n", T.LongType())])
# Beside a result its files hold how the last batch that wrote them changed it.
_STORED = T.StructType([
    *schemas.USER_RESULTS.fields, T.StructField(BEFORE, T.StringType()), T.StructField(CHANGE, T.StringType()),
])


def user_bucket(user_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(user_id), F.lit(buckets)).cast("int")


def _bucketed(df: DataFrame, buckets: tuple[int, int]) -> DataFrame:
    users, tasks = buckets
    task = F.pmod(F.xxhash64("task_id", "dataset_split"), F.lit(tasks)).cast("int")
    return df.withColumns({"user_bucket": user_bucket(F.col("user_id"), users), "task_bucket": task})


def _recounted(results: DataFrame, users: int) -> DataFrame:
    counts = results.groupBy(*COUNTED).agg(F.count("*").alias("n"))
    return counts.withColumn("user_bucket", user_bucket(F.col("user_id"), users))


def _buckets(base: Version) -> tuple[int, int]:
    return tuple(base.notes["buckets"])


def create_results(results: DataFrame, root: str, buckets: tuple[int, int] = BUCKETS) -> Version:
    """Publish results as the first or next version of a store, in place of all it had, and count them."""
    spark = results.sparkSession
    base = versions.current(spark, root)
    conformed = results.select(*[
        F.col(field.name).cast(field.dataType) if field.name in results.columns else F.lit(None).cast(field.dataType).alias(field.name)
        for field in schemas.USER_RESULTS
    ])
    rows = conformed.withColumns({name: F.lit(None).cast("string") for name in (BEFORE, CHANGE)})
    written = write_parts(_bucketed(rows, buckets), root, RESULTS, PARTED_BY[RESULTS])
    fresh = Version(base.number, {RESULTS: written}, {"buckets": list(buckets)})
    counts = _recounted(versions.read(spark, root, fresh, RESULTS, schemas.USER_RESULTS), buckets[0])
    counted = write_parts(counts, root, COUNTS, PARTED_BY[COUNTS])
    return publish(spark, root, Version(base.number, {}, base.notes), {RESULTS: written, COUNTS: counted}, fresh.notes)


def read_results(spark: SparkSession, root: str, version: Version | None = None) -> DataFrame:
    """All results as of a version, by default the last one."""
    version = versions.current(spark, root) if version is None else version
    return versions.read(spark, root, version, RESULTS, schemas.USER_RESULTS)


def read_counts(spark: SparkSession, root: str, version: Version | None = None) -> DataFrame:
    """(user_id, dataset_split, user_result_status, n), as kept: no result is read."""
    version = versions.current(spark, root) if version is None else version
    return versions.read(spark, root, version, COUNTS, KEPT_COUNTS)


def read_user(spark: SparkSession, root: str, user_id: str, version: Version | None = None) -> tuple[DataFrame, DataFrame]:
    """Results and counts of one user, from the parts of that user's bucket alone."""
    version = versions.current(spark, root) if version is None else version
    users, tasks = _buckets(version)
    bucket = spark.range(1).select(user_bucket(F.lit(user_id), users)).first()[0]
    parts = {
        RESULTS: [part_name({"user_bucket": bucket, "task_bucket": task}) for task in range(tasks)],
        COUNTS: [part_name({"user_bucket": bucket})],
    }
    found = [
        versions.read(spark, root, version, table, schema, parts[table]).where(F.col("user_id") == user_id)
        for table, schema in ((RESULTS, schemas.USER_RESULTS), (COUNTS, KEPT_COUNTS))
    ]
    return found[0], found[1]


def _touched(rows: DataFrame) -> dict[str, list[str]]:
    """Names of the parts that some rows fall in; there are as many as buckets at most."""
    pairs = rows.select(*PARTED_BY[RESULTS]).distinct().collect()
    return {table: sorted({part_name({name: row[name] for name in by}) for row in pairs}) for table, by in PARTED_BY.items()}


def _counts_after(spark: SparkSession, root: str, base: Version, parts: list[str], deltas: DataFrame) -> DataFrame:
    """Kept counts of some parts with signed changes folded in; those that come to nothing are dropped."""
    kept = versions.read(spark, root, base, COUNTS, KEPT_COUNTS, parts)
    summed = kept.unionByName(deltas).groupBy(*COUNTED).agg(F.sum("n").alias("n")).where(F.col("n") != 0)
    return summed.withColumn("user_bucket", user_bucket(F.col("user_id"), _buckets(base)[0]))


def _replaced(written: dict[str, str], parts: list[str]) -> dict[str, str | None]:
    return {part: written.get(part) for part in parts}


def apply_updates(
    spark: SparkSession, root: str, updates: DataFrame, created: Column | None = None, source: str | None = None,
    batch: int | None = None,
) -> Version:
    """Publish the store after a batch of updates, as ``upsert_results`` gives it; returns the version.

    With a ``source`` its batches are numbered upwards; one that is not above the last one applied is a replay and
    changes nothing. Raises ``versions.Conflict`` if another change came first; apply the batch again then.
    """
    base = versions.current(spark, root)
    if source is not None and batch <= base.notes.get("applied", {}).get(source, -1):
        return base
    applied = {**base.notes.get("applied", {}), **({source: batch} if source is not None else {})}
    buckets = _buckets(base)
    given = stage(_bucketed(latest_updates(updates), buckets), name="given")
    touched = _touched(given)
    if not touched[RESULTS]:
        return publish(spark, root, base, {}, {"applied": applied})
    target = versions.read(spark, root, base, RESULTS, schemas.USER_RESULTS, touched[RESULTS])
    merged = merged_results(target, given.drop(*PARTED_BY[RESULTS]), created)
    written = write_parts(_bucketed(merged, buckets), root, RESULTS, PARTED_BY[RESULTS])
    # The rows just written say what changed, so the merge is not evaluated again.
    changed = versions.read(spark, root, Version(0, {RESULTS: written}, {}), RESULTS, _STORED).where(F.col(CHANGE).isNotNull())
    after = changed.select(*COUNTED, F.lit(1).cast("long").alias("n"))
    before = changed.where(F.col(CHANGE) == "update").select(
        "user_id", "dataset_split", F.col(BEFORE).alias("user_result_status"), F.lit(-1).cast("long").alias("n")
    )
    counts = _counts_after(spark, root, base, touched[COUNTS], after.unionByName(before))
    counted = write_parts(counts, root, COUNTS, PARTED_BY[COUNTS])
    changes = {RESULTS: _replaced(written, touched[RESULTS]), COUNTS: _replaced(counted, touched[COUNTS])}
    return publish(spark, root, base, changes, {"applied": applied})


class Erased(NamedTuple):
    """``removed`` is (user_id, results), the proof of what is gone; ``unknown`` are ids without a result."""

    version: Version
    removed: DataFrame
    unknown: DataFrame


def erase_users(spark: SparkSession, root: str, ids: DataFrame) -> Erased:
    """Publish the store without the results and counts of some users. Only parts of their buckets are read and written.

    Earlier versions still hold them: ``versions.remove_unused`` with one version kept deletes the files.
    """
    base = versions.current(spark, root)
    users, tasks = _buckets(base)
    wanted = stage(ids.select("user_id").where(F.col("user_id").isNotNull()).distinct(), name="ids")
    buckets = [row[0] for row in wanted.select(user_bucket(F.col("user_id"), users)).distinct().collect()]
    parts = {
        RESULTS: [part_name({"user_bucket": bucket, "task_bucket": task}) for bucket in buckets for task in range(tasks)],
        COUNTS: [part_name({"user_bucket": bucket}) for bucket in buckets],
    }
    old = {
        table: versions.read(spark, root, base, table, schema, parts[table])
        for table, schema in ((RESULTS, _STORED), (COUNTS, KEPT_COUNTS))
    }
    mine = key_join(old[COUNTS], wanted, ["user_id"], "left_semi")
    removed = stage(mine.groupBy("user_id").agg(F.sum("n").alias("results")), name="removed")
    rows = _bucketed(key_join(old[RESULTS], wanted, ["user_id"], "left_anti"), (users, tasks))
    counts = key_join(old[COUNTS], wanted, ["user_id"], "left_anti")
    written = write_parts(rows, root, RESULTS, PARTED_BY[RESULTS])
    counted = write_parts(counts.withColumn("user_bucket", user_bucket(F.col("user_id"), users)), root, COUNTS, PARTED_BY[COUNTS])
    version = publish(spark, root, base, {RESULTS: _replaced(written, parts[RESULTS]), COUNTS: _replaced(counted, parts[COUNTS])})
    return Erased(version, removed, key_join(wanted, removed, ["user_id"], "left_anti"))
