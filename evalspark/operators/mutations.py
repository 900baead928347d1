"""Changes of the results and users tables. Each returns the new rows; the caller writes them
to a new place, never over the path being read."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from evalspark import schemas
from evalspark.operators.filters import validate_domain
from evalspark.operators.joins import key_join
from evalspark.operators.shaping import split_rejects
from evalspark.staging import stage

KEY = schemas.RESULT_KEY


def latest_updates(updates: DataFrame) -> DataFrame:
    """The update with the highest seq per key, folded before the shuffle; ties go by payload."""
    latest = F.max(F.struct("seq", "status", "chatgpt_response"))
    return updates.groupBy(*KEY).agg(latest.alias("u")).select(*KEY, "u.status", "u.chatgpt_response", "u.seq")


def is_fresh(stored_seq: Column, given_seq: Column) -> Column:
    """Whether an update changes a stored row: a row without a seq is older than any update."""
    return stored_seq.isNull() | (given_seq > stored_seq)


def _with_seq(target: DataFrame) -> DataFrame:
    return target if "seq" in target.columns else target.withColumn("seq", F.lit(None).cast("long"))


def _unknown(given: DataFrame, target: DataFrame) -> DataFrame:
    """Updates whose key the table does not have.

    The table's matching keys are found first, so what meets the updates is no larger than they
    are; of the table only the key columns are read.
    """
    matched = key_join(target.select(*KEY), given.select(*KEY), KEY, "left_semi").distinct()
    return key_join(given, matched, KEY, "left_anti")


def merge_match(target: DataFrame, updates: DataFrame) -> DataFrame:
    """What an upsert does with every key: 'update', 'stale', 'insert' or 'keep'. Null keys match each other."""
    given = stage(updates.groupBy(*KEY).agg(F.max("seq").alias("_seq")), name="given")
    fresh = F.when(is_fresh(F.col("seq"), F.col("_seq")), "update").otherwise("stale")
    marked = given.withColumn("_given", F.lit(True))
    known = key_join(_with_seq(target).select(*KEY, "seq"), marked, KEY, "left").select(
        *KEY, F.when(F.col("_given"), fresh).otherwise("keep").alias("action")
    )
    return known.unionByName(_unknown(given, target).select(*KEY, F.lit("insert").alias("action")))


# Columns that ``merged_results`` adds to those of the results.
BEFORE, CHANGE = "status_before", "change"


def merged_results(target: DataFrame, given: DataFrame, created: Column | None = None) -> DataFrame:
    """Stored results after written ``latest_updates``, with the status each had before and its change.

    The change is 'update' or 'insert', and null for a row that stays as it is.

    The updates join the table from the right, so Spark can broadcast a small batch; the table,
    with its responses, is then neither shuffled nor sorted.
    """
    moment = F.current_timestamp() if created is None else created
    renamed = given.withColumnsRenamed({"status": "_status", "chatgpt_response": "_response", "seq": "_seq"})
    joined = key_join(_with_seq(target), renamed.withColumn("_given", F.lit(True)), KEY, "left")
    fresh = F.col("_given").isNotNull() & is_fresh(F.col("seq"), F.col("_seq"))

    def new(name: str, old: str) -> Column:
        return F.when(fresh, F.col(name)).otherwise(F.col(old)).alias(old)

    kept = joined.select(
        *KEY, new("_status", "user_result_status"), new("_response", "chatgpt_response"), "created_date",
        new("_seq", "seq"), F.col("user_result_status").alias(BEFORE), F.when(fresh, "update").alias(CHANGE),
    )
    inserted = _unknown(given, target).select(
        *KEY, F.col("status").alias("user_result_status"), "chatgpt_response", moment.alias("created_date"), "seq",
        F.lit(None).cast("string").alias(BEFORE), F.lit("insert").alias(CHANGE),
    )
    return kept.unionByName(inserted)


def upsert_results(target: DataFrame, updates: DataFrame, created: Column | None = None) -> DataFrame:
    """Stored results after a batch of updates.

    A known key gets the new status and response and keeps its creation time, an unknown one is
    inserted. An update whose seq is not above the stored one is stale and changes nothing. Null
    keys match each other. The batch is folded once, and written.
    """
    given = stage(latest_updates(updates), name="given")
    return merged_results(target, given, created).drop(BEFORE, CHANGE)


def checked_updates(updates: DataFrame, statuses: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Updates with an accepted split (and status, if given), and the rejected ones."""
    domains = {"dataset_split": schemas.SPLITS}
    if statuses is not None:
        domains["status"] = statuses
    return split_rejects(validate_domain(updates, domains))


def cascade_anti(children: DataFrame, parents: DataFrame, key: str = "user_id") -> DataFrame:
    """Children whose parent is not in the frame of deleted parents; those without a parent stay."""
    deleted = parents.where(F.col(key).isNotNull()).select(key).distinct()
    return key_join(children, deleted, [key], "left_anti")


class Erasure(NamedTuple):
    users: DataFrame
    results: DataFrame
    unknown: DataFrame


def delete_cascade(users: DataFrame, results: DataFrame, ids: DataFrame) -> Erasure:
    """Remove users with their results. Ids that are no user remove nothing and are returned."""
    wanted = ids.select("user_id").distinct()
    known = wanted.join(users, "user_id", "left_semi")
    unknown = wanted.join(users, "user_id", "left_anti")
    return Erasure(cascade_anti(users, wanted), cascade_anti(results, known), unknown)


class Registration(NamedTuple):
    users: DataFrame
    rejected: DataFrame


def insert_if_absent(
    users: DataFrame, names: DataFrame, role: str = "user", new_id: Column | None = None
) -> Registration:
    """Users with the new usernames added, and the names that were taken.

    A name given twice is added once. Ids are random: write ``users`` once and read it back.
    """
    wanted = names.select("username").distinct()
    fresh = wanted.join(users, "username", "left_anti").select(
        (F.uuid() if new_id is None else new_id).alias("user_id"), "username", F.lit(role).alias("role")
    )
    return Registration(users.unionByName(fresh), wanted.join(users, "username", "left_semi"))


class RoleChange(NamedTuple):
    users: DataFrame
    unknown: DataFrame


def update_role(users: DataFrame, ids: DataFrame, role: str = "admin") -> RoleChange:
    """Users with the role set for the given ids, and the ids that are no user."""
    wanted = ids.select("user_id").distinct()
    marked = users.join(wanted.withColumn("_hit", F.lit(True)), "user_id", "left")
    new_role = F.when(F.col("_hit"), F.lit(role)).otherwise(F.col("role"))
    changed = marked.withColumn("role", new_role).drop("_hit")
    return RoleChange(changed, wanted.join(users, "user_id", "left_anti"))
