"""Browsing and summarising questions with their results."""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from evalspark.operators.aggregates import STATUS, facet_values, status_counts, status_totals
from evalspark.operators.filters import filter_answered, filter_facets
from evalspark.operators.joins import FILLED, join_results, join_results_text_key, key_join
from evalspark.operators.paging import clamp_page, page_slice
from evalspark.schemas import SPLITS
from evalspark.sources.tables import scan_questions, scan_user_results
from evalspark.staging import stage

# Task ids are unique within a split; the rest settles the order should they ever repeat.
BROWSE_ORDER = ["task_id", STATUS, "chatgpt_response"]
VIEWED = ["task_id", STATUS, "chatgpt_response", "Level", "file_name"]


class Browse(NamedTuple):
    rows: DataFrame
    facets: DataFrame
    page: int
    total: int


def run_browse(
    questions: DataFrame, results: DataFrame, user_id: str, split: str, levels: Sequence[int] = (),
    file_types: Sequence[str] = (), statuses: Sequence[str] = (), page: int = 0,
) -> Browse:
    """One page of a user's view of a split. Only the row count comes to the driver.

    The joined rows without their long texts are staged once; count, facets and page read them,
    and the texts are looked up for the page alone.
    """
    asked = scan_questions(questions, split)
    mine = scan_user_results(results, user_id, split)
    joined = join_results(asked.select("task_id", "Level", "file_name"), mine, one_per_task=True)
    narrow = stage(joined.select(*VIEWED), name="browse")
    shown = filter_facets(narrow, levels, file_types, statuses)
    total = shown.count()
    page = clamp_page(page, total)
    rows = stage(page_slice(shown, page, VIEWED), name="page")
    # A page has a fixed number of rows.
    texts = asked.drop(*FILLED).join(F.broadcast(rows.select("task_id").distinct()), "task_id", "left_semi")
    whole = key_join(texts, rows, ["task_id", "Level", "file_name"], "inner")
    return Browse(whole.orderBy(*BROWSE_ORDER), facet_values(narrow), page, total)


class Summary(NamedTuple):
    counts: DataFrame
    totals: DataFrame


def run_summary(questions: DataFrame, results: DataFrame, user_id: str, split: str) -> Summary:
    """Counts per status and totals of one user in one split."""
    mine = scan_user_results(results, user_id, split)
    joined = join_results_text_key(scan_questions(questions, split), mine, one_per_task=True)
    return Summary(status_counts(joined), status_totals(joined))


def run_summary_all(questions: DataFrame, results: DataFrame) -> Summary:
    """The same for every user and split at once.

    No user meets every question: answered ones come from the inner join, which Spark can split
    on a hot task, and the size of each split is added as a constant of that split.
    """
    key = F.coalesce(F.col("task_id").cast("string"), F.lit("None"))
    asked = questions.select("dataset_split", key.alias("task_id"))
    given = filter_answered(results).select("user_id", "dataset_split", key.alias("task_id"), STATUS)
    per_status = given.join(asked, ["dataset_split", "task_id"]).groupBy("user_id", "dataset_split", STATUS).agg(
        F.count("*").alias("n")
    )
    # At most one row per accepted split.
    sizes = asked.where(F.col("dataset_split").isin(SPLITS)).groupBy("dataset_split").agg(F.count("*").alias("total"))
    users = results.select("user_id", "dataset_split").distinct().join(F.broadcast(sizes), "dataset_split")
    answered = per_status.groupBy("user_id", "dataset_split").agg(F.sum("n").alias("answered"))
    totals = users.join(answered, ["user_id", "dataset_split"], "left").select(
        "user_id", "dataset_split", "total",
        F.coalesce("answered", F.lit(0)).alias("answered"),
        (F.col("total") - F.coalesce("answered", F.lit(0))).alias("unanswered"),
    )
    return Summary(per_status.orderBy("user_id", "dataset_split", F.desc("n"), STATUS), totals)
