"""Attempts at whole question tables: judged ones, and ones reviewed by people."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from evalspark import schemas
from evalspark.functions.files import PYMUPDF_METHOD
from evalspark.functions.grading import (
    answer_error_text, instruction_policy, judge_error_status, parse_verdict, prefill_instructions,
    retry_candidate, route_eligibility,
)
from evalspark.functions.prompts import build_judge_prompt, build_prompt
from evalspark.functions.text import is_blank, truncate_answer
from evalspark.operators.inference import (
    ANSWER_SETTINGS, JUDGE_SETTINGS, REQUESTS, Budget, Model, ask_once, attach_answers,
)
from evalspark.operators.joins import LARGEST_TEXT, join_results, join_silver_text
from evalspark.operators.mutations import checked_updates, upsert_results
from evalspark.sources.tables import scan_questions, scan_user_results
from evalspark.staging import stage


class Evaluation(NamedTuple):
    """``attempts`` are all questions with their route, ``updates`` what was recorded."""

    attempts: DataFrame
    updates: DataFrame
    results: DataFrame


class Review(NamedTuple):
    """An ``Evaluation``, and the reviews that were not recorded, with the reason."""

    attempts: DataFrame
    updates: DataFrame
    results: DataFrame
    rejects: DataFrame


def plan_attempts(
    questions: DataFrame, results: DataFrame, silver: DataFrame, user_id: str, split: str,
    method: str = PYMUPDF_METHOD, largest_context: int | None = LARGEST_TEXT,
) -> DataFrame:
    """Every question of a split with its current status, route, instructions and prompt.

    A question answered before without success, or with instructions, is a retry: it takes the
    annotator's steps along and is sent whatever its attachment is. Any other is sent when its
    route allows. An attachment of more than ``largest_context`` bytes has the route ``too_large``
    and is not sent, retry or not.
    """
    mine = scan_user_results(results, user_id, split)
    joined = join_results(scan_questions(questions, split), mine, one_per_task=True)
    joined = join_silver_text(joined, silver, method, largest_context)
    status = F.col("user_result_status")
    is_retry = retry_candidate(status) & (F.col("dataset_split") == "validation")
    steps = prefill_instructions(F.col("Annotator_Metadata_Steps"))
    route = F.when(F.col("too_large"), "too_large").otherwise(
        route_eligibility(F.col("file_name"), F.col("context"))
    )
    sent = (is_retry | (route == "send")) & ~F.col("too_large")
    planned = joined.select(
        "task_id", "dataset_split", "Question", "FinalAnswer", "user_result_status", "context",
        is_retry.alias("is_retry"), route.alias("route"), sent.alias("sent"),
        instruction_policy(F.col("dataset_split"), status, is_retry, steps).alias("instructions"),
    )
    prompt = build_prompt(F.col("Question"), F.col("instructions"), F.col("context"))
    return planned.withColumn("prompt", F.when(F.col("sent"), prompt))


def answer_attempts(
    attempts: DataFrame, model: Model, answers_path: str | None = None, requests: int = REQUESTS, slices: int = 1,
    budget: Budget = Budget(),
) -> DataFrame:
    """Attempts with ``chatgpt_response``, or with ``error_text`` where the call failed.

    The attempts are staged, so that the prompts asked and the rows they go back to are the same
    whatever happens to the tables meanwhile; so is the result, because judging reads it twice.
    """
    attempts = stage(attempts.drop("context"), name="attempts")
    answers = ask_once(attempts, "prompt", model, ANSWER_SETTINGS, answers_path, requests, slices=slices, budget=budget)
    joined = attach_answers(attempts, "prompt", answers, ANSWER_SETTINGS)
    return stage(joined.withColumns({
        "chatgpt_response": truncate_answer(F.col("answer")),
        "error_text": answer_error_text(F.col("error_kind"), F.col("error_message")),
    }).drop("answer", "error_kind", "error_message"), name="answered")


def _has_response() -> Column:
    """An empty response counts as none: nothing is judged or recorded."""
    return ~is_blank(F.col("chatgpt_response"))


def judge_attempts(
    answered: DataFrame, judge: Model, verdicts_path: str | None = None, requests: int = REQUESTS,
    strict: bool = False, slices: int = 1, budget: Budget = Budget(),
) -> DataFrame:
    """Answered attempts with the ``status`` their verdict gives."""
    asked = answered.where(_has_response()).withColumn(
        "prompt", build_judge_prompt(F.col("Question"), F.col("FinalAnswer"), F.col("chatgpt_response"))
    )
    verdicts = ask_once(asked, "prompt", judge, JUDGE_SETTINGS, verdicts_path, requests, slices=slices, budget=budget)
    judged = attach_answers(asked, "prompt", verdicts, JUDGE_SETTINGS)
    status = F.coalesce(
        judge_error_status(F.col("error_kind")),
        parse_verdict(F.col("answer"), F.col("instructions"), strict),
    )
    return judged.withColumn("status", status).drop("answer", "error_kind", "error_message")


def run_evaluation(
    questions: DataFrame, results: DataFrame, silver: DataFrame, user_id: str, model: Model, judge: Model,
    seq: int, method: str = PYMUPDF_METHOD, split: str = "validation", keep_errors: bool = False,
    requests: int = REQUESTS, strict: bool = False, retries_only: bool = False,
    work_path: str | None = None, created: Column | None = None, slices: int = 1,
    largest_context: int | None = LARGEST_TEXT, budget: Budget = Budget(),
) -> Evaluation:
    """One attempt of a user at every question of a split, judged and recorded.

    With ``retries_only`` just the questions that an earlier attempt left for an instructed one.
    Failed calls are left out; with ``keep_errors`` their error texts are judged and recorded as
    if they were answers. ``seq`` orders this run among all updates. A run that is repeated with
    the same ``work_path`` goes on with the answers and verdicts it already has; ``slices`` says
    in how many steps they are written. ``budget`` holds for the model and for the judge.
    """
    answers_path, verdicts_path = work_path and f"{work_path}/answers", work_path and f"{work_path}/verdicts"
    attempts = plan_attempts(questions, results, silver, user_id, split, method, largest_context)
    if retries_only:
        attempts = attempts.where(F.col("is_retry"))
    answered = answer_attempts(attempts, model, answers_path, requests, slices, budget)
    if keep_errors:
        answered = answered.withColumn("chatgpt_response", F.coalesce("error_text", "chatgpt_response"))
    judged = judge_attempts(answered, judge, verdicts_path, requests, strict, slices, budget)
    updates = stage(judged.select(
        F.lit(user_id).alias("user_id"), "task_id", "status", "chatgpt_response", "dataset_split",
        F.lit(seq).cast("long").alias("seq"),
    ), name="updates")
    return Evaluation(answered, updates, upsert_results(results, updates, created))


def run_manual_review(
    questions: DataFrame, results: DataFrame, silver: DataFrame, user_id: str, model: Model, reviews: DataFrame,
    seq: int, method: str = PYMUPDF_METHOD, split: str = "test", requests: int = REQUESTS,
    work_path: str | None = None, created: Column | None = None, slices: int = 1,
    largest_context: int | None = LARGEST_TEXT, budget: Budget = Budget(),
) -> Review:
    """Answers for a split without reference answers, with the statuses reviewers gave them.

    ``reviews`` is (task_id, status), one per task. Answers without a review are not recorded.
    Reviews of no answer, and those with a status that is not an accepted one, come back as rejects.
    """
    attempts = plan_attempts(questions, results, silver, user_id, split, method, largest_context)
    answered = answer_attempts(attempts, model, work_path and f"{work_path}/answers", requests, slices, budget)
    reviewed = answered.where(_has_response()).join(reviews.select("task_id", "status"), "task_id")
    updates = reviewed.select(
        F.lit(user_id).alias("user_id"), "task_id", "status", "chatgpt_response", "dataset_split",
        F.lit(seq).cast("long").alias("seq"),
    )
    good, bad = checked_updates(updates, schemas.STATUSES)
    good = stage(good, name="updates")
    recorded = answered.where(_has_response()).select("task_id")
    unanswered = reviews.select("task_id", "status").join(recorded, "task_id", "left_anti")
    rejects = bad.select("task_id", "status", "reject_reason").unionByName(
        unanswered.withColumn("reject_reason", F.lit("no answer"))
    )
    return Review(answered, good, upsert_results(results, good, created), rejects)
