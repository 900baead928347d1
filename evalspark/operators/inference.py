"""Batched calls of a model function supplied by the caller."""

import json
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.functions.prompts import SYSTEM_PROMPT
from evalspark.operators.joins import key_join
from evalspark.staging import new_path, stage

# Request settings of the answering and the judging call.
ANSWER_SETTINGS = {
    "model": "gpt-3.5-turbo",
    "temperature": 0.2,
    "max_tokens": 300,
    "top_p": 0.9,
    "frequency_penalty": 0.5,
    "presence_penalty": 0.5,
    "system": SYSTEM_PROMPT,
}
JUDGE_SETTINGS = {"model": "gpt-3.5-turbo", "temperature": 0}

# Tasks that call the model unless the caller says otherwise.
REQUESTS = 32

# Bytes of prompts and their keys that one of these tasks is given at a time.
TASK_BYTES = 128 << 20
KEY_BYTES = 64

ANSWER_SCHEMA = "prompt_key string, answer string, error_kind string, error_message string"


class ModelError(Exception):
    """A failed request; kind is 'authentication', 'rate_limit', 'connection', 'service' or another."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(kind, message)
        self.kind, self.message = kind, message


# Takes prompts and settings, returns one answer or ModelError per prompt.
Model = Callable[[list[str], dict], list]


# Errors of the service itself, which the other prompts of a batch would meet as well.
OUTAGES = ("authentication", "rate_limit", "connection")


# Errors that pass, so that asking again later may help.
PASSING = ("rate_limit", "connection")


class Budget(NamedTuple):
    """What a run may ask of a model.

    ``prompts_per_second`` is the most that all tasks together ask, each its equal share; none by default. Prompts whose
    call met a passing error are asked again up to ``retries`` times, after a wait that doubles from ``first_wait`` seconds
    to ``longest_wait``, so a batch waits a bounded time. What still fails is left to a rerun.
    """

    prompts_per_second: float | None = None
    retries: int = 0
    first_wait: float = 1.0
    longest_wait: float = 60.0

    def wait(self, attempt: int, share: float) -> float:
        """Seconds before a retry; ``share`` (0 to 1) differs from task to task, so that they do not return together."""
        return min(self.longest_wait, self.first_wait * 2.0 ** attempt) * (0.5 + share / 2)


class _Pace:
    """Calls a model no faster than one task's share of a budget allows."""

    def __init__(self, model: Model, prompts_per_second: float | None):
        self.model, self.gap, self.free_at = model, 1 / prompts_per_second if prompts_per_second else 0.0, 0.0

    def __call__(self, prompts: list[str], settings: dict) -> list:
        now = time.monotonic()
        if now < self.free_at:
            time.sleep(self.free_at - now)
        self.free_at = max(now, self.free_at) + self.gap * len(prompts)
        return self.model(prompts, settings)


def _ask_within(model: Model, prompts: list[str], settings: dict, budget: Budget, share: float) -> list:
    """``_ask``, and again for the prompts that met a passing error, as often as the budget says."""
    replies = _ask(model, prompts, settings)
    for attempt in range(budget.retries):
        again = [i for i, reply in enumerate(replies) if isinstance(reply, ModelError) and reply.kind in PASSING]
        if not again:
            break
        time.sleep(budget.wait(attempt, share))
        for i, reply in zip(again, _ask(model, [prompts[i] for i in again], settings)):
            replies[i] = reply
    return replies


def _ask(model: Model, prompts: list[str], settings: dict) -> list:
    """One text or ModelError per prompt.

    An outage is the answer to the whole batch and is left to the budget or a rerun. After any other failure
    the batch is asked again by halves, so that one bad prompt costs few calls.
    """
    try:
        replies = list(model(prompts, settings))
        if len(replies) != len(prompts):
            raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
    except Exception as error:
        if isinstance(error, ModelError) and error.kind in OUTAGES:
            return [error] * len(prompts)
        if len(prompts) > 1:
            half = len(prompts) // 2
            return _ask(model, prompts[:half], settings) + _ask(model, prompts[half:], settings)
        return [error if isinstance(error, ModelError) else ModelError("unexpected", str(error))]
    return [
        reply if isinstance(reply, str | ModelError) else ModelError("unexpected", f"reply of type {type(reply).__name__}")
        for reply in replies
    ]


def prompt_key(prompt: Column, settings: dict) -> Column:
    """Identity of a request: equal prompts with equal settings are asked once."""
    return F.sha2(F.concat(F.lit(json.dumps(settings, sort_keys=True) + "\n"), prompt), 256)


def distinct_prompts(df: DataFrame, prompt: str, settings: dict, done: DataFrame | None = None) -> DataFrame:
    """(prompt_key, prompt) of the prompts of a column, without those answered in ``done``."""
    asked = (
        df.select(prompt_key(F.col(prompt), settings).alias("prompt_key"), F.col(prompt).alias("prompt"))
        .where(F.col("prompt").isNotNull()).dropDuplicates(["prompt_key"])
    )
    if done is None:
        return asked
    return asked.join(done.where(F.col("error_kind").isNull()).select("prompt_key"), "prompt_key", "left_anti")


def call_model(
    asked: DataFrame, model: Model, settings: dict = ANSWER_SETTINGS, requests: int = REQUESTS, batch_size: int = 64,
    budget: Budget = Budget(),
) -> DataFrame:
    """Answers of (prompt_key, prompt) rows, asked by exactly ``requests`` tasks within a budget.

    The rows are dealt by a hash of the key's hash with a stated number of partitions: an
    exchange on the key alone would be dropped where the rows lie by key already, and one
    without a number would be merged by adaptive execution, as prompts are small and calls slow.
    """
    rate = budget.prompts_per_second and budget.prompts_per_second / requests

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paced = _Pace(model, rate)
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                rows = batch.iloc[start:start + batch_size]
                share = int(rows["prompt_key"].iloc[0][:8], 16) / 2**32
                replies = _ask_within(paced, list(rows["prompt"]), settings, budget, share)
                failed = [isinstance(reply, ModelError) for reply in replies]
                yield pd.DataFrame({
                    "prompt_key": list(rows["prompt_key"]),
                    "answer": [None if bad else reply for reply, bad in zip(replies, failed)],
                    "error_kind": [reply.kind if bad else None for reply, bad in zip(replies, failed)],
                    "error_message": [reply.message if bad else None for reply, bad in zip(replies, failed)],
                })

    return asked.repartition(requests, F.xxhash64("prompt_key")).mapInPandas(run, ANSWER_SCHEMA)


def batch_infer(
    df: DataFrame, prompt: str, model: Model, settings: dict = ANSWER_SETTINGS, requests: int = REQUESTS,
    batch_size: int = 64, done: DataFrame | None = None, budget: Budget = Budget(),
) -> DataFrame:
    """Answers of the distinct prompts of a column, keyed by ``prompt_key``.

    ``requests`` is the number of tasks that call the model. Prompts already answered in ``done``
    are skipped. A task that is retried asks again: write the result before use, and let the
    model function tolerate repeats.

    Where the column holds more than ``TASK_BYTES`` for each task, the prompts are written and asked at once, in rounds
    of ``requests`` tasks each, one after the other; the answers that come back are then written ones. Reads the column
    once more to learn its size.
    """
    asked = distinct_prompts(df, prompt, settings, done)
    held = df.agg(F.sum(F.octet_length(F.col(prompt)).cast("long") + KEY_BYTES)).first()[0] or 0
    rounds = -(-held // (requests * TASK_BYTES))
    if rounds <= 1:
        return call_model(asked, model, settings, requests, batch_size, budget)
    spark, prompts, answers = df.sparkSession, new_path(df.sparkSession, "prompts"), new_path(df.sparkSession, "answers")
    number = F.pmod(F.xxhash64(F.lit("round"), "prompt_key"), F.lit(rounds)).cast("int")
    asked.withColumn("round", number).write.partitionBy("round").parquet(prompts)
    stored = spark.read.schema("prompt_key string, prompt string, round int").parquet(prompts)
    for one in range(rounds):
        part = stored.where(F.col("round") == one).drop("round")
        call_model(part, model, settings, requests, batch_size, budget).write.mode("append").parquet(answers)
    return spark.read.schema(ANSWER_SCHEMA).parquet(answers)


def batch_judge(df: DataFrame, prompt: str, model: Model, **options) -> DataFrame:
    """``batch_infer`` with the settings of the judging call."""
    return batch_infer(df, prompt, model, JUDGE_SETTINGS, **options)


def ask_once(
    df: DataFrame, prompt: str, model: Model, settings: dict = ANSWER_SETTINGS, path: str | None = None,
    requests: int = REQUESTS, batch_size: int = 64, slices: int = 1, budget: Budget = Budget(),
) -> DataFrame:
    """Written answers of the prompts of a column, one row per ``prompt_key``.

    Answers are written before use, so later steps never ask again. With a ``path`` they are
    added to the answers of earlier runs found there, whose prompts are not asked a second time;
    failed ones are. A success wins over a failure. The prompts are asked in ``slices`` of the
    key space, each written before the next begins: a run that dies loses one slice at most.
    """
    spark = df.sparkSession
    if path is None:
        path, done = new_path(spark, "answers"), None
    else:
        done = _written_answers(spark, path)
    asked = distinct_prompts(df, prompt, settings, done)
    if slices > 1:
        asked = stage(asked.withColumn("slice", F.pmod(F.xxhash64("prompt_key"), F.lit(slices))), name="prompts")
    for number in range(slices):
        part = asked.where(F.col("slice") == number).drop("slice") if slices > 1 else asked
        call_model(part, model, settings, requests, batch_size, budget).write.mode("append").parquet(path)
    reply = F.struct("answer", "error_kind", "error_message")
    best = F.max_by(reply, F.struct(F.col("error_kind").isNull(), "answer", "error_kind", "error_message"))
    answers = spark.read.schema(ANSWER_SCHEMA).parquet(path)
    return answers.groupBy("prompt_key").agg(best.alias("r")).select("prompt_key", "r.*")


def _written_answers(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(ANSWER_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def attach_answers(df: DataFrame, prompt: str, answers: DataFrame, settings: dict = ANSWER_SETTINGS) -> DataFrame:
    """Rows with the answer, error kind and error message of their prompt; the prompt is dropped.

    Answer keys are unique, so a prompt shared by many rows makes only the left side hot. Rows
    without a prompt get keys of their own, so that they do not meet in one task.
    """
    rest = [F.col(f"`{name}`") for name in df.columns if name != prompt]
    key = F.coalesce(prompt_key(F.col(prompt), settings), F.concat(F.lit("/"), F.xxhash64(*rest)))
    keyed = df.select(*rest, key.alias("prompt_key"))
    return key_join(keyed, answers, ["prompt_key"], "left").drop("prompt_key")
