"""Verdicts, statuses and the rules that decide what is sent to the model."""

from pyspark.sql import Column, functions as F

from evalspark.functions.files import file_extension
from evalspark.functions.text import is_blank, strip
from evalspark.schemas import ERROR_STATUS, NOT_ANSWERED

# Statuses after which an instructed attempt follows.
RETRY_STATUSES = [
    "Correct with Instruction",
    "Incorrect with Instruction",
    "Incorrect without Instruction",
]

# Error kinds a model function may report, and the texts they become.
CLIENT_ERRORS = ["authentication", "rate_limit", "connection"]
SERVICE_ERROR = "service"
SERVICE_ERROR_TEXT = "An error occurred while processing the request. Please try again later."
UNEXPECTED_ERROR_TEXT = "An unexpected error occurred. Please contact support."
JUDGE_UNAVAILABLE_TEXT = "Error: OpenAI service is currently unavailable."


def parse_verdict(verdict: Column, instructions: Column, strict: bool = False) -> Column:
    """Status for a judge's verdict; 'yes' wins over 'no'. ``strict`` matches whole words only."""
    text = F.lower(strip(verdict))
    if strict:
        yes, no = text.rlike(r"\byes\b"), text.rlike(r"\bno\b")
    else:
        yes, no = text.contains("yes"), text.contains("no")
    suffix = F.when(is_blank(instructions), F.lit(" without Instruction")).otherwise(F.lit(" with Instruction"))
    return (
        F.when(yes, F.concat(F.lit("Correct"), suffix))
        .when(no, F.concat(F.lit("Incorrect"), suffix))
        .otherwise(F.lit(ERROR_STATUS))
    )


def answer_error_text(kind: Column, message: Column) -> Column:
    """Text shown in place of an answer for an error kind; null when there was no error."""
    return (
        F.when(kind.isNull(), F.lit(None).cast("string"))
        .when(kind.isin(CLIENT_ERRORS), F.concat(F.lit("Error: "), F.coalesce(message, F.lit("None"))))
        .when(kind == SERVICE_ERROR, F.lit(SERVICE_ERROR_TEXT))
        .otherwise(F.lit(UNEXPECTED_ERROR_TEXT))
    )


def judge_error_status(kind: Column) -> Column:
    """Status recorded when the judge failed; null when it did not."""
    return (
        F.when(kind.isNull(), F.lit(None).cast("string"))
        .when(kind.isin(CLIENT_ERRORS), F.lit(JUDGE_UNAVAILABLE_TEXT))
        .otherwise(F.lit(ERROR_STATUS))
    )


def retry_candidate(status: Column) -> Column:
    return F.coalesce(status.isin(RETRY_STATUSES), F.lit(False))


def prefill_instructions(steps: Column) -> Column:
    return F.coalesce(steps, F.lit(""))


def instruction_policy(split: Column, status: Column, is_retry: Column, instructions: Column) -> Column:
    """Instructions that go with an attempt.

    The test split and instructed retries always pass them; a first validation attempt does so
    only after an incorrect one.
    """
    passes = (split == "test") | is_retry | status.startswith("Incorrect")
    return F.when(F.coalesce(passes, F.lit(False)), instructions)


def route_eligibility(file_name: Column, context: Column) -> Column:
    """'send', 'missing_text' (a PDF without extracted text) or 'unsupported' (any other file)."""
    extension = F.lower(file_extension(F.coalesce(file_name, F.lit(""))))
    return (
        F.when(extension == "", F.lit("send"))
        .when((extension == ".pdf") & ~is_blank(context), F.lit("send"))
        .when(extension == ".pdf", F.lit("missing_text"))
        .otherwise(F.lit("unsupported"))
    )


def is_correct(status: Column) -> Column:
    return F.lower(strip(status)).startswith("correct")


def fill_na(value: Column) -> Column:
    return F.coalesce(value, F.lit(NOT_ANSWERED))
