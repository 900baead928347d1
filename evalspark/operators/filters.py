"""Row filters and accepted-value rules."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from evalspark.functions.files import file_type_bucket
from evalspark.functions.text import is_blank
from evalspark.schemas import NOT_ANSWERED


def filter_facets(
    df: DataFrame, levels: Sequence[int] = (), file_types: Sequence[str] = (), statuses: Sequence[str] = ()
) -> DataFrame:
    """Keep rows in every non-empty list. Choosing 'No File' finds the rows without a file."""
    if levels:
        df = df.where(F.col("Level").isin(list(levels)))
    if file_types:
        df = df.where(file_type_bucket(F.col("file_name")).isin(list(file_types)))
    if statuses:
        df = df.where(F.col("user_result_status").isin(list(statuses)))
    return df


def filter_answered(df: DataFrame) -> DataFrame:
    """Rows with any status but 'N/A'; 'Error' counts as answered."""
    return df.where(F.col("user_result_status") != NOT_ANSWERED)


def filter_has_file(df: DataFrame) -> DataFrame:
    return df.where(~is_blank(F.col("file_name")))


def filter_line_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("block_type") == "LINE")


def lookup_key(df: DataFrame, column: str, value: str) -> DataFrame:
    """At most one row with a key value."""
    return df.where(F.col(column) == value).limit(1)


def lookup_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Batch form of the lookup: every distinct requested key once, with its row or nulls."""
    return keys.select(column).distinct().join(df, column, "left")


def validate_domain(df: DataFrame, domains: dict[str, Sequence[str]]) -> DataFrame:
    """Add ``reject_reason``: the columns whose value is null or not an accepted one."""
    reasons = [
        F.when(~F.coalesce(F.col(name).isin(list(values)), F.lit(False)), F.lit(f"{name} not accepted"))
        for name, values in domains.items()
    ]
    return df.withColumn("reject_reason", F.nullif(F.concat_ws("; ", *reasons), F.lit("")))
