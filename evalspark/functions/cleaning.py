"""Cleaning of loaded columns."""

from pyspark.sql import Column, functions as F

# A cast alone would also take texts such as '1d', and is slow on texts that are no numbers.
_SPACE = r"[ \t-\r]*"
_NUMBER = rf"^{_SPACE}[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?{_SPACE}\z"
_INFINITE = rf"(?i)^{_SPACE}[+-]?inf(?:inity)?{_SPACE}\z"


def clean_string(value: Column, null_text: str = "None") -> Column:
    """Text of a value; null becomes ``null_text`` and a value that is exactly '?' becomes empty."""
    text = F.coalesce(value.cast("string"), F.lit(null_text))
    return F.when(text == "?", F.lit("")).otherwise(text)


def _truncated(text: Column) -> Column:
    return text.try_cast("double").try_cast("int")


def coerce_int(value: Column) -> Column:
    """Number in a text, truncated toward zero; 0 for anything that is not one."""
    text = value.cast("string")
    return F.coalesce(F.when(text.rlike(_NUMBER), _truncated(text)), F.lit(0))


def coerce_int_reject(value: Column) -> Column:
    """Why a value cannot become an int although it is a number, else null."""
    text = value.cast("string")
    beyond = F.when(text.rlike(_NUMBER), _truncated(text).isNull()).otherwise(text.rlike(_INFINITE))
    return F.when(beyond, F.lit("number out of range"))
