"""Projections: flattening, renaming, conforming and projecting."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from evalspark import schemas
from evalspark.functions.text import preview, utf16_length


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _leaves(schema: T.StructType, path: str, label: str):
    for field in schema.fields:
        inner_path, inner_label = f"{path}.{_quoted(field.name)}", f"{label}{field.name}"
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, inner_path, inner_label + ".")
        else:
            yield inner_path, inner_label


def flatten_struct(df: DataFrame, column: str, prefix: str, text_schema: T.StructType | None = None) -> DataFrame:
    """Replace a nested column by one prefixed column per leaf; deeper names are joined with '.'.

    With ``text_schema`` the column holds JSON text. A frame without the column is returned as is.
    """
    if column not in df.columns:
        return df
    if text_schema is not None:
        df = df.withColumn(column, F.from_json(F.col(_quoted(column)), text_schema))
    schema = df.schema[column].dataType
    kept = [F.col(_quoted(name)) for name in df.columns if name != column]
    flat = [F.col(path).alias(prefix + label) for path, label in _leaves(schema, _quoted(column), "")]
    return df.select(*kept, *flat)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def default_column(df: DataFrame, column: str, value: str) -> DataFrame:
    """Add a constant column unless it is already there."""
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def drop_conflicting(df: DataFrame, column: str = "user_result_status") -> DataFrame:
    return df.drop(column)


def conform_schema(
    df: DataFrame, schema: T.StructType, limits: dict[str, int], keep: Sequence[str] = ()
) -> DataFrame:
    """Target columns, order and types, plus ``reject_reason`` for rows that break a rule.

    A text over its limit and a value that its type cannot hold are rejected; a row may have
    several reasons. Absent columns become null. Names of both sides match without regard to
    case. Columns in ``keep`` pass through.
    """
    present = {name.lower(): name for name in df.columns}

    def source(field: T.StructField):
        name = present.get(field.name.lower())
        return F.lit(None) if name is None else F.col(_quoted(name))

    typed = [source(field).try_cast(field.dataType).alias(field.name) for field in schema.fields]
    reasons = []
    for field in schema.fields:
        value = source(field)
        if field.name in limits:
            too_long = utf16_length(value.cast("string")) > limits[field.name]
            reasons.append(F.when(too_long, F.lit(f"{field.name} too long")))
        if not isinstance(field.dataType, T.StringType):
            lost = value.isNotNull() & value.try_cast(field.dataType).isNull()
            reasons.append(F.when(lost, F.lit(f"{field.name} has a wrong type")))
        if not field.nullable:
            reasons.append(F.when(value.isNull(), F.lit(f"{field.name} missing")))
    reason = F.concat_ws("; ", *reasons) if reasons else F.lit("")
    return df.select(*typed, *keep, F.nullif(reason, F.lit("")).alias("reject_reason"))


def split_rejects(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with their reason."""
    good = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, tagged.where(F.col("reject_reason").isNotNull())


RESPONSE_FIELDS = [field for field in schemas.QUESTIONS.fields if field.name != "dataset_split"]


def project_response(questions: DataFrame) -> DataFrame:
    """The declared response fields; an absent optional one is null."""
    present = set(questions.columns)
    return questions.select(*[
        (F.col(field.name) if field.name in present else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in RESPONSE_FIELDS
    ])


def project_result(results: DataFrame) -> DataFrame:
    return results.select("user_id", "task_id", "user_result_status", "chatgpt_response")


def project_users(users: DataFrame) -> DataFrame:
    return users.select("user_id", "username", "role")


def question_preview(questions: DataFrame, width: int = 50) -> DataFrame:
    """Question, level and list label."""
    return questions.select("Question", "Level", preview(F.col("Question"), width).alias("label"))
