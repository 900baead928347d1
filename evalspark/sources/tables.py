"""The questions, results and users tables on Parquet."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from evalspark import schemas
from evalspark.functions.cleaning import clean_string, coerce_int, coerce_int_reject
from evalspark.operators.shaping import default_column, flatten_struct, rename_columns
from evalspark.sources import versions


def read_raw(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw questions of all splits with the declared schema, so nothing is inferred from the data."""
    return spark.read.schema(schemas.RAW_QUESTIONS).format(fmt).load(path)


NUMBER_COLUMNS = ["Level", "Annotator_Metadata_Number_of_tools"]


def prepare_questions(raw: DataFrame, null_text: str = "None", created: Column | None = None) -> DataFrame:
    """Flatten, rename, default, clean, type and stamp raw questions; one narrow projection.

    ``number_reject`` names the columns whose number no int can hold; they are read as 0.
    """
    df = flatten_struct(raw, schemas.NESTED_COLUMN, schemas.NESTED_PREFIX)
    df = rename_columns(df, schemas.RAW_RENAMES)
    df = default_column(df, "result_status", schemas.NOT_ANSWERED)
    numbers = [name for name in NUMBER_COLUMNS if name in df.columns]
    reasons = [F.concat(F.lit(f"{name}: "), coerce_int_reject(F.col(name))) for name in numbers]
    columns = {name: clean_string(F.col(name), null_text) for name in schemas.QUESTION_TEXT_COLUMNS}
    columns |= {name: coerce_int(F.col(name)) for name in numbers}
    columns["number_reject"] = F.nullif(F.concat_ws("; ", *reasons), F.lit(""))
    return stamp_created(df.withColumns(columns), created)


def stamp_created(df: DataFrame, created: Column | None = None) -> DataFrame:
    """Add the load time at second resolution."""
    moment = F.current_timestamp() if created is None else created
    return df.withColumn("created_date", F.date_trunc("second", moment))


def load_split(
    spark: SparkSession, path: str, split: str, fmt: str = "json", null_text: str = "None",
    created: Column | None = None,
) -> DataFrame:
    """One cleaned split of the raw questions."""
    raw = read_raw(spark, path, fmt).where(F.col("dataset_split") == split)
    return prepare_questions(raw, null_text, created).drop("number_reject")


def table_split(split: str) -> str:
    """Split whose table serves a request: anything but 'validation' reads the test split."""
    return "validation" if split == "validation" else "test"


def scan_questions(questions: DataFrame, split: str) -> DataFrame:
    """All questions of a split; prunes to one partition directory."""
    return questions.where(F.col("dataset_split") == table_split(split))


def scan_user_results(results: DataFrame, user_id: str, split: str) -> DataFrame:
    """Results of one user in one split; both predicates reach the scan."""
    mine = results.where((F.col("user_id") == user_id) & (F.col("dataset_split") == split))
    return mine.select("user_id", "task_id", "user_result_status", "chatgpt_response")


QUESTIONS_TABLE = "questions"


def overwrite_table(df: DataFrame, path: str, splits: Sequence[str], partition: str = "dataset_split") -> versions.Version:
    """Publish a version of the table with the named splits replaced by their rows in ``df``; one without rows is emptied.

    Other splits stay as they are, and rows of other splits are not written. The rows are evaluated and written once.
    Until all of them are, readers see the version before, whole; a load that fails changes nothing.
    """
    spark = df.sparkSession
    base = versions.current(spark, path)
    written = versions.write_parts(df.where(F.col(partition).isin(list(splits))), path, QUESTIONS_TABLE, [partition])
    parts = [versions.part_name({partition: split}) for split in splits]
    return versions.publish(spark, path, base, {QUESTIONS_TABLE: {part: written.get(part) for part in parts}})


def read_table(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """Rows of a table that ``overwrite_table`` wrote, by default of its last version, or of a plain folder of Parquet files.

    The frame goes on reading its version whatever is published later.
    """
    numbers = versions.history(spark, path)
    if not numbers:
        return spark.read.schema(schema).parquet(path)
    snapshot = versions.read_version(spark, path, numbers[-1] if version is None else version)
    return versions.read(spark, path, snapshot, QUESTIONS_TABLE, schema)


def empty_tables(spark: SparkSession, users_path: str, results_path: str) -> None:
    """Recreate the users and results tables without rows."""
    for path, schema in ((users_path, schemas.USERS), (results_path, schemas.USER_RESULTS)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def json_records(df: DataFrame) -> DataFrame:
    """Every row as one JSON object; nulls are written out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
