"""Table schemas, length limits and accepted values."""

from pyspark.sql import types as T

# Accepted splits and statuses.
SPLITS = ["test", "validation"]
STATUSES = [
    "Correct with Instruction",
    "Correct without Instruction",
    "Incorrect with Instruction",
    "Incorrect without Instruction",
]
NOT_ANSWERED = "N/A"
ERROR_STATUS = "Error"

QUESTIONS = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("Question", T.StringType()),
    T.StructField("Level", T.IntegerType()),
    T.StructField("FinalAnswer", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("Annotator_Metadata_Steps", T.StringType()),
    T.StructField("Annotator_Metadata_Number_of_steps", T.StringType()),
    T.StructField("Annotator_Metadata_How_long_did_this_take", T.StringType()),
    T.StructField("Annotator_Metadata_Tools", T.StringType()),
    T.StructField("Annotator_Metadata_Number_of_tools", T.IntegerType()),
    T.StructField("result_status", T.StringType()),
    T.StructField("created_date", T.TimestampType()),
    T.StructField("dataset_split", T.StringType()),
])

# Longest value, in UTF-16 code units, of each bounded text column.
QUESTION_LIMITS = {
    "task_id": 50,
    "file_name": 255,
    "Annotator_Metadata_How_long_did_this_take": 100,
    "result_status": 50,
}

# Columns cleaned as text when a split is loaded.
QUESTION_TEXT_COLUMNS = [
    field.name for field in QUESTIONS if isinstance(field.dataType, T.StringType) and field.name != "dataset_split"
]

NESTED_COLUMN = "Annotator Metadata"
NESTED_PREFIX = "Annotator_Metadata_"
# Names as they arrive and as they are stored.
RAW_RENAMES = {
    "Final answer": "FinalAnswer",
    "Annotator_Metadata_Number of steps": "Annotator_Metadata_Number_of_steps",
    "Annotator_Metadata_How long did this take?": "Annotator_Metadata_How_long_did_this_take",
    "Annotator_Metadata_Number of tools": "Annotator_Metadata_Number_of_tools",
}

_METADATA = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("Steps", "Number of steps", "How long did this take?", "Tools", "Number of tools")
])

RAW_QUESTIONS = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("Question", T.StringType()),
    T.StructField("Level", T.StringType()),
    T.StructField("Final answer", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField(NESTED_COLUMN, _METADATA),
    T.StructField("dataset_split", T.StringType()),
])

RESULT_KEY = ["user_id", "task_id", "dataset_split"]

# seq is the order number of the update that wrote the row; a lower one never overwrites it.
USER_RESULTS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("dataset_split", T.StringType()),
    T.StructField("user_result_status", T.StringType()),
    T.StructField("chatgpt_response", T.StringType()),
    T.StructField("created_date", T.TimestampType()),
    T.StructField("seq", T.LongType()),
])

RESULT_LIMITS = {"user_id": 50, "task_id": 50, "dataset_split": 50, "user_result_status": 50}

RESULT_UPDATES = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("chatgpt_response", T.StringType()),
    T.StructField("dataset_split", T.StringType()),
    T.StructField("seq", T.LongType()),
])

USERS = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("username", T.StringType()),
    T.StructField("role", T.StringType(), False),
])

USER_LIMITS = {"user_id": 50, "username": 100, "role": 20}

BLOCKS = T.StructType([
    T.StructField("doc", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("block_type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("job_status", T.StringType()),
])

BRONZE = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("written", T.LongType()),
    T.StructField("dataset_split", T.StringType()),
])

# The parts of a document's text in order make up the text; most documents have part 0 only.
SILVER = T.StructType([
    T.StructField("method", T.StringType()),
    T.StructField("dataset_split", T.StringType()),
    T.StructField("base_name", T.StringType()),
    T.StructField("part", T.LongType()),
    T.StructField("text", T.StringType()),
])

# ``written`` numbers the batches; a failed document has an error and no text. ``digest`` is that of the bytes a text
# was extracted from, where the writer gave it.
SILVER_LOG = T.StructType([
    T.StructField("method", T.StringType()),
    T.StructField("dataset_split", T.StringType()),
    T.StructField("base_name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("part", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("digest", T.StringType()),
    T.StructField("written", T.LongType()),
])
