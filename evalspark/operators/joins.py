"""Joins of questions with results, attachments and extracted texts."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.functions.files import base_name, file_extension, method_folder
from evalspark.functions.grading import fill_na
from evalspark.functions.text import is_blank
from evalspark.operators.shaping import drop_conflicting
from evalspark.staging import stage

FILLED = ["user_result_status", "chatgpt_response"]


def key_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join on keys of equal name, in which null keys match each other.

    Adaptive execution splits a hot key only where both sides come straight from a shuffle made
    for the join. A side aggregated by the same key would be joined as it is; compared this way
    its few remaining keys are shuffled once more, and the hot key of the other side is split.
    """
    names = {key: f"_right_{key}" for key in on}
    same = reduce(Column.__and__, [F.col(key).eqNullSafe(F.col(name)) for key, name in names.items()])
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def left_join(left: DataFrame, right: DataFrame, on: Sequence[str], right_unique: bool = False) -> DataFrame:
    """LEFT ``key_join``; repeated right keys multiply rows.

    An outer join cannot split a hot key of its right side over tasks, an inner join can split
    both sides. Unless the right keys are unique the join is therefore the inner matches plus
    the left rows that have none among the distinct right keys. In a shuffled plan both read the
    same shuffle of the left side.
    """
    if right_unique:
        return key_join(left, right, on, "left")
    # Where the right side is broadcast the left side is read twice: stage one that is costly to compute.
    unmatched = key_join(left, right.select(*on).distinct(), on, "left_anti")
    return key_join(left, right, on, "inner").unionByName(unmatched, allowMissingColumns=True)


def join_results(
    questions: DataFrame, results: DataFrame, on: Sequence[str] = ("task_id",), one_per_task: bool = False
) -> DataFrame:
    """Questions with status and response, 'N/A' where there is no result.

    Pass ``one_per_task`` when the results are those of one user and split, whose tasks are unique.
    """
    joined = left_join(questions.drop(*FILLED), results.select(*on, *FILLED), on, one_per_task)
    return joined.withColumns({name: fill_na(F.col(name)) for name in FILLED})


def join_statuses(questions: DataFrame, results: DataFrame, on: Sequence[str] = ("task_id",)) -> DataFrame:
    """``join_results`` for counting: status only, with ``n``, the joined rows that each row stands for.

    Results are folded per key and status before the join, so a task answered very often brings
    one row per status.
    """
    folded = results.groupBy(*on, "user_result_status").agg(F.count("*").alias("n"))
    joined = key_join(questions.drop(*FILLED), folded, on, "left")
    return joined.withColumns({
        "user_result_status": fill_na(F.col("user_result_status")), "n": F.coalesce("n", F.lit(1)),
    })


def join_results_text_key(
    questions: DataFrame, results: DataFrame, on: Sequence[str] = ("task_id",), one_per_task: bool = False
) -> DataFrame:
    """Questions with status only; task ids are compared as text and a null one reads 'None'."""
    key = F.coalesce(F.col("task_id").cast("string"), F.lit("None"))
    left = drop_conflicting(questions).withColumn("task_id", key)
    right = results.withColumn("task_id", key).select(*on, "user_result_status")
    joined = left_join(left, right, on, one_per_task)
    return joined.withColumn("user_result_status", fill_na(F.col("user_result_status")))


def _spread(key: Column, usable: Column) -> Column:
    """Key of rows that can match; the others get a private one, so that they do not pile up in one task."""
    return F.when(usable, key).otherwise(F.concat(F.lit("/"), F.coalesce("task_id", F.lit(""))))


def join_attachments(questions: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``found``: whether the file named by a row exists in the listing of its split.

    A listing names every (dataset_split, file_name) once, so no row is multiplied.
    """
    listed = files.select(
        "dataset_split", F.col("file_name").alias("_key"), F.lit(True).alias("_listed")
    )
    keyed = questions.withColumn("_key", _spread(F.col("file_name"), ~is_blank(F.col("file_name"))))
    joined = key_join(keyed, listed, ["dataset_split", "_key"], "left")
    # A private key may equal a listed name, so only usable names count.
    found = F.coalesce("_listed", F.lit(False)) & ~is_blank(F.col("file_name"))
    return joined.select(*[F.col(f"`{name}`") for name in questions.columns], found.alias("found"))


# Longest text, in bytes, that is brought together in one cell unless a caller says otherwise.
LARGEST_TEXT = 64 << 20

# Rows that one copy of a document's text is joined to.
ROWS_PER_COPY = 100_000


def _ordered_text() -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("part", "text")))
    return F.array_join(F.transform(ordered, lambda x: x["text"]), "")


def _size() -> Column:
    return F.octet_length("text").cast("long")


def _too_large(parts: DataFrame, keys: Sequence[str], largest: int | None) -> DataFrame | None:
    """(keys, bytes) of the documents that have more bytes than ``largest``; None if there are none.

    Sizes are added up before any text moves, and what is found is written, so Spark knows its size.
    """
    if largest is None:
        return None
    sizes = parts.groupBy(*keys).agg(F.sum(_size()).alias("bytes"))
    found = stage(sizes.where(F.col("bytes") > largest), name="too_large")
    return None if found.isEmpty() else found


def join_parts(parts: DataFrame, keys: Sequence[str] = ("doc",), largest: int | None = LARGEST_TEXT) -> DataFrame:
    """One row per document as (keys, text, bytes), for readers that need the text in one cell, such as a prompt.

    A document of more than ``largest`` bytes keeps its row, with its size and a null text; its parts are left out
    before the others are shuffled, once, to be put in order.
    """
    over = _too_large(parts, keys, largest)
    kept = parts if over is None else key_join(parts, over, keys, "left_anti")
    whole = kept.groupBy(*keys).agg(_ordered_text().alias("text"), F.sum(_size()).alias("bytes"))
    if over is None:
        return whole
    return whole.unionByName(over.select(*keys, F.lit(None).cast("string").alias("text"), "bytes"))


def _exceptions(pieces: DataFrame, marked: DataFrame, largest: int | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Keys of texts that are too large, and keys that many rows want with the copies they take; None where there are none.

    Sizes and rows are counted in one job before any text moves. What is found is written, so Spark knows its size.
    """
    wanted = marked.where("_usable").groupBy("_key").agg(F.count("*").alias("rows"), F.lit(0).cast("long").alias("bytes"))
    if largest is not None:
        sizes = pieces.groupBy("_key").agg(F.lit(0).cast("long").alias("rows"), F.sum(_size()).alias("bytes"))
        wanted = wanted.where(F.col("rows") > ROWS_PER_COPY).unionByName(sizes.where(F.col("bytes") > largest))
    found = stage(wanted.where((F.col("rows") > ROWS_PER_COPY) | (F.col("bytes") > 0)), name="exceptions")
    if found.isEmpty():
        return None, None
    copies = F.ceil(F.col("rows") / ROWS_PER_COPY).cast("int")
    over, hot = found.where("bytes > 0").select("_key"), found.where("rows > 0").select("_key", copies.alias("_copies"))
    return None if over.isEmpty() else over, None if hot.isEmpty() else hot


def attach_texts(
    rows: DataFrame, parts: DataFrame, keys: Sequence[tuple[Column, Column]], usable: Column, name: str = "context",
    largest: int | None = LARGEST_TEXT,
) -> DataFrame:
    """Rows with the text of their document as ``name``, null without one; ``too_large`` marks those whose text is too long.

    ``keys`` pairs expressions over the rows with expressions over the parts of the documents; null keys match each
    other. Rows that are not ``usable`` match nothing and are spread. The parts of a document meet under the key
    of the join, so every text is shuffled once and stays where it is joined. A document that very many rows want is
    joined in as many copies as it takes for ``ROWS_PER_COPY`` rows each; the rows are dealt to them.
    """
    def one_key(columns: list[Column]) -> Column:
        # One column, so that the optimizer cannot take a part of the key out of the join but not out of the grouping.
        return F.concat_ws("\x1f", *[F.coalesce(column.cast("string"), F.lit("\x1e")) for column in columns])

    lone = F.concat(F.lit("/"), F.monotonically_increasing_id().cast("string"))
    marked = rows.withColumn("_usable", F.coalesce(usable, F.lit(False))).withColumn(
        "_key", F.when(F.col("_usable"), one_key([of_row for of_row, _ in keys])).otherwise(lone)
    )
    pieces = parts.select(one_key([of_part for _, of_part in keys]).alias("_key"), "part", "text")
    over, hot = _exceptions(pieces, marked, largest)
    on = ["_key"]
    if over is not None:
        pieces = pieces.join(over, "_key", "left_anti")
    if hot is not None:
        on = ["_key", "_copy"]
        last = F.coalesce("_copies", F.lit(1)) - 1
        pieces = pieces.join(hot, "_key", "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), last))).drop("_copies")
        dealt = F.pmod(F.monotonically_increasing_id(), last + 1).cast("int")
        marked = marked.join(hot, "_key", "left").withColumn("_copy", dealt).drop("_copies")
    texts = pieces.groupBy(*on).agg(_ordered_text().alias("_text"))
    joined = marked.join(texts, on, "left")
    if over is not None:
        joined = joined.join(over.withColumn("_over", F.lit(True)), "_key", "left")
    too_large = F.col("_usable") & (F.lit(False) if over is None else F.col("_over").isNotNull())
    return joined.select(
        *[F.col(f"`{column}`") for column in rows.columns],
        F.when(F.col("_usable"), F.col("_text")).alias(name), too_large.alias("too_large"),
    )


def join_silver_text(
    questions: DataFrame, silver: DataFrame, method: str, largest: int | None = LARGEST_TEXT
) -> DataFrame:
    """Add ``context``: the text extracted by a method from the PDF of a row, null without one.

    The silver table holds the parts of one text per (method, split, base name). A text of more than ``largest`` bytes
    is not brought together; ``too_large`` marks its rows.
    """
    name = F.col("file_name")
    keys = [(F.col("dataset_split"), F.col("dataset_split")), (base_name(name), F.col("base_name"))]
    parts = silver.where(F.col("method") == method_folder(F.lit(method)))
    return attach_texts(questions, parts, keys, F.lower(file_extension(name)) == ".pdf", largest=largest)
