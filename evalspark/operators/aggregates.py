"""Counts, totals, facets, summaries and ordered concatenation."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalspark import schemas
from evalspark.functions.files import file_extension, file_type_bucket
from evalspark.functions.text import is_blank
from evalspark.operators.filters import filter_answered
from evalspark.operators.joins import key_join
from evalspark.staging import stage

STATUS = "user_result_status"

def _rows(weight: str | None, condition: Column | None = None) -> Column:
    """Number of rows, or the sum of the rows that each one stands for."""
    number = F.lit(1) if weight is None else F.col(weight)
    return F.coalesce(F.sum(number if condition is None else F.when(condition, number)), F.lit(0)).cast("long")


def status_counts(df: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Answered rows per status, largest first and ties by status; optionally per further columns.

    ``weight`` names the number of rows that each one stands for, as in ``join_statuses``.
    """
    counts = filter_answered(df).groupBy(*by, STATUS).agg(_rows(weight).alias("n"))
    return counts.orderBy(*by, F.desc("n"), STATUS)


def status_totals(df: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    answered = F.col(STATUS) != schemas.NOT_ANSWERED
    return df.groupBy(*by).agg(
        _rows(weight).alias("total"),
        _rows(weight, answered).alias("answered"),
        _rows(weight, ~answered).alias("unanswered"),
    )


def facet_values(df: DataFrame) -> DataFrame:
    """Distinct filter choices as (facet, value), levels in numeric order; one pass over the rows."""
    def choice(facet: str, number: Column, value: Column) -> Column:
        return F.struct(F.lit(facet).alias("facet"), number.cast("int").alias("number"), value.alias("value"))

    none = F.lit(None)
    choices = F.array(
        choice("Level", F.col("Level"), F.col("Level").cast("string")),
        choice("file_type", none, file_type_bucket(F.col("file_name"))),
        choice("status", none, F.col(STATUS)),
    )
    rows = df.select(F.inline(choices)).distinct()
    return rows.orderBy("facet", "number", "value").select("facet", "value")


def attachment_summary(matched: DataFrame) -> DataFrame:
    """Per split: rows naming a file, files found, paths updated and the extensions found.

    Counted per (split, extension) first, so the set is built from distinct extensions only.
    """
    named = ~is_blank(F.col("file_name"))
    found = named & F.col("found")
    extension = F.when(found, F.lower(file_extension(F.col("file_name"))))
    per_type = matched.groupBy("dataset_split", extension.alias("extension")).agg(
        F.count_if(named).alias("named"), F.count_if(found).alias("found")
    )
    return per_type.groupBy("dataset_split").agg(
        F.sum("named").alias("total_files"),
        F.sum("found").alias("files_found"),
        F.sum("found").alias("paths_updated"),
        F.array_join(F.array_sort(F.collect_set("extension")), ", ").alias("file_types"),
    )


def ingest_summary(
    loaded: DataFrame, rejected: DataFrame, landed: DataFrame, written: DataFrame,
    splits: Sequence[str] = schemas.SPLITS,
) -> DataFrame:
    """Per split of one load: status, records, rejects, files landed, rows written, and whether none is missing.

    Every record must be either written or rejected. The frames hold what this load brought.
    """
    report = loaded.sparkSession.createDataFrame([(split,) for split in splits], "dataset_split string")
    frames = {"records": loaded, "rejected": rejected, "files_landed": landed, "rows_written": written}
    for name, df in frames.items():
        report = report.join(df.groupBy("dataset_split").agg(F.count("*").alias(name)), "dataset_split", "left")
    status = F.when(F.col("records").isNull(), "Not Processed").otherwise("Loaded")
    whole = F.col("rows_written") + F.col("rejected") == F.col("records")
    return report.withColumn("status", status).withColumns(
        {name: F.coalesce(name, F.lit(0)) for name in frames}
    ).withColumn("table_written", (F.col("status") == "Loaded") & whole)


def _concat(df: DataFrame, keys: Sequence[str], order: str, piece: Column, end: str, pieces: int) -> DataFrame:
    part = F.floor(F.coalesce(F.col(order), F.lit(0)) / pieces).cast("long")
    grouped = df.groupBy(*keys, part.alias("part")).agg(
        F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct(F.col(order).alias("o"), piece.alias("t")))))
        .alias("pieces")
    )
    text = F.array_join(F.transform("pieces", lambda x: F.concat(x["t"], F.lit(end))), "")
    return grouped.select(*keys, "part", text.alias("text"))


# What a piece counts for in a part bounded by size, beside its bytes, so that parts hold a bounded number of pieces.
PIECE_COST = 16


def _concat_by_size(
    df: DataFrame, keys: Sequence[str], order: str, piece: Column, end: str, pieces: int, part_bytes: int
) -> DataFrame:
    """Parts of (keys, part, text) that begin at multiples of ``part_bytes``, counting ``PIECE_COST`` for each piece.

    Sizes are added up in two steps, over groups of ``pieces`` consecutive numbers and over the groups of a document, and
    every piece learns what lies before it. Groups with more pieces, because these have no number or a repeated one,
    are split by number and by a hash of the text, so no task gets all pieces of one document. Of the last step
    it sees one narrow row for each group.
    """
    number = F.col(order).cast("long")
    rows = df.select(
        *keys, number.alias("_number"), F.floor(number / pieces).cast("long").alias("_bucket"), F.concat(piece, F.lit(end)).alias("_text")
    ).withColumn("_size", F.when(F.col("_text") != "", F.octet_length("_text").cast("long") + PIECE_COST).otherwise(0))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > pieces)
    crowded = stage(counts.select(*keys, "_bucket", F.ceil(F.col("_n") / pieces).cast("long").alias("_spread")), name="crowded")
    sub = F.lit(0).cast("long")
    if not crowded.isEmpty():
        rows = key_join(rows, crowded, [*keys, "_bucket"], "left")
        inside = F.coalesce(F.col("_number") - F.col("_bucket") * pieces, F.lit(0))
        spread = inside * F.col("_spread") + F.pmod(F.xxhash64("_text"), F.col("_spread"))
        sub = F.coalesce(spread, sub)
    rows = rows.withColumn("_sub", sub).drop("_spread")
    group = [*keys, "_bucket", "_sub"]
    earlier = Window.partitionBy(*keys).orderBy("_bucket", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_bytes").over(earlier), F.lit(0))
    sizes = rows.groupBy(*group).agg(F.sum("_size").alias("_bytes")).select(*group, before.alias("_before"))
    own = Window.partitionBy(*group).orderBy("_number", "_text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("_size").over(own), F.lit(0))
    placed = key_join(rows, sizes, group, "inner").withColumn("part", F.floor(start / part_bytes).cast("long"))
    place = F.struct(F.col("_bucket").isNotNull().alias("numbered"), "_bucket", "_sub", "_number", "_text")
    listed = F.array_sort(F.collect_list(F.when(F.col("_size") > 0, place)))
    return placed.groupBy(*keys, "part").agg(F.array_join(F.transform(listed, lambda x: x["_text"]), "").alias("text"))


def concat_pages(
    pages: DataFrame, keys: Sequence[str] = ("doc",), pieces: int = 1000, part_bytes: int | None = None
) -> DataFrame:
    """Page texts in page order without a separator, as (keys, part, text).

    A part covers ``pieces`` consecutive page numbers, each of which a document has once, so no
    task collects more of a document than that; its parts in order make up its text. A page
    without a number belongs to part 0 and comes before or after the others as nulls sort.

    With ``part_bytes`` a part has less than that and one page, whatever the numbers are; repeated and missing ones are
    no matter. Pages without a number then come first, in no particular order.
    """
    if part_bytes is not None:
        return _concat_by_size(pages, keys, "page", F.col("text"), "", pieces, part_bytes)
    return _concat(pages, keys, "page", F.col("text"), "", pieces)


def concat_lines(
    blocks: DataFrame, keys: Sequence[str] = ("doc",), pieces: int = 1000, part_bytes: int | None = None
) -> DataFrame:
    """Texts of LINE blocks in order, a newline after each, as (keys, part, text).

    Only documents whose job succeeded have a text; without LINE blocks it is empty. Other
    blocks are dropped before the shuffle. Parts are those of ``concat_pages``.
    """
    line = F.when(F.col("block_type") == "LINE", F.col("text"))
    done = blocks.where(F.col("job_status") == "SUCCEEDED")
    if part_bytes is not None:
        return _concat_by_size(done, keys, "pos", line, "\n", pieces, part_bytes)
    return _concat(done, keys, "pos", line, "\n", pieces)


def extract_counts(documents: DataFrame) -> DataFrame:
    """Documents listed and processed per method; a job in any state but SUCCEEDED is not processed."""
    return documents.groupBy("method").agg(
        F.count("*").alias("listed"), F.count_if(F.col("job_status") == "SUCCEEDED").alias("processed")
    )
