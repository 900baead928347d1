"""Pages of an ordered table."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalspark.staging import stage

# Fixed value: rows on a page.
PAGE_SIZE = 9

# Names of the position and the page of a row unless the caller says otherwise.
NUMBERS = ("position", "page")

# monotonically_increasing_id keeps the partition above this bit and the row number below it.
_ROW_BITS = 33


def clamp_page(requested: int, rows: int, page_size: int = PAGE_SIZE) -> int:
    """Requested page within the pages there are; 0 for an empty table."""
    return min(max(requested, 0), max(rows - 1, 0) // page_size)


def page_clamp(requested: Column, rows: Column, page_size: int = PAGE_SIZE) -> Column:
    """Column form of ``clamp_page``."""
    last = F.floor(F.greatest(rows - 1, F.lit(0)) / page_size)
    return F.least(F.greatest(requested, F.lit(0)), last).cast("long")


def page_slice(
    df: DataFrame, page: int, order_by: Sequence[str] = ("task_id",), page_size: int = PAGE_SIZE
) -> DataFrame:
    """Rows of one page as a bounded top-n, which holds all rows up to the page's end in one task.

    For pages far down number the rows once with ``page_assign`` and take ``numbered_page``.
    ``order_by`` should identify rows, else equal ones may change places.
    """
    return df.orderBy(*order_by).offset(page * page_size).limit(page_size)


def numbered_page(numbered: DataFrame, page: int, names: Sequence[str] = NUMBERS) -> DataFrame:
    """Rows of one page of a table that ``page_assign`` has numbered, without the numbers."""
    return numbered.where(F.col(names[1]) == page).drop(*names)


def _unfold(rows: DataFrame, position: str, partitions: int, block: int) -> DataFrame:
    """Each row once per copy, with consecutive positions from ``_start``.

    The copies of a row are cut into blocks, and the blocks spread over tasks.
    """
    last = F.floor((F.col("_copies") - 1) / block)
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    done = F.col("_block") * block
    size = F.least(F.lit(block).cast("long"), F.col("_copies") - done)
    start = F.col("_start") + done
    spread = blocks.repartition(partitions, "_id", "_block")
    return spread.withColumn(position, F.explode(F.sequence(start, start + size - 1))).drop("_block")


def page_assign(
    df: DataFrame, order_by: Sequence[str] = ("task_id",), page_size: int = PAGE_SIZE,
    unique: bool = True, partitions: int | None = None, names: Sequence[str] = NUMBERS, block: int = 100_000,
) -> DataFrame:
    """Add the 0-based position and page of every row under two new ``names``, without a single-task sort.

    Rows are range-partitioned, sorted within partitions and staged; the offset of a partition
    is the number of rows before it. Pass ``unique=False`` when ``order_by`` does not identify
    rows: copies are then counted before the shuffle, ties are ordered by content and the
    copies are unfolded again at the end, up to ``block`` of a row in one task.
    """
    position, page_name = names
    if {name.lower() for name in names} & {name.lower() for name in df.columns}:
        raise ValueError(f"the table has a column named {position} or {page_name}")
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = df.columns
    order = [F.col(name) for name in order_by]
    if unique:
        rows = df.withColumn("_copies", F.lit(1).cast("long"))
    else:
        rows = df.groupBy(*columns).agg(F.count("*").alias("_copies"))
        order.append(F.xxhash64(*columns))
    numbered = stage(
        rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id()),
        name="pages",
    )
    part = F.shiftright("_id", _ROW_BITS)
    # One row per range partition: the only rows an unpartitioned window sees.
    sizes = numbered.groupBy(part.alias("_part")).agg(F.sum("_copies").alias("_size"))
    before = F.coalesce(
        F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = F.broadcast(sizes.select("_part", before.alias("_offset")))
    placed = numbered.withColumn("_part", part).join(offsets, "_part")
    if unique:
        inside = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        placed = placed.withColumn(position, F.col("_offset") + inside)
    else:
        running = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
        end = F.col("_offset") + F.sum("_copies").over(running)
        placed = _unfold(placed.withColumn("_start", end - F.col("_copies")), position, partitions, block)
    page = F.floor(F.col(position) / page_size).cast("long")
    return placed.select(*[F.col(f"`{name}`") for name in columns], position, page.alias(page_name))
