"""Pages of a table kept in their order, so that any one of them is read from a single part.

The rows are numbered once and written in parts of a stated number of whole pages. Where a page lies follows from its
number, so a reader opens one part, however far down the page is. A table of more than ``MOST_PARTS`` parts keeps runs
of neighbouring parts in one folder, in their order, so that the number of folders is bounded; a reader then opens that
folder and passes over the other pages by the statistics of its files. A table is published by version: readers of a page
see one state of it, and writing it anew disturbs nobody.
"""

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evalspark.operators.paging import PAGE_SIZE, clamp_page, page_assign
from evalspark.sources import versions
from evalspark.staging import stage

TABLE = "pages"
_PART = "page_part"

# Pages in a part unless the caller says otherwise.
PAGES_PER_PART = 10_000

# Folders of a table at most.
MOST_PARTS = 4_096


class Page(NamedTuple):
    rows: DataFrame
    page: int
    pages: int
    total: int


def write_pages(
    df: DataFrame, path: str, order_by: Sequence[str] = ("task_id",), page_size: int = PAGE_SIZE, unique: bool = True,
    pages_per_part: int | None = None,
) -> versions.Version:
    """Publish a table in the order of some columns. Only its number of rows comes to the driver.

    Pass ``unique=False`` when ``order_by`` does not identify rows, as for ``page_assign``.
    """
    spark = df.sparkSession
    if _PART in {name.lower() for name in df.columns}:
        raise ValueError(f"the table has a column named {_PART}")
    base = versions.current(spark, path)
    numbered = stage(page_assign(df, order_by, page_size, unique), name="numbered")
    total = numbered.count()
    if pages_per_part is None:
        pages_per_part = max(PAGES_PER_PART, -(-total // (page_size * MOST_PARTS)))
    run = max(1, -(-total // (page_size * pages_per_part * MOST_PARTS)))
    part = F.floor(F.col("page") / (pages_per_part * run)).cast("long")
    written = versions.write_parts(numbered.withColumn(_PART, part), path, TABLE, [_PART], ["position"])
    notes = {
        "schema": numbered.schema.json(), "page_size": page_size, "pages_per_part": pages_per_part, "run": run, "total": total,
    }
    gone = {part: None for part in base.tables.get(TABLE, {})}
    return versions.publish(spark, path, base, {TABLE: {**gone, **written}}, notes)


def read_page(spark: SparkSession, path: str, requested: int, version: int | None = None) -> Page:
    """The rows of one page in their order, from the part that holds it; a number beyond the table is its last page."""
    snapshot = versions.current(spark, path) if version is None else versions.read_version(spark, path, version)
    notes = snapshot.notes
    page = clamp_page(requested, notes["total"], notes["page_size"])
    schema = T.StructType.fromJson(json.loads(notes["schema"]))
    part = versions.part_name({_PART: page // (notes["pages_per_part"] * notes.get("run", 1))})
    held = versions.read(spark, path, snapshot, TABLE, schema, [part])
    rows = held.where(F.col("page") == page).orderBy("position").drop("position", "page")
    return Page(rows, page, -(-notes["total"] // notes["page_size"]), notes["total"])
