"""Stored objects: listings, the bronze table of attachments and the silver table of texts."""

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark import schemas
from evalspark.functions.files import base_name, is_pdf, method_folder
from evalspark.functions.text import is_blank
from evalspark.operators.joins import LARGEST_TEXT, attach_texts, key_join


def read_objects(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Objects below a folder with their bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)


def list_objects(
    spark: SparkSession, folder: str, suffix: str = ".pdf", case_sensitive: bool = True, recursive: bool = True
) -> DataFrame:
    """Path, length and time of the objects with a suffix; their bytes are never read."""
    listing = read_objects(spark, folder, recursive).select("path", "length", "modificationTime")
    path = F.col("path") if case_sensitive else F.lower("path")
    return listing.where(path.endswith(suffix if case_sensitive else suffix.lower()))


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder's full name, with its file system and without a slash at the end, as listings show it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def relative_name(path: Column, folder: str) -> Column:
    """Part of a path below a ``qualified`` folder; null for other paths.

    Any number of slashes may follow the scheme, as listings of local files write one or three.
    """
    scheme, _, rest = folder.partition(":") if ":" in folder else ("", "", folder)
    start = rf"^\Q{scheme}\E:/*" if scheme else "^/*"
    return F.nullif(F.regexp_extract(path, start + rf"\Q{rest.lstrip('/')}\E/+(.+)$", 1), F.lit(""))


def read_split_files(spark: SparkSession, root: str, splits: list[str]) -> DataFrame:
    """Files of ``root/{split}/`` as (dataset_split, file_name, path, length, content).

    A reader that leaves ``content`` out gets a listing: the bytes are then never read.
    """
    def one(split: str) -> DataFrame:
        folder = qualified(spark, f"{root.rstrip('/')}/{split}")
        return read_objects(spark, folder).select(
            F.lit(split).alias("dataset_split"),
            relative_name(F.col("path"), folder).alias("file_name"),
            "path", "length", "content",
        )
    return union_splits([one(split) for split in splits])


def union_splits(listings: list[DataFrame]) -> DataFrame:
    """Bag union of the listings of several splits."""
    return reduce(DataFrame.unionByName, listings)


def filter_pdf(listing: DataFrame, case_sensitive: bool = True) -> DataFrame:
    return listing.where(is_pdf(F.col("path"), case_sensitive))


def prefix_counts(listing: DataFrame) -> DataFrame:
    """Objects per split."""
    return listing.groupBy("dataset_split").agg(F.count("*").alias("objects"))


def first_n_listing(listing: DataFrame, n: int = 10) -> DataFrame:
    """First keys of a listing in path order."""
    return listing.orderBy("path").limit(n)


# Takes the path of a file, returns its bytes.
Reader = Callable[[str], bytes]


def bronze_ingest(
    files: DataFrame, wanted: DataFrame, path: str, written: int, read: Reader | None = None, tasks: int = 32
) -> None:
    """Land the wanted files in the bronze table, as the batch ``written``.

    A name is landed once however many questions refer to it. Each batch has a folder of its
    own: earlier ones stay, and a batch that is repeated replaces itself.

    ``files`` is (dataset_split, file_name, path). With ``read`` the names are matched first and
    spread over ``tasks``, and the bytes are read by the task that writes them. Without it
    ``files`` brings ``content``, which is shuffled if there are too many names to broadcast.
    """
    names = wanted.where(~is_blank(F.col("file_name"))).select("dataset_split", "file_name").distinct()
    if read is None:
        landed = files.join(names, ["dataset_split", "file_name"], "left_semi").select(
            "file_name", "content", "dataset_split"
        )
    else:
        listed = files.select("file_name", "dataset_split", "path").join(names, ["dataset_split", "file_name"], "left_semi")

        def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    yield pd.DataFrame({"file_name": [row.file_name], "content": [read(row.path)], "dataset_split": [row.dataset_split]})

        spread = listed.repartition(tasks, F.xxhash64("path"))
        landed = spread.mapInPandas(contents, "file_name string, content binary, dataset_split string")
    length = F.octet_length("content").cast("long")
    landed = landed.select("file_name", length.alias("length"), "content", "dataset_split")
    landed.write.mode("overwrite").partitionBy("dataset_split").parquet(f"{path}/written={written}")


def newest_rows(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of the last writer of each key, by ``order``.

    The writers that lost are found on the key and order columns alone and taken out; they are
    few, so the contents stay where they are unless Spark cannot broadcast that list.
    """
    writers = rows.select(*keys, *order).distinct()
    last = writers.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
    lost = key_join(writers, last, keys, "inner").where(F.struct(*order) != F.col("_last")).drop("_last")
    return key_join(rows, lost, [*keys, *order], "left_anti")


def read_bronze(spark: SparkSession, path: str, written: int | None = None) -> DataFrame:
    """The bronze table: every file as it was landed last, or the files of one batch."""
    landed = spark.read.schema(schemas.BRONZE).parquet(path)
    if written is not None:
        return landed.where(F.col("written") == written)
    return newest_rows(landed, ["dataset_split", "file_name"], "written")


SILVER_KEY = ["method", "dataset_split", "base_name"]


def silver_rows(documents: DataFrame) -> DataFrame:
    """Log rows of (method, dataset_split, path, text), with ``part``, ``error`` and ``digest`` if there are any."""
    part = F.col("part").cast("long") if "part" in documents.columns else F.lit(0).cast("long")
    error = F.col("error") if "error" in documents.columns else F.lit(None).cast("string")
    digest = F.col("digest") if "digest" in documents.columns else F.lit(None).cast("string")
    return documents.select(
        method_folder(F.col("method")).alias("method"), "dataset_split",
        base_name(F.col("path")).alias("base_name"), "path", part.alias("part"), "text", error.alias("error"),
        digest.alias("digest"),
    )


def silver_write(documents: DataFrame, path: str, written: int) -> None:
    """Add the texts of documents to the silver log as the batch ``written``; earlier ones stay."""
    silver_rows(documents).write.mode("overwrite").parquet(f"{path}/written={written}")


def read_silver_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a silver log; none where nothing has been written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schemas.SILVER_LOG)
    return spark.read.schema(schemas.SILVER_LOG).parquet(path)


def _newest_texts(spark: SparkSession, path: str) -> DataFrame:
    logged = spark.read.schema(schemas.SILVER_LOG).parquet(path)
    return newest_rows(logged.where(F.col("error").isNull()), SILVER_KEY, "written", "path")


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    """The silver table of a log: the parts of one document per (method, split, base name).

    The one written last wins; of several in one batch the last path.
    """
    return _newest_texts(spark, path).select("method", "dataset_split", "base_name", "part", "text")


def compact_silver(spark: SparkSession, path: str, new_path: str, written: int) -> None:
    """Write what a log holds now as the first batch of a new one, numbered like the last it contains."""
    rows = _newest_texts(spark, path).withColumns({"path": F.col("base_name"), "error": F.lit(None).cast("string")})
    rows.drop("written").write.mode("overwrite").parquet(f"{new_path}/written={written}")


def silver_lookup(requests: DataFrame, silver: DataFrame, largest: int | None = LARGEST_TEXT) -> DataFrame:
    """Text for each (file_name, dataset_split, method) request, null where there is none.

    A text of more than ``largest`` bytes is not brought together either; ``too_large`` marks its requests.
    """
    name = F.col("file_name")
    keys = [
        (method_folder(F.col("method")), F.col("method")), (F.col("dataset_split"), F.col("dataset_split")),
        (base_name(name), F.col("base_name")),
    ]
    return attach_texts(requests, silver, keys, ~is_blank(name), "text", largest)
