"""Tables published by version.

A store is a folder. Its rows lie in folders that are written once and never changed. A version is one small file that
names, for each table of the store and each part of a table, the folder that holds the part. Publishing a version adds
that file, so a change of several parts, or of several tables, is seen as a whole or not at all: a load that dies
leaves folders that no version names. Parts that a change leaves alone are shared by the versions. Readers hold a
version, whose folders stay until ``remove_unused`` is told that nobody reads them.

    <root>/versions/0000000007.json
    <root>/<table>/load_id=<id>/<part>/part-*.parquet        a part is named like dataset_split=test

The driver handles the names of parts only; a table should have thousands of parts at most.
"""

import json
import uuid
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_LOAD = "load_id"


class Version(NamedTuple):
    """``tables`` names the folder of every part, ``notes`` is for the writers, such as the last batch applied."""

    number: int
    tables: dict[str, dict[str, str]]
    notes: dict


class Conflict(Exception):
    """Another version was published since the one that a change started from; read it and start again."""


def _open(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions_path(root: str, number: int | None = None) -> str:
    folder = f"{root.rstrip('/')}/versions"
    return folder if number is None else f"{folder}/{number:010d}.json"


def history(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions there are, in their order; none for a folder that is no store."""
    path, fs = _open(spark, _versions_path(root))
    if not fs.exists(path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())


def read_version(spark: SparkSession, root: str, number: int) -> Version:
    path, fs = _open(spark, _versions_path(root, number))
    stream = fs.open(path)
    try:
        stored = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(number, stored["tables"], stored["notes"])


def current(spark: SparkSession, root: str) -> Version:
    """The last version; number 0 without tables where there is none."""
    numbers = history(spark, root)
    return read_version(spark, root, numbers[-1]) if numbers else Version(0, {}, {})


def part_name(values: Mapping[str, object]) -> str:
    """Name of the part that holds some values of the columns a table is parted by."""
    # The characters that Spark escapes in the names of partition folders.
    def escaped(value: object) -> str:
        if value is None or value == "":
            return "__HIVE_DEFAULT_PARTITION__"
        return "".join(f"%{ord(c):02X}" if c < " " or c in '"#%\'*/:=?\\{[]^\x7f' else c for c in str(value))

    return "/".join(f"{column}={escaped(value)}" for column, value in values.items())


def write_parts(df: DataFrame, root: str, table: str, by: Sequence[str], order: Sequence[str] = ()) -> dict[str, str]:
    """Write rows as new folders, one for each combination of values that occurs, and name them; publishes nothing.

    The rows are brought together by part, and a part that is large is split over tasks. With ``order`` each file of a
    part is sorted by these columns.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    load = f"{table}/{_LOAD}={uuid.uuid4().hex}"
    together = df.hint("rebalance", *[F.col(name) for name in by])
    if order:
        together = together.sortWithinPartitions(*by, *order)
    together.write.partitionBy(*by).parquet(f"{root}/{load}")
    path, fs = _open(spark, f"{root}/{load}" + "".join(f"/{name}=*" for name in by))
    found = [status.getPath().toString() for status in fs.globStatus(path)]
    parts = ["/".join(name.split("/")[-len(by):]) for name in found]
    return {part: f"{load}/{part}" for part in parts}


def publish(
    spark: SparkSession, root: str, base: Version, changes: Mapping[str, Mapping[str, str | None]], notes: dict | None = None,
) -> Version:
    """Publish ``base`` with some parts in new folders, or without them where the folder is None.

    Raises ``Conflict`` if ``base`` is no longer the last version. The file is written aside and renamed. Two publishers
    at the same moment need a file system whose rename does not replace a file, such as HDFS, to both learn of it.
    """
    tables = {table: dict(parts) for table, parts in base.tables.items()}
    for table, parts in changes.items():
        merged = {**tables.get(table, {}), **parts}
        tables[table] = {part: folder for part, folder in merged.items() if folder is not None}
    version = Version(base.number + 1, tables, {**base.notes, **(notes or {})})
    path, fs = _open(spark, _versions_path(root, version.number))
    aside, _ = _open(spark, f"{_versions_path(root)}/.{uuid.uuid4().hex}")
    if current(spark, root).number != base.number:
        raise Conflict(f"{root} has a version after {base.number}")
    fs.mkdirs(path.getParent())
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(json.dumps({"tables": tables, "notes": version.notes}, sort_keys=True).encode()))
    finally:
        stream.close()
    if fs.exists(path) or not fs.rename(aside, path):
        fs.delete(aside, False)
        raise Conflict(f"{root} has a version after {base.number}")
    return version


def read(
    spark: SparkSession, root: str, version: Version, table: str, schema: T.StructType, parts: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of a table as of a version, of all parts or of the named ones; others are not listed or opened."""
    stored, root = version.tables.get(table, {}), root.rstrip("/")
    folders = list(stored.values()) if parts is None else [stored[part] for part in parts if part in stored]
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", f"{root}/{table}")
    return reader.parquet(*[f"{root}/{folder}" for folder in folders]).select(*schema.fieldNames())


def remove_unused(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Delete all versions but the last ``keep``, and the folders that none of those names; returns these.

    Only call it when nobody reads an older version and no change is under way, whose folders are not named yet.
    """
    if keep < 1:
        raise ValueError("keep at least one version")
    root, numbers = root.rstrip("/"), history(spark, root)
    versions = [read_version(spark, root, number) for number in numbers]
    named = [{folder for parts in version.tables.values() for folder in parts.values()} for version in versions]
    used, removed = set().union(*named[-keep:]), []

    def delete(name: str) -> None:
        path, fs = _open(spark, f"{root}/{name}")
        if fs.delete(path, True):
            removed.append(name)

    for number in numbers[:-keep]:
        path, fs = _open(spark, _versions_path(root, number))
        fs.delete(path, False)
    for folder in sorted(set().union(*named) - used):
        delete(folder)
    for table in sorted({table for version in versions for table in version.tables}):
        path, fs = _open(spark, f"{root}/{table}/{_LOAD}=*")
        for load in fs.globStatus(path) or []:
            name = f"{table}/{load.getPath().getName()}"
            if not any(folder.startswith(f"{name}/") for folder in used):
                delete(name)
    return removed
