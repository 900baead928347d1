"""Helpers that several operators of this folder share."""

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS = 50_000


def keyed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, null texts as empty ones, so other columns and their names play no part."""
    return df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batches_of(rows: dict[str, list | np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of bounded length."""
    columns = [pa.array(rows[field.name], type=field.type) for field in schema]
    table = pa.Table.from_arrays(columns, schema=schema)
    yield from table.to_batches(max_chunksize=BATCH_ROWS)


def held_out(key: Column, parts: int, part: int) -> Column:
    """True for the rows kept from learning: crc32 of the key as text, modulo parts, equals part. False for null keys."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def kept(slot: str, tag: str, make: Callable[[], object]) -> object:
    """An object that the Python worker keeps between tasks, one per slot, made anew when the tag changes."""
    store = vars(sys.modules.setdefault("kept_by_worker", types.ModuleType("kept_by_worker")))
    if store.get(slot, (None,))[0] != tag:
        store[slot] = (tag, make())
    return store[slot][1]


def labelled_sample(labels: DataFrame, key: str, label: str, rows: int, parts: int, part: int) -> DataFrame:
    """(label_key, label) of at most about `rows` labelled rows, without null labels, null keys and held-out keys.

    The rows are thinned by a hash of the key to an expected number of `rows`, which bounds what is broadcast or learned.
    """
    usable = labels.select(F.col(key).alias("label_key"), F.col(label).cast("int").alias("label")).dropna()
    usable = usable.filter(~held_out(F.col("label_key"), parts, part))
    share = rows / max(1, usable.count())
    luck = F.shiftrightunsigned(F.xxhash64(F.col("label_key").cast("string"), F.lit("sample")), 11) / F.lit(float(1 << 53))
    return usable.filter(luck < share)
