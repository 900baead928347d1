"""Whitening of embeddings from exact bit-sliced cross-products.

Entries become integers. Each task shifts them by the least of a block of rows, so that few bits are left, and packs
every bit of every dimension across the rows into words of 64 (bit planes). The sum over the rows of the product of two
dimensions is then the sum over all pairs of their planes of popcount(plane AND plane), weighted by the two bits. A
dimension of ones gives the sums and the number of rows in the same way. All of it is exact, so the covariance is
centred as integers, n * sum(xy) - sum(x) * sum(y), and only then becomes a floating-point matrix for eigh.
"""

import math
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import arrow_schema
from evalspark.staging import stage

SCALE, OFFSET = 1024, 100_000

BLOCK_ROWS = 8_192  # rows whose planes are held at once, a multiple of 64
BLOCK_BYTES = 16 << 20  # planes that are compared at once
LIMB, LIMBS = 32, 6  # exact sums are added up by Spark in parts of 32 bits
LARGEST = 2.0 ** 62  # entries that a long holds, with room for the offset
EXACT_DIGITS = 38

_CELL = T.StructType([
    T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
    *[T.StructField(f"limb{i}", T.LongType()) for i in range(LIMBS)],
])


class Whitening(NamedTuple):
    """What is needed to whiten a vector; `axes` has one component per column, `variances` fall."""

    rows: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    total: float


def usable_vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, values as double) of the vectors that have `dims` entries, all of them finite numbers that a long holds."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(fits)
    if not len(places) or not dims:
        return places[:0], np.zeros((0, dims))
    flat = column.take(pa.array(places)).flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls become NaN
    with np.errstate(over="ignore"):
        good = (np.abs(values * SCALE) < LARGEST).all(axis=1)
    return places[good], values[good]


def as_integers(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values).astype(np.int64) + OFFSET


def bit_planes(numbers: np.ndarray) -> np.ndarray:
    """[bit, column, word]: each bit of the unsigned numbers of a column, packed over the rows into words of 64."""
    rows, columns = numbers.shape
    bits = int(numbers.max()).bit_length() if rows else 0
    words = -(-rows // 64)
    planes = np.zeros((bits, columns, words * 8), np.uint8)
    turned = np.ascontiguousarray(numbers.T)
    for bit in range(bits):
        packed = np.packbits((turned >> np.uint64(bit) & np.uint64(1)).astype(np.uint8), axis=1)
        planes[bit, :, :packed.shape[1]] = packed
    return planes.view(np.uint64)


def plane_products(planes: np.ndarray) -> np.ndarray:
    """Sum over the rows of the products of all pairs of columns, as Python integers."""
    bits, columns, words = planes.shape
    total = np.zeros((columns, columns), object)
    at_once = max(1, BLOCK_BYTES // max(1, 8 * columns * words))
    for high in range(bits):
        for low in range(high + 1):
            common = np.empty((columns, columns), np.int64)
            for first in range(0, columns, at_once):
                both = planes[high, first:first + at_once, None] & planes[low][None]
                common[first:first + at_once] = np.bitwise_count(both).sum(axis=2, dtype=np.int64)
            if high != low:
                common = common + common.T
            total += common.astype(object) * (1 << (high + low))
    return total


def exact_products(numbers: np.ndarray) -> np.ndarray:
    """Products of the columns of [1, numbers], summed over the rows: n, the sums and the cross-products."""
    columns = numbers.shape[1] + 1
    total = np.zeros((columns, columns), object)
    for first in range(0, len(numbers), BLOCK_ROWS):
        block = numbers[first:first + BLOCK_ROWS]
        least = block.min(axis=0)
        shifted = np.empty((len(block), columns), np.uint64)
        shifted[:, 0] = 1
        # The difference of two longs fits in 64 bits without a sign; it is the same modulo 2^64.
        shifted[:, 1:] = block.view(np.uint64) - least.view(np.uint64)
        found = plane_products(bit_planes(shifted))
        shift = np.concatenate([[0], least]).astype(object)
        sums = found[0]
        total += found + np.outer(shift, sums) + np.outer(sums, shift) + np.outer(shift, shift) * int(found[0, 0])
    return total


def _limbs(value: int) -> list[int]:
    parts = [value >> LIMB * i & (1 << LIMB) - 1 for i in range(LIMBS - 1)]
    return [*parts, value >> LIMB * (LIMBS - 1)]


def _products_of_tasks(dims: int):
    schema = arrow_schema(_CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, values = usable_vectors(batch.column(0), dims)
            if len(values):
                found = exact_products(as_integers(values))
                total = found if total is None else total + found
        if total is None:
            return
        rows = [[a, b, *_limbs(int(total[a, b]))] for a in range(dims + 1) for b in range(a, dims + 1)]
        table = pa.Table.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)
        yield from table.to_batches(50_000)

    return run


def common_length(embeddings: DataFrame, vector: str = "embedding") -> int:
    """The length that most vectors have, the greater of equals; 0 without vectors. Lengths are few."""
    lengths = embeddings.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dims")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("dims")).first()
    return first["dims"] if first else 0


def fit_whitening(embeddings: DataFrame, dims: int, vector: str = "embedding", components: int = 8) -> Whitening | None:
    """Sums, eigenvectors and variances of all usable vectors; None without any.

    The driver gets one number for each pair of dimensions, whatever the number of rows.
    """
    cells = embeddings.select(F.col(vector).alias("vector")).mapInArrow(_products_of_tasks(dims), _CELL)
    summed = cells.groupBy("a", "b").agg(*[F.sum(f"limb{i}").alias(f"limb{i}") for i in range(LIMBS)])
    products = {(row.a, row.b): sum(row[f"limb{i}"] << LIMB * i for i in range(LIMBS)) for row in summed.collect()}
    if not products:
        return None
    n, sums = products[0, 0], [products[0, a] for a in range(1, dims + 1)]
    covariance = np.empty((dims, dims))
    for (a, b), product in products.items():
        if a:
            # Integers of any size divide to the nearest double.
            covariance[a - 1, b - 1] = covariance[b - 1, a - 1] = (n * product - sums[a - 1] * sums[b - 1]) / (n * n)
    variances, axes = np.linalg.eigh(covariance)
    order = np.argsort(variances)[::-1][:components]
    return Whitening(n, sums, axes[:, order], variances[order], float(np.trace(covariance)))


def exact_deviation(numbers: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """sum over the dimensions of (n * x - S)^2, exact; null where it has more than 38 digits."""
    largest = max(n * abs(int(numbers.max())), n * abs(int(numbers.min())), *map(abs, sums)) * 2 if numbers.size else 0
    if largest ** 2 * numbers.shape[1] < 1 << 63:
        gaps = n * numbers - np.array(sums, np.int64)
        return pa.array((gaps * gaps).sum(axis=1)).cast(pa.decimal128(19, 0)).cast(pa.decimal128(EXACT_DIGITS, 0))
    if largest < 1 << 62:
        # Gaps of up to 62 bits in three parts of 21, whose products are added up as longs.
        gaps = np.abs(n * numbers - np.array(sums, np.int64))
        parts = [gaps >> 21 * i & (1 << 21) - 1 for i in range(3)]
        added = [sum((parts[i] * parts[k - i]).sum(axis=1) for i in range(3) if 0 <= k - i < 3).tolist() for k in range(5)]
        exact = [sum(value << 21 * k for k, value in enumerate(row)) for row in zip(*added)]
    else:
        gaps = numbers.astype(object) * n - np.array(sums, object)
        exact = (gaps * gaps).sum(axis=1).tolist()
    return pa.array([Decimal(value) if value < 10 ** EXACT_DIGITS else None for value in exact], pa.decimal128(EXACT_DIGITS, 0))


def whiten(embeddings: DataFrame, fitted: Whitening, dims: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, deviation decimal(38,0), whitened array<double>) of every usable vector, narrow: nothing is shuffled."""
    frame = embeddings.select(F.col(key).alias(key), F.col(vector).alias("_vector"))
    schema = T.StructType([
        frame.schema[key], T.StructField("deviation", T.DecimalType(EXACT_DIGITS, 0)),
        T.StructField("whitened", T.ArrayType(T.DoubleType())),
    ])
    arrow = arrow_schema(schema)
    # Sums as two doubles: the integer part of the mean, and what is left.
    whole = np.array([value // fitted.rows for value in fitted.sums], np.int64)
    rest = np.array([value % fitted.rows / fitted.rows for value in fitted.sums])
    flat = fitted.variances <= np.finfo(float).eps * dims * max(fitted.total, 0.0)
    scaled = np.where(flat, 0.0, fitted.axes / np.sqrt(np.where(flat, 1.0, fitted.variances)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = usable_vectors(batch.column(1), dims)
            numbers = as_integers(values)
            white = ((numbers - whole) - rest) @ scaled
            lists = pa.ListArray.from_arrays(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1], white.ravel())
            keys = batch.column(0).take(pa.array(places)).cast(arrow.field(0).type)
            exact = exact_deviation(numbers, fitted.rows, fitted.sums)
            yield pa.RecordBatch.from_arrays([keys, exact, lists.cast(arrow.field(2).type)], schema=arrow)

    return frame.mapInArrow(run, schema)


def identity_error(white: DataFrame, fitted: Whitening, dims: int) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, over their components with variance."""
    live = [i for i, e in enumerate(fitted.variances) if e > np.finfo(float).eps * dims * max(fitted.total, 0.0)]
    if not live:
        return 0.0
    pairs = [(a, b) for a in live for b in live if a <= b]
    value = {i: F.col("whitened")[i] for i in live}
    found = white.agg(*[F.covar_pop(value[a], value[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten_embeddings(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, dims: int | None = None) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error of every usable vector and component.

    A vector is usable if it is not null, has `dims` entries (by default the length that most vectors have) and none of
    them is null, not finite or too large for a long; others are dropped. n is the number of usable vectors, with
    repeated ones and those with a null key. deviation is a decimal of up to 38 digits. Components are numbered from 1
    by falling variance; one without variance, as in a table of equal vectors, has whitened and explained 0 and is left out
    of identity_error. Other columns are not read. An empty table gives no rows.
    """
    dims = common_length(embeddings, vector) if dims is None else dims
    fitted = fit_whitening(embeddings, dims, vector, components) if dims > 0 else None
    shape = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if fitted is None:
        empty = embeddings.select(F.col(key).alias(key)).limit(0)
        return empty.select(key, *[F.lit(None).cast(kind).alias(name) for name, kind in (part.split(" ") for part in shape.split(", "))])
    white = stage(whiten(embeddings, fitted, dims, key, vector), name="whitened")
    error = identity_error(white, fitted, dims)
    explained = [max(0.0, float(e)) / fitted.total if fitted.total > 0 else 0.0 for e in fitted.variances]
    explained = [0.0 if math.isnan(value) else value for value in explained]
    exploded = white.select(key, "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return exploded.select(
        key, (F.col("place") + 1).alias("component"), F.lit(fitted.rows).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*[F.lit(value) for value in explained]), F.col("place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
