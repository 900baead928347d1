import math
import random

import numpy as np
import pytest

from evalspark.llm import whitening
from evalspark.llm.queries import op13_whiten
from evalspark.llm.whitening import bit_planes, exact_deviation, exact_products, plane_products, whiten_embeddings

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, n string"


def plain(vectors):
    """n, deviations, eigenvalues and covariance from Python integers."""
    x = [[math.floor(1024 * c) + 100_000 for c in vector] for vector in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(row[d] for row in x) for d in range(dims)]
    covariance = np.array([[(n * sum(r[a] * r[b] for r in x) - sums[a] * sums[b]) / n**2 for b in range(dims)] for a in range(dims)])
    return n, [sum((n * row[d] - sums[d]) ** 2 for d in range(dims)) for row in x], covariance, np.array(x, float) - np.array([s / n for s in sums])


def check(rows, vectors, components=8):
    n, deviations, covariance, centred = plain(vectors)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    assert len(rows) == n * len(order)
    got = np.array([[row.whitened for row in sorted(rows, key=lambda r: (r.vec_id, r.component))][i::len(order)] for i in range(len(order))]).T
    expected = centred @ axes[:, order] / np.sqrt(values[order])
    assert np.allclose(got * np.sign((got * expected).sum(axis=0)), expected, atol=1e-9)
    for row in rows:
        assert row.n == n and row.deviation == deviations[row.vec_id] and row.identity_error < 1e-8
        assert row.explained == pytest.approx(values[order][row.component - 1] / np.trace(covariance), rel=1e-9)


@pytest.mark.parametrize("rows, columns, high", [(1, 1, 1), (1, 3, 2**64 - 1), (64, 2, 2**63), (65, 5, 1000), (200, 4, 2**40), (3, 2, 0)])
def test_planes_give_exact_products(rows, columns, high):
    draw = random.Random(rows)
    numbers = [[draw.randint(0, high) for _ in range(columns)] for _ in range(rows)]
    got = plane_products(bit_planes(np.array(numbers, np.uint64)))
    assert got.tolist() == [[sum(r[a] * r[b] for r in numbers) for b in range(columns)] for a in range(columns)]


def test_blocks_and_shifts_change_nothing(monkeypatch):
    draw = random.Random(2)
    numbers = [[draw.randint(-2**62, 2**62) if d == 2 else draw.randint(99_000, 101_000) for d in range(4)] for _ in range(500)]
    wide = [[1, *row] for row in numbers]
    expected = [[sum(r[a] * r[b] for r in wide) for b in range(5)] for a in range(5)]
    for block, size in ((64, 1), (128, 1 << 20), (8192, 16 << 20)):
        monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
        monkeypatch.setattr(whitening, "BLOCK_BYTES", size)
        assert exact_products(np.array(numbers, np.int64)).tolist() == expected


@pytest.mark.parametrize("bits", [10, 35, 50, 61])
def test_deviation_is_exact_at_every_size(bits):
    draw = random.Random(bits)
    numbers = [[draw.randint(-2**bits, 2**bits) for _ in range(3)] for _ in range(20)]
    sums = [sum(row[d] for row in numbers) for d in range(3)]
    got = exact_deviation(np.array(numbers, np.int64), 20, sums).to_pylist()
    exact = [sum((20 * row[d] - sums[d]) ** 2 for d in range(3)) for row in numbers]
    assert got == [value if value < 10**38 else None for value in exact]


def test_rows_that_cannot_be_used_are_dropped(spark):
    draw = random.Random(6)
    good = [[draw.gauss(0, 1) for _ in range(5)] for _ in range(70)]
    bad = [None, [], [1.0], [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [1.0, float("inf"), 0.0, 0.0, 0.0], [1e300, 0.0, 0.0, 0.0, 0.0], [0.0] * 6]
    rows = [(i, vector, "x") for i, vector in enumerate(good)] + [(1000 + i, vector, "y") for i, vector in enumerate(bad)]
    check(whiten_embeddings(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect(), good)


def test_repeated_rows_count_and_null_keys_stay(spark):
    vectors = [[0.5, 1.0], [0.5, 1.0], [0.25, -3.0], [7.0, 2.0]]
    rows = [(None, vectors[0], "a"), (None, vectors[1], "b"), (3, vectors[2], "c"), (3, vectors[3], "d")]
    got = whiten_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 8 and {row.n for row in got} == {4} and {row.component for row in got} == {1, 2}
    _, deviations, _, _ = plain(vectors)
    assert sorted(row.deviation for row in got) == sorted(deviations * 2)


def test_vectors_without_variance_and_empty_tables(spark):
    same = spark.createDataFrame([(i, [1.5, 2.5], "") for i in range(5)], SCHEMA)
    got = whiten_embeddings(same).collect()
    assert len(got) == 10 and all((row.whitened, row.explained, row.identity_error, row.deviation) == (0, 0, 0, 0) for row in got)
    line = spark.createDataFrame([(i, [float(i), float(i)], "") for i in range(9)], SCHEMA)
    got = whiten_embeddings(line).collect()
    assert max(row.identity_error for row in got) < 1e-9 and {row.whitened for row in got if row.component == 2} == {0.0}
    for empty in (same.limit(0), spark.createDataFrame([(1, None, "")], SCHEMA), spark.createDataFrame([(1, [], "")], SCHEMA)):
        result = whiten_embeddings(empty)
        assert result.count() == 0 and result.columns == whiten_embeddings(same).columns


def test_large_entries_stay_exact(spark):
    vectors = [[float(2**40 + i * 3), -float(i) / 7] for i in range(40)]
    rows = whiten_embeddings(spark.createDataFrame([(i, v, "") for i, v in enumerate(vectors)], SCHEMA)).collect()
    _, deviations, _, _ = plain(vectors)
    assert all(row.deviation == deviations[row.vec_id] for row in rows) and max(row.identity_error for row in rows) < 1e-8


def test_query_against_python_integers(spark):
    table = {row.vec_id: row.embedding for row in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rows = op13_whiten(spark, SF).collect()
    assert sorted(table) == list(range(len(table)))
    check(rows, [table[i] for i in range(len(table))])
