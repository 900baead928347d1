"""Laws that must hold for any data, on random feeds and tables."""

import datetime
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.operators import aggregates, joins, mutations, paging
from evalspark.streaming import results as stream

MOMENT = datetime.datetime(2024, 1, 1)


def _feed(rng, count):
    return [
        (rng.choice("uvw"), rng.choice("123456"), rng.choice("ABC"), rng.choice(["x", "y", None]),
         rng.choice(schemas.SPLITS), rng.randint(1, 20))
        for _ in range(count)
    ]


def _folded(stored, feed):
    """The feed applied to stored rows one update at a time, in order of seq."""
    table = {row[:3]: row for row in stored}
    for user, task, status, response, split, seq in sorted(feed, key=lambda u: (u[5], u[2], u[3] or "")):
        key = (user, task, split)
        if key not in table or table[key][6] is None or seq >= table[key][6]:
            table[key] = (*key, status, response, MOMENT, seq)
    return sorted(table.values(), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_upsert_equals_updates_one_at_a_time(spark, seed, tmp_path):
    rng = random.Random(seed)
    stored = [(u, t, s, "old", "old", MOMENT, 0) for u in "uv" for t in "12" for s in schemas.SPLITS]
    feed = _feed(rng, 80)
    target = spark.createDataFrame(stored, schemas.USER_RESULTS)
    updates = spark.createDataFrame(feed, schemas.RESULT_UPDATES)
    expected = _folded(stored, feed)
    assert rows(mutations.upsert_results(target, updates, F.lit(MOMENT))) == expected

    cuts = sorted(rng.sample(range(80), 3))
    log = str(tmp_path / "log")
    for i, (start, end) in enumerate(zip([0, *cuts], [*cuts, 80])):
        stream.write_batch(spark.createDataFrame(feed[start:end], schemas.RESULT_UPDATES), i, log)
    assert rows(stream.current_results(target, stream.read_log(spark, log), F.lit(MOMENT))) == expected


@pytest.mark.parametrize("seed", range(3))
def test_join_and_counts(spark, seed):
    rng = random.Random(seed)
    keys = [None, "", "a", "b", "c", "d"]
    left = [(rng.choice(keys), i) for i in range(40)]
    right = [(rng.choice(keys[:-1]), rng.choice(["N/A", "Error", "A", "B"]), "r") for _ in range(20)]
    q = spark.createDataFrame(left, "task_id string, i int")
    r = spark.createDataFrame(right, "task_id string, user_result_status string, chatgpt_response string")
    expected = sorted(
        ((key, i, status) for key, i in left
         for status in [s for k, s, _ in right if k == key] or ["N/A"]), key=repr
    )
    joined = joins.join_results(q, r).select("task_id", "i", "user_result_status")
    assert rows(joined) == expected
    totals = aggregates.status_totals(joined).first()
    assert totals.answered + totals.unanswered == totals.total == len(expected)
    assert sum(row.n for row in aggregates.status_counts(joined).collect()) == totals.answered


@pytest.mark.parametrize("seed, unique", [(0, True), (1, False), (2, False)])
def test_pages_cover_every_row_once(spark, seed, unique):
    rng = random.Random(seed)
    data = rng.sample(range(1000), 200) if unique else rng.choices(range(30), k=200)
    df = spark.createDataFrame([(n,) for n in data], "n int").repartition(6)
    paged = paging.page_assign(df, ["n"], 7, unique=unique, partitions=5).orderBy("position").collect()
    assert [row.n for row in paged] == sorted(data)
    assert [row.position for row in paged] == list(range(200))
    assert {row.page for row in paged} == set(range(29))
