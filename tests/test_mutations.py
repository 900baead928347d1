import datetime

from helpers import rows
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.operators import mutations

OLD, NEW = datetime.datetime(2024, 1, 1), datetime.datetime(2025, 1, 1)


def created():
    return F.lit(NEW)


def _target(spark):
    return spark.createDataFrame(
        [("u", "t1", "test", "A", "r1", OLD, 5), ("u", "t2", "test", "A", "r2", OLD, None),
         ("v", "t1", "test", "A", "r3", OLD, 5)],
        schemas.USER_RESULTS,
    )


def _updates(spark, data):
    return spark.createDataFrame(data, schemas.RESULT_UPDATES)


def _upsert(spark, target, data):
    return mutations.upsert_results(target, _updates(spark, data), created())


def test_upsert(spark):
    result = _upsert(spark, _target(spark), [
        ("u", "t1", "B", "n1", "test", 7), ("u", "t1", "C", "n2", "test", 6),   # latest of a batch wins
        ("u", "t2", "B", None, "test", 1),                                      # a null response is stored
        ("v", "t1", "B", "n4", "test", 4),                                      # stale
        ("u", "t1", "B", "n5", "validation", 1),                                # new key
    ])
    assert rows(result) == [
        ("u", "t1", "test", "B", "n1", OLD, 7),
        ("u", "t1", "validation", "B", "n5", NEW, 1),
        ("u", "t2", "test", "B", None, OLD, 1),
        ("v", "t1", "test", "A", "r3", OLD, 5),
    ]


def test_upsert_is_idempotent_and_composes(spark):
    first = [("u", "t1", "B", "x", "test", 8), ("w", "t1", "B", "y", "test", 9)]
    second = [("w", "t1", "C", "z", "test", 10), ("u", "t1", "C", "late", "test", 2)]
    target = _target(spark)
    once = _upsert(spark, target, first)
    assert rows(_upsert(spark, once, first)) == rows(once)
    assert rows(_upsert(spark, once, second)) == rows(_upsert(spark, target, first + second))


def test_upsert_of_a_table_without_seq(spark):
    result = _upsert(spark, _target(spark).drop("seq"), [("u", "t1", "B", "n", "test", 1)])
    assert rows(result.select("user_id", "task_id", "user_result_status", "seq")) == [
        ("u", "t1", "B", 1), ("u", "t2", "A", None), ("v", "t1", "A", None)
    ]


def test_upsert_ties_do_not_depend_on_order(spark):
    tied = [("w", "t", "A", "x", "test", 1), ("w", "t", "B", "y", "test", 1)]
    target = _target(spark).limit(0)
    assert rows(_upsert(spark, target, tied)) == rows(_upsert(spark, target, tied[::-1]))


def test_merge_match(spark):
    data = [("u", "t1", "B", "x", "test", 8)] * 2 + [("n", "t1", "B", "x", "test", 8)]
    actions = mutations.merge_match(_target(spark), _updates(spark, data)).select("user_id", "task_id", "action")
    assert rows(actions) == [
        ("n", "t1", "insert"), ("u", "t1", "update"), ("u", "t2", "keep"), ("v", "t1", "keep")
    ]


def test_checked_updates(spark):
    good, bad = mutations.checked_updates(_updates(spark, [
        ("u", "t", "Correct with Instruction", "x", "test", 1), ("u", "t", "Great", "x", "test", 1),
        ("u", "t", "Correct with Instruction", "x", "train", 1),
    ]), schemas.STATUSES)
    assert good.count() == 1 and bad.count() == 2


def _people(spark):
    users = spark.createDataFrame([("1", "ann", "user"), ("2", "bob", "admin")], schemas.USERS)
    results = spark.createDataFrame([("1", "t1"), ("1", "t2"), ("2", "t1"), ("9", "t9")], "user_id string, task_id string")
    return users, results


def test_delete_cascade(spark):
    users, results = _people(spark)
    ids = spark.createDataFrame([("1",), ("1",), ("9",)], "user_id string")
    erased = mutations.delete_cascade(users, results, ids)
    assert rows(erased.users) == [("2", "bob", "admin")]
    # Rows of an unknown id stay: deleting it is an error and changes nothing.
    assert rows(erased.results) == [("2", "t1"), ("9", "t9")]
    assert rows(erased.unknown) == [("9",)]


def test_insert_if_absent(spark):
    users, _ = _people(spark)
    names = spark.createDataFrame([("ann",), ("eve",), ("eve",)], "username string")
    done = mutations.insert_if_absent(users, names)
    assert rows(done.users.select("username", "role")) == [("ann", "user"), ("bob", "admin"), ("eve", "user")]
    assert rows(done.rejected) == [("ann",)]
    ids = [row.user_id for row in done.users.collect()]
    assert all(ids) and len(set(ids)) == 3


def test_update_role(spark):
    users, _ = _people(spark)
    ids = spark.createDataFrame([("1",), ("1",), ("7",)], "user_id string")
    done = mutations.update_role(users, ids)
    assert rows(done.users) == [("1", "ann", "admin"), ("2", "bob", "admin")]
    assert rows(done.unknown) == [("7",)]
