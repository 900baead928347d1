"""Tables and objects on disk."""

import json
import os

from helpers import rows
from pyspark.sql import functions as F

from evalspark import schemas, staging
from evalspark.sources import objects, tables


def _question(task, split, **values):
    row = dict.fromkeys(schemas.QUESTIONS.fieldNames())
    return {**row, "task_id": task, "dataset_split": split, **values}


def test_shared_dir_follows_the_session(spark):
    assert staging.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert staging.new_path(spark, "x") != staging.new_path(spark, "x")


def test_overwrite_keeps_the_other_split(spark, tmp_path):
    path = str(tmp_path / "questions")
    both = spark.createDataFrame([_question("a", "test"), _question("b", "validation")], schemas.QUESTIONS)
    tables.overwrite_table(both, path, schemas.SPLITS)
    tables.overwrite_table(spark.createDataFrame([_question("c", "test")], schemas.QUESTIONS), path, ["test"])
    stored = tables.read_table(spark, path, schemas.QUESTIONS)
    assert rows(stored.select("task_id", "dataset_split")) == [("b", "validation"), ("c", "test")]
    assert rows(tables.scan_questions(stored, "anything").select("task_id")) == [("c",)]
    assert rows(tables.scan_questions(stored, "validation").select("task_id")) == [("b",)]
    tables.overwrite_table(both.limit(0), path, ["validation"])
    stored = tables.read_table(spark, path, schemas.QUESTIONS)
    assert rows(stored.select("task_id", "dataset_split")) == [("c", "test")]


def test_load_split_reads_json(spark, tmp_path):
    record = {
        "task_id": "t", "Question": "why?", "Level": "2", "Final answer": "?", "dataset_split": "test",
        "Annotator Metadata": {"Steps": "s", "Number of tools": "3"},
    }
    other = {**record, "task_id": "o", "dataset_split": "validation"}
    (tmp_path / "raw.json").write_text("\n".join(json.dumps(r) for r in (record, other)))
    loaded = tables.load_split(spark, str(tmp_path), "test")
    assert set(loaded.columns) == set(schemas.QUESTIONS.fieldNames())
    row = loaded.first()
    assert loaded.count() == 1
    assert (row.task_id, row.Level, row.FinalAnswer, row.file_name) == ("t", 2, "", "None")
    assert (row.Annotator_Metadata_Steps, row.Annotator_Metadata_Number_of_tools) == ("s", 3)
    assert row.created_date.microsecond == 0


def test_scan_user_results(spark):
    df = spark.createDataFrame(
        [("u", "t1", "test", "A", "r", None, 1), ("u", "t2", "validation", "A", "r", None, 1),
         ("v", "t1", "test", "A", "r", None, 1)], schemas.USER_RESULTS
    )
    assert rows(tables.scan_user_results(df, "u", "test")) == [("u", "t1", "A", "r")]


def test_empty_tables(spark, tmp_path):
    users, results = str(tmp_path / "users"), str(tmp_path / "results")
    spark.createDataFrame([("1", "a", "user")], schemas.USERS).write.parquet(users)
    tables.empty_tables(spark, users, results)
    assert tables.read_table(spark, users, schemas.USERS).count() == 0
    assert tables.read_table(spark, results, schemas.USER_RESULTS).columns == schemas.USER_RESULTS.fieldNames()


def _files(root):
    for name, data in {
        "test/a.pdf": b"A", "test/b.PDF": b"B", "test/sub/c.pdf": b"CC", "test/d.txt": b"D", "validation/a.pdf": b"V",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


def test_list_objects(spark, tmp_path):
    folder = _files(tmp_path) + "/test"

    def listed(**options):
        paths = objects.list_objects(spark, folder, **options).select("path").collect()
        return sorted(row.path.rsplit("/test/", 1)[1] for row in paths)

    assert listed() == ["a.pdf", "sub/c.pdf"]
    assert listed(case_sensitive=False) == ["a.pdf", "b.PDF", "sub/c.pdf"]
    assert listed(case_sensitive=False, recursive=False) == ["a.pdf", "b.PDF"]


def test_relative_name(spark):
    def name(path, folder):
        return spark.range(1).select(objects.relative_name(F.lit(path), folder)).first()[0]
    assert name("file:/data/r/test/a.pdf", "file:/data/r/test") == "a.pdf"
    assert name("file:///data/r/test/x/a b.pdf", "file:/data/r/test") == "x/a b.pdf"
    assert name("s3a://b/r/test/b/r/test/a.pdf", "s3a://b/r/test") == "b/r/test/a.pdf"
    assert name("file:/data/r/mytest/y/test/a.pdf", "file:/y/test") is None
    assert name("file:/data/r/test2/a.pdf", "file:/data/r/test") is None
    assert objects.qualified(spark, "some/test/") == "file:" + os.path.abspath("some/test")


def test_listing_does_not_read_bytes(spark, tmp_path, plan):
    listing = objects.list_objects(spark, _files(tmp_path))
    assert "content" not in plan(listing).split("ReadSchema")[1]


def test_split_files_bronze_and_counts(spark, tmp_path):
    files = objects.read_split_files(spark, _files(tmp_path), schemas.SPLITS)
    assert rows(files.select("dataset_split", "file_name", "length")) == [
        ("test", "a.pdf", 1), ("test", "b.PDF", 1), ("test", "d.txt", 1), ("test", "sub/c.pdf", 2),
        ("validation", "a.pdf", 1),
    ]
    assert rows(objects.prefix_counts(files)) == [("test", 4), ("validation", 1)]
    assert len(rows(objects.first_n_listing(files, 2))) == 2
    wanted = spark.createDataFrame(
        [("test", "a.pdf"), ("test", "a.pdf"), ("test", "none.pdf"), ("test", ""), ("validation", None)],
        "dataset_split string, file_name string",
    )
    bronze = str(tmp_path / "bronze")
    objects.bronze_ingest(files, wanted, bronze, 0)
    landed = objects.read_bronze(spark, bronze)
    assert rows(landed.withColumn("content", F.decode("content", "UTF-8"))) == [("a.pdf", 1, "A", 0, "test")]
    # Another landing leaves the first one alone, and a repeated one replaces itself.
    more = spark.createDataFrame([("test", "b.PDF"), ("validation", "a.pdf")], "dataset_split string, file_name string")
    for _ in range(2):
        objects.bronze_ingest(files, more, bronze, 1)
    assert rows(objects.read_bronze(spark, bronze).select("dataset_split", "file_name", "written")) == [
        ("test", "a.pdf", 0), ("test", "b.PDF", 1), ("validation", "a.pdf", 1)
    ]
    assert objects.read_bronze(spark, bronze, 0).count() == 1


def test_bytes_are_read_where_they_are_written(spark, tmp_path, plan, conf):
    conf({"spark.sql.autoBroadcastJoinThreshold": "-1"})
    files = objects.read_split_files(spark, _files(tmp_path), schemas.SPLITS)
    listing = files.drop("content")
    assert "content" not in plan(listing).split("ReadSchema")[1]

    def read(path):
        with open(path.removeprefix("file:"), "rb") as file:
            return file.read()

    bronze = str(tmp_path / "bronze")
    objects.bronze_ingest(listing, listing, bronze, 0, read, tasks=3)
    landed = objects.read_bronze(spark, bronze, 0)
    assert rows(landed.select("dataset_split", "file_name", F.decode("content", "UTF-8"))) == rows(
        files.select("dataset_split", "file_name", F.decode("content", "UTF-8"))
    )


def test_silver_last_write_wins(spark, tmp_path):
    schema = "method string, dataset_split string, path string, part long, text string"
    path = str(tmp_path / "silver")
    objects.silver_write(spark.createDataFrame(
        [("PyMuPDF", "test", "x/a.pdf", 0, "old"), ("PyMuPDF", "test", "x/a.pdf", 1, " text"),
         ("PyMuPDF", "validation", "a.pdf", 0, "v"), ("Amazon Textract", "test", "a.pdf", 0, "t")], schema), path, 1)
    objects.silver_write(spark.createDataFrame([("PyMuPDF", "test", "a.pdf", 0, "new")], schema), path, 2)
    silver = objects.read_silver(spark, path)
    assert silver.count() == 3
    objects.compact_silver(spark, path, str(tmp_path / "compacted"), 2)
    assert rows(objects.read_silver(spark, str(tmp_path / "compacted"))) == rows(silver)
    requests = spark.createDataFrame(
        [("PyMuPDF", "test", "a.pdf"), ("Amazon Textract", "test", "a.pdf"), ("PyMuPDF", "test", "b.pdf")],
        "method string, dataset_split string, file_name string",
    )
    found = objects.silver_lookup(requests, silver).select("method", "file_name", "text")
    assert rows(found) == [("Amazon Textract", "a.pdf", "t"), ("PyMuPDF", "a.pdf", "new"), ("PyMuPDF", "b.pdf", None)]
