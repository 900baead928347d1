"""Shaping, filters, joins and aggregates."""

import datetime

from helpers import rows
from pyspark.sql import Row, functions as F, types as T

from evalspark import schemas
from evalspark.operators import aggregates, filters, joins, shaping
from evalspark.sources.tables import json_records, prepare_questions

Q = "task_id string, Level int, file_name string"
R = "task_id string, user_result_status string, chatgpt_response string"


def test_flatten_struct_joins_deeper_names_with_dots(spark):
    df = spark.createDataFrame([Row(id=1, m=Row(**{"a b?": "x", "in": Row(y=2)}))])
    flat = shaping.flatten_struct(df, "m", "p_")
    assert flat.columns == ["id", "p_a b?", "p_in.y"]
    assert rows(flat) == [(1, "x", 2)]
    assert shaping.flatten_struct(df, "absent", "p_") is df


def test_flatten_struct_from_text(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("broken",), (None,)], "m string")
    flat = shaping.flatten_struct(df, "m", "", T.StructType([T.StructField("k", T.LongType())]))
    assert sorted(rows(flat), key=repr) == [(1,), (None,), (None,)]


def test_default_column(spark):
    df = spark.createDataFrame([("a", "kept")], "task_id string, result_status string")
    assert rows(shaping.default_column(df, "result_status", "N/A")) == [("a", "kept")]
    assert rows(shaping.default_column(df.drop("result_status"), "result_status", "N/A")) == [("a", "N/A")]


def test_prepare_questions(spark):
    meta = ("steps", None, "?", "tools", "inf")
    df = spark.createDataFrame(
        [("t1", "what?", "2.9", None, None, "", meta, "test")], schemas.RAW_QUESTIONS
    )
    moment = F.lit(datetime.datetime(2024, 5, 6, 7, 8, 9, 123456))
    row = prepare_questions(df, created=moment).first()
    assert (row.Question, row.Level, row.FinalAnswer, row.file_name) == ("what?", 2, "None", "None")
    assert row.Annotator_Metadata_Number_of_steps == "None"
    assert row.Annotator_Metadata_How_long_did_this_take == ""
    assert row.Annotator_Metadata_Number_of_tools == 0
    assert row.number_reject == "Annotator_Metadata_Number_of_tools: number out of range"
    assert row.result_status == "N/A"
    assert row.created_date == datetime.datetime(2024, 5, 6, 7, 8, 9)


def test_conform_schema_rejects(spark):
    schema = T.StructType([
        T.StructField("a", T.StringType()), T.StructField("n", T.IntegerType()),
        T.StructField("r", T.StringType(), False), T.StructField("absent", T.LongType()),
    ])
    df = spark.createDataFrame(
        [("ok", "1", "x"), ("\U0001F600\U0001F600", "1", "x"), ("ok", "z", "x"), ("long", "z", None)],
        "A string, n string, r string",
    )
    tagged = shaping.conform_schema(df, schema, {"a": 3})
    good, bad = shaping.split_rejects(tagged)
    assert rows(good) == [("ok", 1, "x", None)]
    assert sorted(row.reject_reason for row in bad.collect()) == [
        "a too long", "a too long; n has a wrong type; r missing", "n has a wrong type"
    ]


def test_project_response_fills_absent_fields(spark):
    df = spark.createDataFrame([("t", "q", 1)], "task_id string, Question string, Level int")
    row = shaping.project_response(df).first()
    assert len(row) == 13 and row.task_id == "t" and row.created_date is None


def test_json_records_keep_nulls(spark):
    df = spark.createDataFrame([("t", None)], "task_id string, file_name string")
    assert json_records(df).first().record == '{"task_id":"t","file_name":null}'


def _facets(spark):
    return spark.createDataFrame(
        [("a", 1, "x.pdf", "N/A"), ("b", 10, None, "Error"), ("c", 2, "", "Error"), ("d", 1, "y", "N/A")],
        Q + ", user_result_status string",
    )


def test_filter_facets(spark):
    df = _facets(spark)
    def ids(*lists):
        return [row.task_id for row in filters.filter_facets(df, *lists).orderBy("task_id").collect()]
    assert ids() == ["a", "b", "c", "d"]
    assert ids([1]) == ["a", "d"]
    assert ids([], ["No File"]) == ["b", "c"]
    assert ids([], [""]) == ["d"]
    assert ids([1, 10], [".pdf", "No File"], ["Error"]) == ["b"]


def test_facet_values_are_sorted(spark):
    values = [tuple(row) for row in aggregates.facet_values(_facets(spark)).collect()]
    assert values == [
        ("Level", "1"), ("Level", "2"), ("Level", "10"), ("file_type", ""), ("file_type", ".pdf"),
        ("file_type", "No File"), ("status", "Error"), ("status", "N/A"),
    ]


def test_validate_domain(spark):
    df = spark.createDataFrame([("test", "x"), ("train", "x"), (None, "y")], "dataset_split string, s string")
    tagged = filters.validate_domain(df, {"dataset_split": schemas.SPLITS, "s": ["x"]})
    good, bad = shaping.split_rejects(tagged)
    assert rows(good) == [("test", "x")]
    assert sorted(row.reject_reason for row in bad.collect()) == [
        "dataset_split not accepted", "dataset_split not accepted; s not accepted"
    ]


def test_lookups(spark):
    df = spark.createDataFrame([("1", "ann"), ("2", "bob")], "user_id string, username string")
    assert rows(filters.lookup_key(df, "username", "bob")) == [("2", "bob")]
    keys = spark.createDataFrame([("ann",), ("ann",), ("eve",)], "username string")
    assert rows(filters.lookup_keys(df, "username", keys)) == [("ann", "1"), ("eve", None)]


def _sides(spark):
    q = spark.createDataFrame([("a", 1, None), ("b", 2, None), (None, 3, None), ("c", 1, None)], Q)
    r = spark.createDataFrame([("a", "Error", "r1"), ("a", "S", None), (None, "S", "r2"), ("z", "S", "r3")], R)
    return q, r


EXPECTED = [("a", "Error", "r1"), ("a", "S", "N/A"), ("b", "N/A", "N/A"), ("c", "N/A", "N/A"), (None, "S", "r2")]


def test_join_results_multiplies_and_matches_nulls(spark):
    q, r = _sides(spark)
    for one_per_task in (False, True):
        joined = joins.join_results(q, r, one_per_task=one_per_task)
        assert rows(joined.select("task_id", "user_result_status", "chatgpt_response")) == sorted(EXPECTED, key=repr)


def test_join_results_with_empty_results(spark):
    q, r = _sides(spark)
    joined = joins.join_results(q, r.limit(0))
    assert rows(joined.select("user_result_status", "chatgpt_response")) == [("N/A", "N/A")] * 4


def test_join_results_text_key(spark):
    q, r = _sides(spark)
    conflicting = q.withColumn("user_result_status", F.lit("old"))
    results = r.unionByName(spark.createDataFrame([("None", "T", "x")], R))
    joined = joins.join_results_text_key(conflicting, results).select("task_id", "user_result_status")
    assert rows(joined) == [
        ("None", "S"), ("None", "T"), ("a", "Error"), ("a", "S"), ("b", "N/A"), ("c", "N/A")
    ]


def test_join_attachments(spark):
    q = spark.createDataFrame(
        [("1", "a.pdf", "test"), ("2", "a.pdf", "validation"), ("3", "", "test"), ("4", None, "test"),
         ("5", "a.pdf", "test")],
        "task_id string, file_name string, dataset_split string",
    )
    files = spark.createDataFrame([("test", "a.pdf")], "dataset_split string, file_name string")
    matched = joins.join_attachments(q, files)
    assert rows(matched.select("task_id", "found")) == [
        ("1", True), ("2", False), ("3", False), ("4", False), ("5", True)
    ]
    summary = aggregates.attachment_summary(matched.withColumn("file_name", F.upper("file_name")))
    assert rows(summary) == [("test", 2, 2, 2, ".pdf"), ("validation", 1, 0, 0, "")]


def test_join_silver_text(spark):
    q = spark.createDataFrame(
        [("1", "a.pdf", "test"), ("2", "a.pdf", "validation"), ("3", "a.PDF", "test"), ("4", None, "test"),
         ("5", "a", "test")],
        "task_id string, file_name string, dataset_split string",
    )
    silver = spark.createDataFrame(
        [("pymupdf", "test", "a", 0, "T"), ("pymupdf", "test", "a", 1, "1"), ("textract", "test", "a", 0, "T2"),
         ("pymupdf", "test", "a.PDF", 0, "T3"), ("pymupdf", "test", "/5", 0, "not a file of row 5")],
        schemas.SILVER,
    )
    def texts(method):
        return [row.context for row in joins.join_silver_text(q, silver, method).orderBy("task_id").collect()]
    assert texts("PyMuPDF") == ["T1", None, "T3", None, None]
    assert texts("Amazon Textract") == ["T2", None, None, None, None]


def _answers(spark):
    data = [("Error",)] * 2 + [("N/A",)] * 3 + [("B",)] * 2 + [("A",)]
    return spark.createDataFrame(data, "user_result_status string")


def test_status_counts_order_and_totals(spark):
    df = _answers(spark)
    assert [tuple(row) for row in aggregates.status_counts(df).collect()] == [("B", 2), ("Error", 2), ("A", 1)]
    assert rows(aggregates.status_totals(df)) == [(8, 5, 3)]
    assert rows(aggregates.status_totals(df.limit(0))) == [(0, 0, 0)]


def _blocks(spark):
    return spark.createDataFrame(
        [("d", 2, "LINE", "two", "SUCCEEDED"), ("d", 0, "LINE", "one", "SUCCEEDED"), ("d", 1, "WORD", "w", "SUCCEEDED"),
         ("e", 0, "WORD", "w", "SUCCEEDED"), ("f", 0, "LINE", "x", "FAILED"), ("g", 0, "LINE", "x", "PARTIAL_SUCCESS")],
        schemas.BLOCKS,
    )


def test_concat_lines(spark):
    lines = aggregates.concat_lines(_blocks(spark))
    assert rows(lines) == [("d", 0, "one\ntwo\n"), ("e", 0, "")]


def test_long_documents_come_in_parts(spark):
    pages = spark.range(10).select(
        F.lit("d").alias("doc"), F.col("id").cast("int").alias("page"), F.col("id").cast("string").alias("text")
    )
    parts = aggregates.concat_pages(pages, pieces=4)
    assert rows(parts) == [("d", 0, "0123"), ("d", 1, "4567"), ("d", 2, "89")]
    one_part = spark.createDataFrame([("e", 0, "x")], "doc string, part long, text string")
    whole = joins.join_parts(parts.unionByName(one_part))
    assert rows(whole) == [("d", "0123456789", 10), ("e", "x", 1)]
    assert rows(joins.join_parts(parts.where("part > 0"))) == [("d", "456789", 6)]
    assert rows(joins.join_parts(parts.where("part > 0"), largest=5)) == [("d", None, 6)]
    assert rows(joins.join_parts(parts.unionByName(one_part), largest=9)) == [("d", None, 10), ("e", "x", 1)]
    assert rows(joins.join_parts(parts.unionByName(one_part), largest=0)) == [("d", None, 10), ("e", None, 1)]


def test_a_page_without_a_number_does_not_split_its_document(spark):
    pages = spark.createDataFrame([("d", 0, "a"), ("d", None, "?"), ("d", 1, "b")], "doc string, page int, text string")
    assert rows(joins.join_parts(aggregates.concat_pages(pages)).select("doc", F.length("text"))) == [("d", 3)]


def test_a_private_key_is_no_file(spark):
    questions = spark.createDataFrame([("1", None, "test"), ("2", "/1", "test")], "task_id string, file_name string, dataset_split string")
    files = spark.createDataFrame([("test", "/1")], "dataset_split string, file_name string")
    assert rows(joins.join_attachments(questions, files).select("task_id", "found")) == [("1", False), ("2", True)]


def test_folded_statuses_count_like_the_join(spark):
    questions = spark.createDataFrame([("1", 1, "a.pdf"), ("2", 2, ""), ("3", 1, None), (None, 3, "")], "task_id string, Level int, file_name string")
    results = spark.createDataFrame(
        [("1", "A", "x"), ("1", "A", "y"), ("1", "B", "z"), (None, "A", "n"), ("9", "A", "u")],
        "task_id string, user_result_status string, chatgpt_response string",
    )
    whole, folded = joins.join_results(questions, results), joins.join_statuses(questions, results)
    assert rows(aggregates.status_counts(folded, weight="n")) == rows(aggregates.status_counts(whole))
    assert rows(aggregates.status_totals(folded, weight="n")) == rows(aggregates.status_totals(whole))
    assert rows(aggregates.facet_values(folded)) == rows(aggregates.facet_values(whole))


def test_extract_counts(spark):
    df = spark.createDataFrame(
        [("textract", "SUCCEEDED"), ("textract", "FAILED"), ("textract", None), ("pymupdf", "SUCCEEDED")],
        "method string, job_status string",
    )
    assert rows(aggregates.extract_counts(df)) == [("pymupdf", 1, 1), ("textract", 3, 1)]


def test_ingest_summary_shows_empty_splits(spark):
    df = spark.createDataFrame([("test",), ("test",)], "dataset_split string")
    one, none = df.limit(1), df.limit(0)
    summary = aggregates.ingest_summary(df, none, one, one).orderBy("dataset_split")
    assert [row.asDict() for row in summary.collect()] == [
        dict(dataset_split="test", status="Loaded", records=2, rejected=0, files_landed=1, rows_written=1,
             table_written=False),
        dict(dataset_split="validation", status="Not Processed", records=0, rejected=0, files_landed=0,
             rows_written=0, table_written=False),
    ]
    with_reject = aggregates.ingest_summary(df, one, none, one).where("dataset_split = 'test'").first()
    assert with_reject.table_written
