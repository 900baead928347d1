"""Plans that must hold on large tables, and hot keys."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.operators import aggregates, inference, joins, mutations
from evalspark.sources import tables
from evalspark.staging import new_path
from workload import views
from workload.queries import QUERIES

SHUFFLED = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
SKEWED = {
    **SHUFFLED,
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}
SF = "/root/testdata/sf0.001"


@pytest.fixture
def hot(spark, tmp_path):
    """Unique questions, and results of which a third belongs to one task."""
    ids = spark.range(3000).withColumn("task_id", F.col("id").cast("string"))
    questions = ids.select("task_id", F.sha2("task_id", 256).alias("Question"))
    task = F.when(F.col("id") % 3 == 0, F.lit("7")).otherwise((F.col("id") % 2000).cast("string"))
    results = spark.range(60000).select(
        task.alias("task_id"), F.lit("S").alias("user_result_status"),
        F.sha2(F.col("id").cast("string"), 256).alias("chatgpt_response"),
    )
    questions.write.parquet(str(tmp_path / "q"))
    results.write.parquet(str(tmp_path / "r"))
    return spark.read.parquet(str(tmp_path / "q")), spark.read.parquet(str(tmp_path / "r"))


def test_hot_result_key_is_split(hot, plan, conf):
    questions, results = hot
    expected = rows(questions.join(results, "task_id", "left").groupBy("user_result_status").count())
    conf(SKEWED)
    joined = joins.join_results(questions, results)
    assert "skew=true" in plan(joined.select("task_id", "Question", "chatgpt_response"))
    counts = rows(joined.groupBy("user_result_status").count())
    assert sorted(counts) == sorted((status or "N/A", n) for status, n in expected)


def test_hot_question_without_result_is_split(hot, plan, conf):
    _, many = hot
    conf(SKEWED)
    questions = many.select("task_id", F.col("chatgpt_response").alias("Question"))
    results = many.where("task_id <> '7'").limit(3000)
    joined = joins.join_results(questions, results)
    assert "skew=true" in plan(joined).split("LeftAnti")[0].rsplit("SortMergeJoin", 1)[1]
    assert joined.where("task_id = '7'").count() == many.where("task_id = '7'").count()


def test_hot_prompt_is_split(hot, plan, conf):
    _, results = hot
    conf(SKEWED)
    asked = results.withColumnRenamed("task_id", "prompt")
    answers = inference.ask_once(
        asked, "prompt", lambda prompts, settings: prompts, path=new_path(asked.sparkSession, "answers")
    )
    joined = inference.attach_answers(asked, "prompt", answers)
    assert "skew=true" in plan(joined)
    assert joined.where("answer is null").count() == 0 and joined.count() == 60000


def test_hot_attachment_is_split(hot, plan, conf):
    _, results = hot
    conf(SKEWED)
    named = results.select(
        "task_id", F.lit("test").alias("dataset_split"), "chatgpt_response",
        F.concat("task_id", F.lit(".pdf")).alias("file_name"),
    )
    files = named.select("dataset_split", "file_name").distinct().where("file_name < '5'")
    matched = joins.join_attachments(named, files)
    assert "skew=true" in plan(matched)
    assert matched.where("found").count() == named.where("file_name < '5'").count()


def test_rows_that_cannot_match_are_spread(hot, plan, conf):
    _, results = hot
    conf(SHUFFLED)
    numbered = results.withColumn("task_id", F.xxhash64("chatgpt_response").cast("string"))
    nameless = numbered.select("task_id", F.lit("test").alias("dataset_split"), F.lit("").alias("file_name"))
    files = nameless.select("dataset_split", F.lit("a").alias("file_name")).limit(1)
    matched = joins.join_attachments(nameless, files)
    sizes = [row[0] for row in matched.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 60000
    assert "skewed" not in plan(matched)


def test_hot_parent_is_split(hot, plan, conf):
    _, results = hot
    conf(SKEWED)
    children = results.withColumnRenamed("task_id", "user_id")
    parents = children.select("user_id").distinct().where("user_id < '5'")
    kept = mutations.cascade_anti(children, parents)
    assert "skew=true" in plan(kept)
    assert kept.count() == children.where("user_id >= '5'").count()


def test_updates_are_folded_before_the_shuffle(spark, plan, conf):
    conf(SHUFFLED)
    text = plan(mutations.latest_updates(views.updates(spark, SF)))
    assert text.index("partial_max(") > text.index("Exchange hashpartitioning")


def _above(text, *marks):
    """Nodes above the first one whose line has the marks, from the final plan."""
    lines = [line for line in text.split("== Initial Plan ==")[0].split("\n") if line.strip(" :+-")]
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    at = next(i for i, line in enumerate(lines) if all(mark in line for mark in marks))
    found, level = [], depth[at]
    for i in range(at, -1, -1):
        if depth[i] < level:
            found.append(lines[i])
            level = depth[i]
    return found


def test_a_small_batch_does_not_shuffle_the_results(spark, plan):
    target = tables.read_table(spark, _written_results(spark), schemas.USER_RESULTS)
    changed = views.updates(spark, SF).where("user_id < '2'")
    text = plan(mutations.upsert_results(target, changed))
    above = _above(text, "FileScan", "user_result_status")
    assert above and not any("Exchange" in line or "Sort " in line for line in above)


@pytest.fixture
def silver(spark, tmp_path):
    parts = spark.range(400).select(
        F.lit("pymupdf").alias("method"), F.lit("test").alias("dataset_split"), (F.col("id") % 100).cast("string").alias("base_name"),
        F.floor(F.col("id") / 100).alias("part"), F.concat(F.lit("text "), F.floor(F.col("id") / 100).cast("string"), F.lit(";")).alias("text"),
    )
    parts.write.parquet(str(tmp_path / "silver"))
    return spark.read.parquet(str(tmp_path / "silver"))


def _asking(spark, rows_each):
    number = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 120)
    return spark.range(rows_each).select(
        F.col("id").cast("string").alias("task_id"), F.lit("test").alias("dataset_split"),
        F.concat(number.cast("string"), F.lit(".pdf")).alias("file_name"),
    )


def test_a_text_is_shuffled_once(spark, plan, conf, silver):
    conf(SHUFFLED)
    joined = joins.join_silver_text(_asking(spark, 600), silver, "PyMuPDF")
    above = _above(plan(joined), "FileScan", "base_name")
    assert sum("Exchange" in line for line in above) == 1
    assert joined.where("context = 'text 0;text 1;text 2;text 3;'").count() == joined.where("context is not null").count()
    assert joined.where("context is null").count() == _asking(spark, 600).where("file_name >= '100' and length(file_name) = 7").count()


def test_a_document_that_many_rows_want_is_joined_in_copies(spark, conf, silver, monkeypatch):
    conf({**SHUFFLED, "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    expected = rows(joins.join_silver_text(_asking(spark, 3000), silver, "PyMuPDF"))
    monkeypatch.setattr(joins, "ROWS_PER_COPY", 100)
    joined = joins.join_silver_text(_asking(spark, 3000), silver, "PyMuPDF")
    assert rows(joined) == expected
    of_one = joined.where("file_name = '7.pdf'").groupBy(F.spark_partition_id()).agg(F.max("context"))
    assert len(of_one.collect()) > 1


def test_texts_that_are_too_large_are_not_brought_together(spark, plan, conf, silver):
    big = silver.withColumn("text", F.when(F.col("base_name") == "7", F.repeat("text", 50)).otherwise(F.col("text")))
    joined = joins.join_silver_text(_asking(spark, 600), big, "PyMuPDF", largest=200)
    assert rows(joined.where("too_large").select("file_name", "context").distinct()) == [("7.pdf", None)]
    assert joined.where("not too_large and context is not null").count() > 0
    whole = joins.join_parts(big.where("method = 'pymupdf'"), ["base_name"], largest=200)
    assert rows(whole.where("text is null")) == [("7", None, 4 * 350)] and whole.count() == 100


def _written_results(spark):
    path = new_path(spark, "results")
    views.stored_results(spark, SF).write.parquet(path)
    return path


def test_filters_reach_the_scan(spark, plan):
    results = tables.read_table(spark, _written_results(spark), schemas.USER_RESULTS)
    text = plan(tables.scan_user_results(results, "3", "test"))
    assert "EqualTo(user_id,3)" in text and "EqualTo(dataset_split,test)" in text
    assert "created_date" not in text.split("ReadSchema")[1]


def test_split_scan_prunes_partitions(spark, plan, tmp_path):
    tables.overwrite_table(views.questions(spark, SF), str(tmp_path / "q"), schemas.SPLITS)
    stored = tables.read_table(spark, str(tmp_path / "q"), schemas.QUESTIONS)
    text = plan(tables.scan_questions(stored, "validation").select("task_id"))
    assert "dataset_split#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "Question" not in text.split("ReadSchema")[1]


PYTHON = {"batch_infer", "batch_infer_budget", "batch_judge", "extract_documents", "stream_documents", "stream_documents_once", "run_evaluation",
          "run_evaluation_retry", "run_evaluation_keep_errors", "run_evaluation_attempts", "run_extract",
          "run_extract_failed", "run_extract_counts", "run_manual_review", "run_manual_review_rejects"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON))
def test_native_plans(spark, plan, conf, name):
    """No products, no Python workers and no unpartitioned window over rows in native operators."""
    conf(SHUFFLED)
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in text
    if "page" not in name:  # page numbers: one row per range partition meets in a window
        assert "SinglePartition" not in text or "Window" not in text.split("SinglePartition")[0]


def test_concat_collects_bounded_groups(spark):
    pages = spark.range(5000).select(
        F.lit("d").alias("doc"), F.col("id").cast("int").alias("page"), F.lit("x").alias("text")
    )
    parts = aggregates.concat_pages(pages, pieces=1000)
    assert [tuple(row) for row in parts.select("part", F.length("text")).orderBy("part").collect()] == [
        (i, 1000) for i in range(5)
    ]


def test_unnumbered_pieces_of_one_document_meet_in_no_task(spark, conf, plan):
    """Parts keep within the size, no group of one document is larger than it should be, and nothing is lost."""
    conf({**SHUFFLED, "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"})
    text = F.concat(F.lit("piece "), F.col("id").cast("string"), F.lit(";"))
    page = F.when(F.col("id") % 3 == 0, F.col("id") % 40).when(F.col("id") % 3 == 1, F.col("id"))
    pages = spark.range(20000).select(F.lit("d").alias("doc"), page.cast("int").alias("page"), text.alias("text"))
    parts = aggregates.concat_pages(pages, pieces=100, part_bytes=4000).orderBy("part").collect()
    assert max(len(row.text) for row in parts) < 4000 + 30 and len(parts) > 50
    found = [piece for row in parts for piece in row.text.split(";")[:-1]]
    assert sorted(found) == sorted(f"piece {i}" for i in range(20000))
    number = {f"piece {i}": i % 40 if i % 3 == 0 else i for i in range(20000) if i % 3 < 2}
    order = [number.get(piece) for piece in found]
    assert order[:6666] == [None] * 6666 and order[6666:] == sorted(order[6666:])


def test_empty_pieces_and_documents_without_text_have_a_part(spark):
    pages = spark.createDataFrame([("a", 1, None), ("b", None, ""), ("c", 5, "x"), (None, 1, "y"), ("c", 5, "x")], "doc string, page int, text string")
    parts = aggregates.concat_pages(pages, part_bytes=10)
    assert rows(parts.groupBy("doc").agg(F.array_join(F.sort_array(F.collect_list("text")), "").alias("t"))) == [
        ("a", ""), ("b", ""), ("c", "xx"), (None, "y")
    ]
    assert aggregates.concat_pages(pages.limit(0), part_bytes=10).count() == 0
