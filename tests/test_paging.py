import pytest
from helpers import rows
from pyspark.sql import functions as F

from evalspark.operators import paging
from evalspark.sources import pages


@pytest.mark.parametrize("requested, total, page", [(5, 18, 1), (5, 19, 2), (3, 0, 0), (-1, 50, 0), (1, 50, 1)])
def test_clamp(spark, requested, total, page):
    assert paging.clamp_page(requested, total) == page
    df = spark.createDataFrame([(requested, total)], "p int, n int")
    assert df.select(paging.page_clamp(F.col("p"), F.col("n"))).first()[0] == page


def _table(spark, n=100):
    return spark.range(n).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("task_id"), "id")


def test_pages_partition_the_table(spark):
    df = _table(spark).repartition(7, "id")
    paged = paging.page_assign(df, partitions=5).orderBy("task_id").collect()
    assert [row.position for row in paged] == list(range(100))
    assert [row.page for row in paged] == [i // 9 for i in range(100)]


def test_slices_and_numbered_pages_agree(spark):
    df = _table(spark)
    sliced = [rows(paging.page_slice(df, page)) for page in range(13)]
    numbered = paging.page_assign(df)
    assert [rows(paging.numbered_page(numbered, page)) for page in range(13)] == sliced
    assert [len(page) for page in sliced] == [9] * 11 + [1, 0]


def test_tables_with_columns_of_the_same_name(spark):
    df = _table(spark).select("task_id", F.col("id").alias("page"), (-F.col("id")).alias("Position"))
    with pytest.raises(ValueError):
        paging.page_assign(df)
    numbered = paging.page_assign(df, names=("row_number", "row_page"))
    page = paging.numbered_page(numbered, 2, ("row_number", "row_page"))
    assert page.columns == df.columns and rows(page) == rows(paging.page_slice(df, 2))
    assert [row.page for row in page.orderBy("task_id").collect()] == list(range(18, 27))


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_pages_of_copies(spark, block):
    df = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 10)).alias("k"),
        (F.col("id") % 2).alias("v"),
    )
    paged = paging.page_assign(df, ["k"], unique=False, partitions=4, block=block).orderBy("position").collect()
    assert [row.position for row in paged] == list(range(300))
    assert [row.k for row in paged] == sorted(row.k for row in df.collect())
    assert sorted((row.k, row.v) for row in paged) == rows(df)


def test_empty_table(spark):
    assert paging.page_assign(_table(spark, 0)).count() == 0
    assert paging.page_slice(_table(spark, 0), 0).count() == 0


def test_a_stored_page_is_read_from_one_part(spark, tmp_path, plan):
    path, df = str(tmp_path / "p"), _table(spark, 500).repartition(7, "id")
    version = pages.write_pages(df, path, pages_per_part=4)
    assert len(version.tables["pages"]) == 14
    for number in (0, 1, 3, 4, 30, 55):
        found = pages.read_page(spark, path, number)
        assert [tuple(row) for row in found.rows.collect()] == [tuple(row) for row in paging.page_slice(df, number).orderBy("task_id").collect()]
        assert (found.page, found.pages, found.total) == (number, 56, 500)
        files = found.rows.inputFiles()
        assert files and all(f"page_part={number // 4}/" in name for name in files)
    assert pages.read_page(spark, path, 99).page == 55 and pages.read_page(spark, path, -1).page == 0


def test_many_parts_lie_in_a_bounded_number_of_folders(spark, tmp_path, monkeypatch, plan):
    monkeypatch.setattr(pages, "MOST_PARTS", 5)
    path, df = str(tmp_path / "p"), _table(spark, 500).repartition(7, "id")
    version = pages.write_pages(df, path, pages_per_part=4)
    assert len(version.tables["pages"]) == 5 and version.notes["pages_per_part"] == 4
    for number in range(56):
        found = pages.read_page(spark, path, number)
        assert [row.id for row in found.rows.collect()] == list(range(number * 9, min(number * 9 + 9, 500)))
        files = found.rows.inputFiles()
        assert files and all(f"page_part={number // 12}/" in name for name in files)
    assert "EqualTo(page,7)" in plan(pages.read_page(spark, path, 7).rows)
    for file in sorted({name for name in spark.read.parquet(f"{path}/pages").inputFiles()}):
        places = [row.position for row in spark.read.parquet(file).select("position").collect()]
        assert places == sorted(places)


def test_stored_pages_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "p")
    first = pages.write_pages(_table(spark, 40), path, pages_per_part=1)
    held = pages.read_page(spark, path, 2).rows
    copies = spark.createDataFrame([("a", 1)] * 30 + [("b", 2)], "task_id string, id int")
    pages.write_pages(copies, path, unique=False, pages_per_part=1)
    assert [row.task_id for row in pages.read_page(spark, path, 3).rows.collect()] == ["a"] * 3 + ["b"]
    assert [row.id for row in held.collect()] == list(range(18, 27))
    assert pages.read_page(spark, path, 4, first.number).rows.count() == 4
    pages.write_pages(copies.limit(0), path)
    empty = pages.read_page(spark, path, 7)
    assert (empty.rows.count(), empty.page, empty.total) == (0, 0, 0)
