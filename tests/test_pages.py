import pytest
from pyspark.sql import functions as F

from subventa.operators.corpus import page
from subventa.operators.pages import open_pages, write_pages


@pytest.mark.parametrize("sort", ["created_at", "deadline", "funding_max"])
def test_every_page_is_that_of_the_plain_sort(spark, tmp_path, sort):
    rows = spark.range(1000).select(
        F.col("id").cast("string").alias("grant_id"),
        F.timestamp_seconds(F.col("id") * 7919 % 300).alias("created_at"),
        F.when(F.col("id") % 3 > 0, F.timestamp_seconds(F.col("id") % 10)).alias("deadline"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 5).alias("funding_max_eur"),
    )
    pages = write_pages(rows, str(tmp_path), sort, range_rows=90)
    assert pages.total == 1000 and len(pages.ranges) > 5
    pages = open_pages(spark, str(tmp_path), sort)
    for limit, offset in ((50, 0), (200, 333), (7, 993), (50, 999), (50, 1000), (1, 5000), (200, 800)):
        assert [tuple(r) for r in pages.page(limit, offset).collect()] == [tuple(r) for r in page(rows, sort, limit, offset).collect()]
    for limit, offset in ((0, 0), (201, 0), (1, -1)):
        with pytest.raises(ValueError):
            pages.page(limit, offset)


def test_a_deep_page_reads_its_ranges_alone(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("grant_id"), F.timestamp_seconds("id").alias("created_at"))
    pages = write_pages(rows, str(tmp_path), range_rows=1000)
    at = max(i for i, b in enumerate(pages.before) if b <= 15_000)
    found = pages.page(10, 15_000)
    assert found.count() == 10
    filters = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in line]
    held = {pages.ranges[at], pages.ranges[min(at + 1, len(pages.ranges) - 1)]}
    assert filters and any(f"= {r})" in filters[0] or f"IN ({r}" in filters[0] or f" {r})" in filters[0] for r in held)


def test_empty(spark, tmp_path):
    rows = spark.range(0).select(F.col("id").cast("string").alias("grant_id"), F.timestamp_seconds("id").alias("created_at"))
    pages = write_pages(rows, str(tmp_path))
    assert pages.total == 0 and pages.page().count() == 0
