"""Pages at any depth of a sorted table.

The rows are written once in ranges of the sort order, with a directory of how many rows
lie before each range. A page opens the ranges that hold it, so a page behind a million
others costs what the first one costs.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subventa.operators.corpus import MAX_PAGE, sort_order

# Rows a range holds, about.
RANGE_ROWS = 100_000


@dataclass(frozen=True)
class SortedPages:
    """`rows` with their range; `before` has the rows before each range, and at its end all rows."""

    rows: DataFrame
    sort: str
    ranges: tuple[int, ...]
    before: tuple[int, ...]

    @property
    def total(self) -> int:
        return self.before[-1]

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """The same rows as `corpus.page`; an offset behind the end gives none."""
        if offset < 0 or not 1 <= limit <= MAX_PAGE:
            raise ValueError(f"limit must be 1..{MAX_PAGE} and offset >= 0")
        first = max(0, bisect.bisect_right(self.before, offset) - 1)
        last = bisect.bisect_left(self.before, offset + limit)
        wanted = self.ranges[first:last]
        skipped = offset - self.before[first] if wanted else 0
        found = self.rows.filter(F.col("range_").isin(list(wanted))).orderBy(*sort_order(self.sort))
        return found.offset(skipped).limit(limit).drop("range_")


def write_pages(rows: DataFrame, root: str, sort: str = "created_at", range_rows: int = RANGE_ROWS) -> SortedPages:
    """Sort `rows` (which have a grant_id of their own each) into ranges below `root`."""
    order = sort_order(sort)
    cuts = max(1, -(-rows.count() // range_rows))
    cut = rows.repartitionByRange(cuts, *order).sortWithinPartitions(*order).withColumn("range_", F.spark_partition_id())
    cut.write.mode("overwrite").partitionBy("range_").parquet(f"{root}/rows")
    rows.limit(0).write.mode("overwrite").parquet(f"{root}/shape")
    return open_pages(rows.sparkSession, root, sort)


def open_pages(spark: SparkSession, root: str, sort: str = "created_at") -> SortedPages:
    """Pages written before; one count per range reaches the driver, from the files' footers."""
    shape = spark.read.parquet(f"{root}/shape").schema
    stored = spark.read.schema(T.StructType([*shape.fields, T.StructField("range_", T.IntegerType())])).parquet(f"{root}/rows")
    sizes = sorted((r["range_"], r["count"]) for r in stored.groupBy("range_").count().collect())
    before = [0]
    for _, n in sizes:
        before.append(before[-1] + n)
    return SortedPages(stored, sort, tuple(r for r, _ in sizes), tuple(before))
