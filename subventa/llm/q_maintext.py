"""Query op7: main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subventa.llm.maintext import main_texts
from subventa.llm.registry import query, table


@query("op7_html_extract")
def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = main_texts(table(spark, sf_dir, "pages"), key="page_id")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
