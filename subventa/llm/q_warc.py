"""Query op10: pages written as WARC records and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subventa.llm.registry import query, table
from subventa.llm.store import new_path
from subventa.llm.warc import planned, read_archive, write_archive

SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op10_warc", SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(planned(table(spark, sf_dir, "pages")), path)
    # Revisits have no payload of their own: their headers are enough.
    responses = read_archive(spark, path).filter("record_type = 'response'")
    revisits = read_archive(spark, path, payload=False).filter("record_type = 'revisit'")
    return responses.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to"
    ).union(revisits.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
