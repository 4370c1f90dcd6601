"""Tables in the shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where none is set, a session that runs in one process takes a fresh temporary folder, and one on a cluster a
    folder of the warehouse, which its executors share.
    """
    folder = spark.conf.get(FOLDER, None)
    if not folder:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        folder = tempfile.mkdtemp(prefix="subventa-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_between"
        spark.conf.set(FOLDER, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of `df` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def sample_by_hash(df: DataFrame, column: str, rows: int, key: str | None = None) -> list[Row]:
    """At most `rows` values of `column`, the same ones however `df` lies in files.

    Taken in the order of the hashes of `key`, so that only keys are read to choose them; without a key, of the
    values themselves. Rows whose key is null are left out.
    """
    if key is None:
        return df.select(column).orderBy(F.xxhash64(column), column).limit(rows).collect()
    order = [F.xxhash64(key), F.col(key)]
    keys = [r[0] for r in df.select(key).filter(F.col(key).isNotNull()).orderBy(*order).limit(rows).collect()]
    if not keys:
        return []
    return df.filter(F.col(key).isin(keys)).select(column, key).orderBy(*order, column).limit(rows).select(column).collect()
