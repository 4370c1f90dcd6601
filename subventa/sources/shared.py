"""Places that the driver and all executors share, for tables that jobs write between their steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder the session names in spark.checkpoint.dir.

    Without one, a session in a single process takes a temporary folder and a cluster the
    warehouse, which its executors share.
    """
    folder = spark.conf.get(_FOLDER, None)
    if not folder:
        master = spark.sparkContext.master
        alone = master.startswith("local") and not master.startswith("local-cluster")
        folder = tempfile.mkdtemp(prefix="subventa-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_between"
        spark.conf.set(_FOLDER, folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write once, read from there: later steps do not run the plan again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
