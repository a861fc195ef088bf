"""The folder that driver and executors share, for results that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one in local mode, as in tests; on a cluster an error."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return str(sc.getCheckpointDir()).rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/sparkloom-{uuid.uuid4().hex}"


def written(df: DataFrame, files: int | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder: it is computed once and outlives executors.

    With `files`, at most that many tasks write it, for tables much smaller than what they are made from.
    """
    path = new_path(df.sparkSession)
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
