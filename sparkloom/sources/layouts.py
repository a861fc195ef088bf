"""Tables laid out for their readers: partitioned folders, and buckets whose joins need no shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from sparkloom.sources.shared import new_path

#: The catalog database of the bucketed tables, so that they are in nobody's way.
DATABASE = "sparkloom"


def partitioned(df: DataFrame, *columns: str) -> DataFrame:
    """`df` written to the shared folder with a folder for each value of the columns, read back; filters on them skip folders.

    Rows are first dealt by the columns, so that a folder gets few files; AQE splits values that have
    many rows.
    """
    path = new_path(df.sparkSession)
    df.hint("rebalance", *columns).write.partitionBy(*columns).parquet(path)
    rest = [f for f in df.schema.fields if f.name not in columns]
    schema = type(df.schema)([*rest, *(df.schema[c] for c in columns)])
    return df.sparkSession.read.schema(schema).parquet(path).select(*df.columns)


def bucketed(df: DataFrame, buckets: int, columns: Sequence[str]) -> DataFrame:
    """`df` as a table in the shared folder, dealt into `buckets` by the columns and sorted by them within.

    Two tables of as many buckets join on the columns without a shuffle.
    """
    spark = df.sparkSession
    if not spark.catalog.databaseExists(DATABASE):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE} LOCATION '{new_path(spark)}'")
    name = f"{DATABASE}.t{uuid.uuid4().hex}"
    df.repartition(buckets, *columns).write.bucketBy(buckets, *columns).sortBy(*columns).option("path", new_path(spark)).saveAsTable(name)
    return spark.table(name)
