"""Writing a table in one of Spark's file formats and reading it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from sparkloom.sources.shared import new_path

FORMATS = ("parquet", "orc", "json", "csv", "text")


def round_trip(df: DataFrame, kind: str, **options: object) -> DataFrame:
    """`df` as files of that kind in the shared folder, read with its own schema; `text` takes one string column, and names it `value`."""
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {FORMATS}")
    path = new_path(df.sparkSession)
    df.write.format(kind).options(**options).save(path)
    reader = df.sparkSession.read.format(kind).options(**options)
    schema = StructType().add("value", "string") if kind == "text" else df.schema
    return reader.schema(schema).load(path)
