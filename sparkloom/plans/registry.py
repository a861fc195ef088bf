"""All relational and streaming queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import layouts, relational, scalars, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = relational.QUERIES | layouts.QUERIES | scalars.QUERIES | streams.QUERIES
ORACLE: dict[str, str] = relational.ORACLE | layouts.ORACLE | scalars.ORACLE | streams.ORACLE
