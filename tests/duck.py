"""Comparing a Spark query with its SQL twin in DuckDB: names, types and the bag of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.01"

#: Spark's name of a type for each of DuckDB's that the queries return.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float", "DATE": "date"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def connection(sf_dir=SMALL):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}{'/*.parquet' if file.is_dir() else ''}')")
    return con


def agree(df, sql, con):
    result = con.sql(sql)
    theirs = dict(zip(result.columns, map(str, result.types), strict=True))
    ours = dict(df.dtypes)
    assert set(ours) == set(theirs)
    names = sorted(ours)
    assert {n: ours[n] for n in names} == {n: TYPES.get(theirs[n], theirs[n]) for n in names}
    want = Counter(tuple(map(plain, r)) for r in result.select(*(duckdb.ColumnExpression(n) for n in names)).fetchall())
    got = Counter(tuple(map(plain, r)) for r in df.select(*names).collect())
    assert sum(got.values()) == sum(want.values())
    assert not (got - want), list((got - want).items())[:3] + list((want - got).items())[:3]
