"""A table function that streams over the rows of each key, in order of time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn


@udtf
class SessionsOf:
    """SessionsOf(table, key, time, value, gap): each key's runs of rows of which none comes more than `gap` seconds after the one before.

    The names are constants; the table is partitioned by the key and ordered by the time, of which
    only these three columns are read, and the result's types are theirs: (key, began, ended, n,
    largest). It holds one open run, never a key's rows. Null values don't count for `largest`; rows
    without a time make no run; rows without a key are one key.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, time: AnalyzeArgument, value: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or any(not x.isConstantExpression for x in (key, time, value, gap)):
            raise ValueError("SessionsOf takes a table, three column names and a number of seconds")
        kinds = {f.name: f.dataType for f in rows.dataType}
        names = [x.value for x in (key, time, value)]
        if missing := [n for n in names if n not in kinds]:
            raise ValueError(f"the table has no {missing}")
        schema = StructType().add(names[0], kinds[names[0]]).add("began", kinds[names[1]]).add("ended", kinds[names[1]]).add("n", LongType()).add("largest", kinds[names[2]])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(names[0])], orderBy=[OrderingColumn(names[1])], select=[SelectedColumn(n) for n in dict.fromkeys(names)])

    def __init__(self):
        self.run = None

    def eval(self, row, key: str, time: str, value: str, gap: int) -> Iterator[tuple]:
        at, x = row[time], row[value]
        if at is None:
            return
        if self.run and (at - self.run[2]).total_seconds() <= gap:
            _, began, _, n, largest = self.run
            self.run = (row[key], began, at, n + 1, largest if x is None else x if largest is None else max(x, largest))
            return
        if self.run:
            yield self.run
        self.run = (row[key], at, at, 1, x)

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield self.run
