"""Funnels of each user over an event stream, with state of our own: values, lists and timers.

Users are dealt into buckets, and a bucket is the key of the state: a call to the state costs far more
than a row, so there are a few for each bucket and batch and none for each user. Rows wait in a list
until the watermark has passed them, packed as they came, so that they are taken in the order of their
times however they come; a value has the bucket's open funnels, packed too, and its timer. One timer
per bucket stands at what comes next, the earliest waiting row or deadline. A bucket in which nothing
is open or waiting has no state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
STEPS = ("view", "click", "purchase")
_OUT = ("user_id", "began", "second", "third", "ended", "outcome")
#: Columns of packed rows.
_USER, _AT, _EVENT, _STEP = range(4)
#: Packed for no time.
_NEVER = np.iinfo(np.int64).min
#: Events for one bucket and for one partition of the state, over the whole stream.
BUCKET_ROWS, PARTITION_ROWS = 50_000, 1_000_000


@contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """State of the queries started herein is kept by RocksDB, on the executors' disks and in the checkpoint, in so many partitions."""
    wanted = {_PROVIDER: _ROCKSDB} | ({_PARTITIONS: str(partitions)} if partitions else {})
    before = {c: spark.conf.get(c, None) for c in wanted}
    for c, v in wanted.items():
        spark.conf.set(c, v)
    try:
        yield
    finally:
        for c, v in before.items():
            if v is None:
                spark.conf.unset(c)
            else:
                spark.conf.set(c, v)


def dealt(spark: SparkSession, rows: int) -> tuple[int, int]:
    """(partitions, buckets) for a stream of about so many rows: each task starts a Python worker, so partitions grow with rows alone."""
    partitions = max(spark.sparkContext.defaultParallelism, -(-rows // PARTITION_ROWS))
    return partitions, max(4 * partitions, -(-rows // BUCKET_ROWS))


class Funnel(StatefulProcessor):
    """The funnels of a bucket's users: three steps, each later than the one before, within `limit` microseconds of the first."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "open binary, timer long")  # users, first and second times; what comes next
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        taken = (part[part["step"] >= 0] for part in rows)
        new = [part[["user_id", "at", "event_id", "step"]].to_numpy(np.int64) for part in taken if len(part)]
        if new:
            self.waiting.appendList([(part.tobytes(),) for part in new])
            yield from self._settle(timerValues.getCurrentWatermarkInMs() * 1000, min(int(part[:, _AT].min()) for part in new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def _settle(self, passed: int, newest: int | None = None) -> Iterator[pd.DataFrame]:
        """Takes every waiting row and deadline that the watermark has passed, each user's in order of time."""
        packed, timer = self.state.get() or (b"", None)
        following = min(x for x in (newest, timer) if x is not None)
        if following > passed:  # nothing is due yet
            if following != timer:
                self._call_at(following, timer, packed)
            return
        rows = np.concatenate([_unpacked(r[0], 4) for r in self.waiting.get() or ()] or [_unpacked(b"", 4)])
        due = rows[:, _AT] <= passed
        ready, left = rows[due], rows[~due]
        ready = ready[np.lexsort((ready[:, _STEP], ready[:, _EVENT], ready[:, _AT]))]
        open_ = {user: (first, None if second == _NEVER else second) for user, first, second in _unpacked(packed, 3).tolist()}
        taken = (r for at in range(0, len(ready), 1 << 16) for r in ready[at : at + (1 << 16), [_USER, _AT, _STEP]].tolist())
        out = list(self._ended(taken, open_, passed))
        if len(ready):
            if len(left):
                self.waiting.put([(left.tobytes(),)])
            else:
                self.waiting.clear()
        deadlines = (first + self.limit for first, _ in open_.values())
        following = min((*([int(left[:, _AT].min())] if len(left) else []), *deadlines), default=None)
        packed = np.array([(user, first, _NEVER if second is None else second) for user, (first, second) in open_.items()], np.int64).tobytes()
        self._call_at(following, timer, packed)
        if out:
            columns = dict(zip(_OUT, zip(*out, strict=True), strict=True))
            yield pd.DataFrame({c: pd.array(list(v), "Int64") if c != "outcome" else list(v) for c, v in columns.items()})

    def _ended(self, ready: Iterable[Sequence[int]], open_: dict[int, tuple[int, int | None]], passed: int) -> Iterator[tuple]:
        """The funnels that (user, time, step) in order of time or deadlines up to `passed` end; `open_`, by user, becomes what is open then."""

        def expired(user: int) -> tuple:
            first, second = open_.pop(user)
            return user, first, second, None, first + self.limit, "expired"

        for user, at, step in ready:
            if user in open_ and at > open_[user][0] + self.limit:
                yield expired(user)
            if user not in open_:
                if step == 0:
                    open_[user] = at, None
                continue
            first, second = open_[user]
            if step == 1 and second is None and at > first:
                open_[user] = first, at
            elif step == 2 and second is not None and at > second:
                del open_[user]
                yield user, first, second, at, at, "complete"
        for user in [u for u, (first, _) in open_.items() if first + self.limit <= passed]:
            yield expired(user)

    def _call_at(self, following: int | None, timer: int | None, packed: bytes) -> None:
        """Puts the timer at `following`, or drops what is left of the bucket's state if nothing follows."""
        if timer is not None and timer != following:
            self.handle.deleteTimer(_ms(timer))
        if following is None:
            self.state.clear()
        else:
            self.state.update((packed, following))
            if timer != following:
                self.handle.registerTimer(_ms(following))


def _unpacked(raw: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(-1, columns)


def _ms(micros: int) -> int:
    """The first millisecond after it."""
    return micros // 1000 + 1


def funnels(events: DataFrame, limit: str = "12 hours", buckets: int = 64) -> DataFrame:
    """(user_id, began, second, third, ended, outcome) of each user's funnels of view, click and purchase.

    A funnel begins with a view while none is open, and goes on with the first click after it and the
    first purchase after that; it is `complete` with the purchase, or `expired` when `limit` has gone by
    since it began. Events of equal time are taken by event_id, and a step must be later than the one
    before. A funnel comes out once the watermark has passed its end. Other events, and rows without a
    user, time or type, play no part; late rows are dropped. Run it within `rocksdb`. A stream that goes
    on from a checkpoint must keep its number of `buckets`; `dealt` says how many suit the rows.
    """
    place = F.array_position(F.array(*map(F.lit, STEPS)), F.col("event_type"))
    step = F.when((place > 0) & F.col("user_id").isNotNull() & F.col("ts").isNotNull(), place - 1)
    spark = events.sparkSession
    micros = int(spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {limit}"))).first()[0])
    known = lambda c, name, other=0: F.coalesce(c, F.lit(other)).cast("long").alias(name)  # noqa: E731  pandas makes floats of columns with nulls
    # a filter here would move below the watermark, which all rows are to raise
    rows = events.select(
        F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"), "ts", known(F.col("user_id"), "user_id"), known(F.unix_micros("ts"), "at"), known(F.col("event_id"), "event_id"), known(step, "step", -1)
    )
    schema = ", ".join(f"{c} {'string' if c == 'outcome' else 'long'}" for c in _OUT)
    made = rows.groupBy("bucket").transformWithStateInPandas(Funnel(micros), schema, "Append", "EventTime")
    times = {c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("began", "second", "third", "ended")}
    return made.withColumns(times)
