"""Streams of several batches, with rows out of order, late rows and state that goes."""

import datetime as dt
import random

import pytest

from sparkloom.streaming import events as streaming
from sparkloom.streaming import funnels

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Seven files, one for each day; rows of a day in any order, repeated, and on day 4 some of day 1 and of the evening before."""
    path = tmp_path_factory.mktemp("streams")
    for day in range(7):
        rows = [(day * 100 + k, START + dt.timedelta(days=day, hours=(k * 7) % 24), k % 5, "ab"[k % 2], 1.0, "{}") for k in range(24)]
        rows += rows[:6]
        if day == 4:
            rows += [(990, START + dt.timedelta(days=1, hours=3), 77, "late", 1.0, "{}"), (991, START + dt.timedelta(days=3, hours=23, minutes=30), 78, "in time", 1.0, "{}")]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/day{day}")
    target = path / "events.parquet"
    target.mkdir()
    for day in range(7):
        for file in (path / f"day{day}").glob("*.parquet"):
            moved = target / f"day{day}.parquet"
            moved.write_bytes(file.read_bytes())
            stamp = (START + dt.timedelta(days=day)).timestamp()
            __import__("os").utime(moved, (stamp, stamp))
    return str(path)


def test_first_of_day_drops_late_rows_and_old_state(spark, folder):
    progress = []
    rows = streaming.drained(streaming.first_of_day(streaming.event_stream(spark, folder, files=1)), progress=progress).collect()
    got = {(r.user_id, r.event_type, r.day) for r in rows}
    assert len(rows) == len(got)
    want = {(k % 5, "ab"[k % 2], START + dt.timedelta(days=day)) for day in range(7) for k in range(24)}
    assert got == want | {(78, "in time", START + dt.timedelta(days=3))}
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(states) >= 7 and max(states) <= 25 and states[-1] <= 10


def test_tumbling_windows_count_rows_in_time_only(spark, folder):
    rows = streaming.drained(streaming.tumbling(streaming.event_stream(spark, folder, files=1), "1 day")).collect()
    got = {(r.start, r.event_type): r.n for r in rows}
    assert got[START + dt.timedelta(days=3), "in time"] == 1 and not any(t == "late" for _, t in got)
    assert got[START, "a"] + got[START, "b"] == 30 and START + dt.timedelta(days=6) not in {s for s, _ in got}


def _arriving(spark, rows):
    """Rows of (event_id, hours of the event, hours of its arrival, user_id, event_type)."""
    at = lambda h: START + dt.timedelta(hours=h)
    return spark.createDataFrame([(e, at(h), u, k, 1.0, "{}", at(a)) for e, h, a, u, k in rows], SCHEMA + ", arrived timestamp_ntz")


def test_each_event_once_within_the_watermark_and_across_days(spark):
    rows = [(1, 23.5, 23.5, 1, "a"), (1, 24.3, 24.3, 1, "a"), (2, 30, 30, 1, "a"), (2, 30, 30, 1, "a"), (3, 40, 40, 1, "b"), (4, 60, 60, 1, "b"), (5, 41, 80, 1, "late"), (6, 90, 90, 1, "b")]
    progress = []
    got = streaming.fed(_arriving(spark, rows), streaming.once_each, batches=6, progress=progress).collect()
    assert sorted(r.event_id for r in got) == [1, 2, 3, 4, 6]
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(states) <= 3 and states[-1] <= 1


def test_outer_join_puts_out_each_unmatched_row_once(spark):
    rows = [(1, 1, 1, 1, "click"), (2, 1.5, 1.5, 1, "purchase"), (3, 2, 2, 2, "click"), (4, 5, 5, 1, "click"), (5, 6.5, 6.5, 1, "purchase"), (6, 9, 9, 1, "click"), (7, 20, 20, 3, "purchase"), (8, 20, 20, 4, "click"), (9, 1, 1, None, "click")]
    progress = []
    got = streaming.fed(_arriving(spark, rows), streaming.unmatched_too, batches=5, late=None, progress=progress).collect()
    assert sorted((r.first_id, r.then_id or 0) for r in got) == [(1, 2), (3, 0), (4, 0), (6, 0), (9, 0)]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_an_empty_table_feeds_one_empty_batch(spark):
    assert streaming.fed(_arriving(spark, []), streaming.tumbling).count() == 0


def test_funnels_take_rows_in_order_and_forget(spark):
    rng, rows = random.Random(2), []
    for e in range(400):
        h = rng.randrange(2000) / 10
        rows.append((e, h, h + rng.choice([0, 0.2, 0.9]), rng.choice([1, 2, 3, None]), rng.choice(["view", "click", "purchase", "error", None])))
    rows.append((999, 300, 300, 9, "error"))
    progress = []
    with funnels.rocksdb(spark):
        got = streaming.fed(_arriving(spark, rows), funnels.funnels, batches=3, progress=progress).collect()
    want = []
    for user in (1, 2, 3):
        own, open_ = sorted((h, e, k) for e, h, _, u, k in rows if u == user and k in funnels.STEPS), []
        for h, _, k in own:
            if open_ and h > open_[0] + 12:
                want.append((user, *open_, *[None] * (3 - len(open_)), open_[0] + 12, "expired"))
                open_ = []
            if not open_:
                open_ = [h] if k == "view" else []
            elif k == funnels.STEPS[len(open_)] and h > open_[-1]:
                open_.append(h)
                if len(open_) == 3:
                    want.append((user, *open_, h, "complete"))
                    open_ = []
        if open_:
            want.append((user, *open_, *[None] * (3 - len(open_)), open_[0] + 12, "expired"))
    hours = lambda t: None if t is None else round((t - START).total_seconds() / 3600, 4)
    key = lambda r: (r[0], r[1])
    assert sorted(((r.user_id, hours(r.began), hours(r.second), hours(r.third), hours(r.ended), r.outcome) for r in got), key=key) == sorted(want, key=key)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert states[-1] == 0 < max(states)


def test_state_of_funnels_is_of_buckets_and_not_of_users(spark):
    steps = [(1, "view"), (2, "click"), (3, "purchase"), (20, "view"), (20, "click"), (21, "purchase"), (22, "click"), (30, None)]
    users = [(1 << 60) + k for k in range(-700, 700)] + [-5, 0, None]
    rows = [(n, h, h, u, step) for u in users for n, (h, step) in enumerate(steps)]
    rows += [(None, 40, 40, 1, "view"), (1, 300, 300, 9, "error")]
    progress = []
    with funnels.rocksdb(spark, 3):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        got = streaming.fed(_arriving(spark, rows), lambda came: funnels.funnels(came, buckets=10), batches=2, progress=progress).collect()
    assert before == "3" and spark.conf.get("spark.sql.shuffle.partitions") == "8"
    at = lambda h: START + dt.timedelta(hours=h)
    want = {(u, *r) for u in users if u is not None for r in ((at(1), at(2), at(3), at(3), "complete"), (at(20), at(22), None, at(32), "expired"))}
    assert len(got) == len(want) + 1 and {tuple(r)[:-1] for r in got} == want | {(1, at(40), None, None, at(52), "expired")}
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert states[-1] == 0 < max(states) <= 10 * 5
    assert funnels.dealt(spark, 40_000_000)[0] == 40 and funnels.dealt(spark, 0)[0] == spark.sparkContext.defaultParallelism
