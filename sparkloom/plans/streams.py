"""Streaming queries over `events`, each with the SQL that gives the same rows.

Windows and sessions are put out once the watermark, an hour behind the last event, has passed them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.tables import table
from sparkloom.streaming import events as streaming
from sparkloom.streaming import funnels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_WATERMARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


@query(f"""
SELECT start, count(*) AS n, max(value) AS largest
FROM (SELECT date_trunc('hour', ts) - to_hours(k) AS start, value FROM events, unnest([0, 1]) AS u(k))
GROUP BY start HAVING start + INTERVAL 2 HOUR <= {_WATERMARK}
""")
def stream_sliding(spark, sf_dir):
    return streaming.drained(streaming.sliding(streaming.event_stream(spark, sf_dir))).drop("batch")


@query(f"""
SELECT * FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
WHERE start + INTERVAL 1 HOUR <= {_WATERMARK}
""")
def stream_tumbling(spark, sf_dir):
    return streaming.drained(streaming.tumbling(streaming.event_stream(spark, sf_dir))).drop("batch")


@query(f"""
WITH marked AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, ts, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM marked)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM numbered
GROUP BY user_id, k HAVING stop <= {_WATERMARK}
""")
def stream_sessions(spark, sf_dir):
    return streaming.drained(streaming.sessions(streaming.event_stream(spark, sf_dir))).drop("batch")


@query("SELECT DISTINCT user_id, event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events")
def stream_distinct_days(spark, sf_dir):
    return streaming.drained(streaming.first_of_day(streaming.event_stream(spark, sf_dir))).drop("batch")


@query("""
SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id
AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR
""")
def stream_join(spark, sf_dir):
    return streaming.drained(streaming.followed(streaming.event_stream(spark, sf_dir))).drop("batch")


def _arrivals(batches: int) -> str:
    """Events as `streaming.deliveries` brings them, with their batch and the watermark that holds for it."""
    return f"""
delivered AS (
  SELECT *, ts + to_seconds(CASE WHEN event_id * 7919 % 100 < 90 THEN event_id * 7919 % 100 * 6
    WHEN event_id * 7919 % 100 < 98 THEN 3000 ELSE (event_id * 7919 % 100 - 97) * 36000 END) AS arrived FROM events
),
spans AS (SELECT epoch_us(min(arrived)) AS first, (epoch_us(max(arrived)) - epoch_us(min(arrived)) + {batches}) // {batches} AS span FROM delivered),
dealt AS (SELECT d.*, (epoch_us(arrived) - first) // span AS batch FROM delivered d, spans),
marks AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch) - INTERVAL 1 HOUR AS after FROM dealt GROUP BY batch),
arrivals AS (SELECT d.*, coalesce((SELECT max(after) FROM marks m WHERE m.batch < d.batch), TIMESTAMP '1970-01-01') AS mark FROM dealt d)
"""


@query(f"""
WITH {_arrivals(streaming.ARRIVALS)},
placed AS (SELECT *, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start FROM arrivals)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM placed
WHERE start + INTERVAL 1 HOUR > mark AND start + INTERVAL 1 HOUR <= (SELECT max(after) FROM marks) GROUP BY start, event_type
""")
def stream_late_rows(spark, sf_dir):
    """Hourly counts of a stream of six batches, whose rows come out of order and some of them too late to count."""
    return streaming.fed(streaming.deliveries(table(spark, sf_dir, "events")), streaming.tumbling).drop("batch")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_once_each(spark, sf_dir):
    """Each event once, of a stream in which a third of them come twice."""
    return streaming.fed(streaming.delivered_again(table(spark, sf_dir, "events")), streaming.once_each).drop("batch")


@query("""
WITH last AS (SELECT least(max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 1 HOUR AS mark FROM events)
SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM (SELECT * FROM events WHERE event_type = 'click') a
LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR
WHERE b.event_id IS NOT NULL OR a.ts + INTERVAL 1 HOUR < (SELECT mark FROM last)
""")
def stream_outer_join(spark, sf_dir):
    """Clicks with the purchases in the hour after them, and those without one."""
    events = table(spark, sf_dir, "events").withColumn("arrived", F.col("ts").cast("timestamp"))
    return streaming.fed(events, streaming.unmatched_too, late=None).drop("batch")


@query(f"""
WITH RECURSIVE {_arrivals(3)},
e AS (SELECT user_id, ts, event_type FROM arrivals WHERE ts > mark),
runs AS (
  SELECT user_id, min(ts) AS began FROM e WHERE event_type = 'view' GROUP BY user_id
  UNION ALL
  SELECT r.user_id, (SELECT min(v.ts) FROM e v WHERE v.user_id = r.user_id AND v.event_type = 'view' AND v.ts > coalesce(
    (SELECT min(p.ts) FROM e p WHERE p.user_id = r.user_id AND p.event_type = 'purchase' AND p.ts <= r.began + INTERVAL 12 HOUR AND p.ts >
      (SELECT min(c.ts) FROM e c WHERE c.user_id = r.user_id AND c.event_type = 'click' AND c.ts > r.began)), r.began + INTERVAL 12 HOUR)) AS began
  FROM runs r WHERE r.began IS NOT NULL
),
clicked AS (
  SELECT user_id, began, (SELECT min(c.ts) FROM e c WHERE c.user_id = r.user_id AND c.event_type = 'click' AND c.ts > r.began AND c.ts <= r.began + INTERVAL 12 HOUR) AS second
  FROM runs r WHERE began IS NOT NULL
),
bought AS (
  SELECT *, (SELECT min(p.ts) FROM e p WHERE p.user_id = c.user_id AND p.event_type = 'purchase' AND p.ts > c.second AND p.ts <= c.began + INTERVAL 12 HOUR) AS third FROM clicked c
)
SELECT user_id, began, second, third, coalesce(third, began + INTERVAL 12 HOUR) AS ended, CASE WHEN third IS NULL THEN 'expired' ELSE 'complete' END AS outcome
FROM bought WHERE ended <= (SELECT max(after) FROM marks)
""")
def stream_funnels(spark, sf_dir):
    """Each user's funnels of a stream of three batches, from state with timers."""
    events = table(spark, sf_dir, "events")
    partitions, buckets = funnels.dealt(spark, events.count())
    with funnels.rocksdb(spark, partitions):
        return streaming.fed(streaming.deliveries(events), lambda came: funnels.funnels(came, buckets=buckets), batches=3).drop("batch")
