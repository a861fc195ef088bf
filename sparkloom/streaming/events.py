"""Structured Streaming over an event table: windows, sessions, duplicates, stream joins.

Each operator takes a streaming DataFrame and returns one. `drained` runs a stream over what its
source holds and returns the sink's rows: state and offsets are kept in the shared folder, so a lost
executor costs the running batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.shared import new_path
from sparkloom.sources.tables import table

LATE = "1 hour"


def event_stream(spark: SparkSession, sf_dir: str, late: str = LATE, files: int | None = None) -> DataFrame:
    """The table `events` as a stream whose rows may be `late`; its time is a `timestamp`, as watermarks take.

    With `files`, a batch has that many files at most.
    """
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/events.parque[t]")  # as a pattern it may be a file too
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    """Count and largest value in each of the overlapping windows."""
    grouped = events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("largest"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "largest")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Each user's runs of events with less than `gap` between two."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Count and sum of the values of each event type in each window."""
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def first_of_day(events: DataFrame) -> DataFrame:
    """Which users had which event types on which day, each once; a day's state goes when the watermark has passed it.

    The window is a key, so that Spark knows when a key can't come again.
    """
    days = events.select("user_id", "event_type", F.window("ts", "1 day").alias("w")).dropDuplicates(["user_id", "event_type", "w"])
    return days.select("user_id", "event_type", F.col("w.start").cast("timestamp_ntz").alias("day"))


def followed(events: DataFrame, first: str = "click", then: str = "purchase", within: str = "1 hour") -> DataFrame:
    """Pairs of one user's events of which the second comes at most `within` after the first."""
    a = events.filter(F.col("event_type") == first).select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = events.filter(F.col("event_type") == then).select(F.col("user_id").alias("_user"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts"))
    near = (F.col("user_id") == F.col("_user")) & (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).select("user_id", "first_id", "then_id")


def deliveries(events: DataFrame) -> DataFrame:
    """Every event with the time at which it `arrived`, from nothing but its id: most within ten minutes, some after 50, two in a hundred 10 to 20 hours late."""
    m = F.pmod(F.col("event_id") * 7919, F.lit(100))
    seconds = F.when(m < 90, m * 6).when(m < 98, F.lit(3000)).otherwise((m - 97) * 36_000)
    return events.withColumn("arrived", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + seconds * 1_000_000))


def delivered_again(events: DataFrame) -> DataFrame:
    """Every event as it came in, and each third one once more 50 minutes later, with the time of that."""
    first = events.withColumn("ts", F.col("ts").cast("timestamp"))
    again = first.filter(F.pmod("event_id", F.lit(3)) == 0).withColumn("ts", F.col("ts") + F.expr("INTERVAL 50 MINUTES"))
    return first.unionByName(again).withColumn("arrived", F.col("ts"))


def unmatched_too(events: DataFrame, first: str = "click", then: str = "purchase", within: str = "1 hour", late: str = LATE) -> DataFrame:
    """`followed`, and each first event that nothing follows once, with a null, as soon as the watermark proves it.

    The events have no watermark yet: either side gets its own, and the earlier of the two counts.
    """
    a = events.filter(F.col("event_type") == first).select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts")).withWatermark("first_ts", late)
    b = events.filter(F.col("event_type") == then).select(F.col("user_id").alias("_user"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts")).withWatermark("then_ts", late)
    near = (F.col("user_id") == F.col("_user")) & (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near, "left_outer").select("user_id", "first_id", "then_id")


def once_each(events: DataFrame) -> DataFrame:
    """Each event id once, though it may come again within the watermark's delay, on whatever day; a key's state goes when the watermark has passed its own time and the delay."""
    return events.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type")


def _run(stream: DataFrame, path: str, mode: str, progress: list | None) -> None:
    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress


def drained(stream: DataFrame, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Runs `stream` until its source has no more rows; the rows it put out, with the number of their `batch`.

    A batch that is run again overwrites its own folder, so every row is there once. `progress`
    gets Spark's reports of the batches.
    """
    spark = stream.sparkSession
    path, schema = new_path(spark), stream.schema
    _run(stream, path, mode, progress)
    return spark.read.schema(schema.add("batch", "long")).parquet(f"{path}/rows")


#: How many batches `fed` makes of a table.
ARRIVALS = 6


def fed(rows: DataFrame, query: Callable[[DataFrame], DataFrame], batches: int = ARRIVALS, late: str | None = LATE, mode: str = "append", progress: list | None = None) -> DataFrame:
    """`query` over `rows` in the order in which they `arrived` (a timestamp); what it put out, with the number of the `batch`.

    The time from the first arrival to the last is cut into equal spans. The rows of a span are
    written to the source's folder and the query runs over them, going on from the state and offsets
    that the run before it has left, as a job would that starts again and again; so the batches'
    bounds, and what is late, depend on the rows alone. Without `late` the query sets the watermark. Rows without a time aren't delivered; an empty
    table is one empty batch.
    """
    spark = rows.sparkSession
    path, schema = new_path(spark), rows.drop("arrived").schema
    at = F.unix_micros(F.col("arrived").cast("timestamp"))
    first, last = rows.agg(F.min(at), F.max(at)).first()
    span = -(-(last - first + 1) // batches) if first is not None else 1
    stream = None
    for k in range(batches if first is not None else 1):
        came = rows.filter((at >= first + k * span) & (at < first + (k + 1) * span)) if first is not None else rows.limit(0)
        came.drop("arrived").write.mode("append").parquet(f"{path}/arrived")
        source = spark.readStream.schema(schema).parquet(f"{path}/arrived")
        source = source.withColumn("ts", F.col("ts").cast("timestamp"))
        stream = query(source.withWatermark("ts", late) if late else source)
        _run(stream, path, mode, progress)
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/rows")
