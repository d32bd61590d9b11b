"""The event table as a stream: windows, sessions, late data, dedup and state of one's own under a watermark.

Each query reads the table with readStream, runs to the end of what is there and returns
the sink's rows. The sink is a Parquet folder, so results don't pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.shared import new_folder, until_end
from loomwork.tables import load


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With `ts` as a timestamp, which watermarks ask for."""
    schema = load(spark, sf_dir, "events").schema
    found = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parq*")
    return found.withColumn("ts", F.col("ts").cast(T.TimestampType()))


def finished(stream: DataFrame) -> DataFrame:
    """Run an append-mode query over all that is there now; its rows."""
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    until_end(spark, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def in_batches(batches: list[DataFrame], build: Callable[[DataFrame], DataFrame], **settings: str) -> DataFrame:
    """Rows of the stream that `build` makes of the batches, each taken in whole before the next. `settings` hold while it runs, with _ for dots.

    Each batch is written by as many tasks as it has, then the query runs on from its checkpoint, as a query that is stopped and started again does.
    Between them are no triggers without data unless asked for, so a batch is judged by the watermark that the batches before it have left.
    """
    spark = batches[0].sparkSession
    wanted = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"} | {k.replace("_", "."): v for k, v in settings.items()}
    given = {k: spark.conf.get(k) for k in wanted}
    folder = new_folder(spark, "batches")
    until_end(spark, folder)
    batches[0].limit(0).write.parquet(f"{folder}/input")  # a stream asks for a folder that is there
    out = build(spark.readStream.schema(batches[0].schema).parquet(f"{folder}/input"))
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        for batch in batches:
            batch.write.mode("append").parquet(f"{folder}/input")
            out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    finally:
        for k, v in given.items():
            spark.conf.set(k, v)
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def dealt_by_time(e: DataFrame, n: int = 5) -> list[DataFrame]:
    """The events in n batches of equal spans of time; those without a time come with the first."""
    seconds = F.col("ts").cast("timestamp").cast("double")
    low, high = e.agg(F.min(seconds), F.max(seconds)).first()
    span = max(((high or 0) - (low or 0)) / n, 1e-6)
    batch = F.coalesce(F.least(F.floor((seconds - F.lit(low)) / span), F.lit(n - 1)), F.lit(0))
    return [e.where(batch == i) for i in range(n)]


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed hours only: an hour is given out once the watermark has passed its end."""
    e = events(spark, sf_dir).withWatermark("ts", "10 minutes")
    counts = finished(e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("begins"), "event_type", "n")


def distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State lives only as long as the watermark asks for it."""
    e = events(spark, sf_dir).withWatermark("ts", "1 hour")
    return finished(e.dropDuplicatesWithinWatermark(["event_id"])).select("event_id", "event_type")


def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user with gaps under half an hour that the watermark has closed."""
    e = events(spark, sf_dir).withWatermark("ts", "10 minutes")
    s = finished(e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n")))
    return s.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("begins"), F.col("s.end").cast("timestamp_ntz").alias("ends"), "n")


def punctual_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed hours of a stream in which every tenth event comes after all others: those of hours already given out are dropped.

    Three batches: all events in time but the last of them, this last one, the late ones. The last
    two are judged by the watermark that the first has left.
    """
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast(T.TimestampType()))
    late = F.col("event_id") % 10 == 0
    last = e.where(~late).agg(F.max_by("event_id", F.struct("ts", "event_id"))).first()[0]
    batches = [e.where(~late & (F.col("event_id") != F.lit(last))), e.where(F.col("event_id") == F.lit(last)), e.where(late)]
    counts = in_batches(batches, lambda found: found.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("begins"), "event_type", "n")


def fifth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event of each user, by a count that is kept as the user's state from batch to batch: five batches, of six days each."""

    def fifth(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(chunks).sort_values(["ts", "event_id"])  # a user's events of one batch
        state.update((seen + len(rows),))
        place = seen + 1 + pd.Series(range(len(rows)))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "place": place})[(place % 5 == 0).to_numpy()]

    e = load(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return in_batches(dealt_by_time(e), lambda found: found.groupBy("user_id").applyInPandasWithState(fifth, "user_id long, event_id long, place long", "seen long", "append", "NoTimeout"))


QUERIES = {"stream_hourly_counts": hourly_counts, "stream_distinct_events": distinct_events, "stream_closed_sessions": closed_sessions, "stream_punctual_counts": punctual_counts, "stream_fifth_events": fifth_events}

#: The watermark at the end is the latest event less the delay; what ends later isn't given out.
ORACLES = {
    "stream_hourly_counts": """
select time_bucket(interval 1 hour, ts) as begins, event_type, count(*) as n from events
group by 1, 2
having time_bucket(interval 1 hour, min(ts)) + interval 1 hour <= date_trunc('milliseconds', (select max(ts) from events)) - interval 10 minute""",
    "stream_distinct_events": "select event_id, event_type from events",
    "stream_closed_sessions": """
with g as (select *, sum(case when p is null or ts - p >= interval 30 minute then 1 else 0 end)
                     over (partition by user_id order by ts, event_id) as sid
           from (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events))
select user_id, min(ts) as begins, max(ts) + interval 30 minute as ends, count(*) as n
from g group by user_id, sid
having max(ts) + interval 30 minute <= date_trunc('milliseconds', (select max(ts) from events)) - interval 10 minute""",
    "stream_punctual_counts": """
with e as (select *, event_id % 10 = 0 as late, time_bucket(interval 1 hour, ts) as hour, time_bucket(interval 1 hour, ts) + interval 1 hour as closes from events),
last as (select arg_max(event_id, (ts, event_id)) as id from e where not late),
first_mark as (select date_trunc('milliseconds', max(ts)) - interval 10 minute as t from e where not late and event_id <> (select id from last)),
last_mark as (select date_trunc('milliseconds', max(ts)) - interval 10 minute as t from e)
select hour as begins, event_type, count(*) as n from e
where (not late or closes > (select t from first_mark)) and closes <= (select t from last_mark)
group by hour, event_type""",
    "stream_fifth_events": """
select user_id, event_id, place from (
  select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as place from events)
where place % 5 = 0""",
}
