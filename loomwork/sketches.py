"""Sketches whose states are stored by day and merged for any range of days.

A state has a fixed size whatever it has seen: HyperLogLog for distinct users, theta for distinct users that take part in set
operations, KLL for ranks of values. The store has a row for each day and kind of event, in folders by day, so a range reads
its own days only. Merged states are held against exact figures: within three standard errors of the sketches' published bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.shared import new_folder, until_end
from loomwork.tables import load

#: Standard error of a union: 1.04 / sqrt(2**12) for HLL, 1 / sqrt(2**12) for theta; rank error of KLL at K.
LG, K, HLL_ERROR, THETA_ERROR, KLL_ERROR = 12, 400, 0.01625, 0.015625, 0.0075
START = "2024-01-01"


def stored(events: DataFrame) -> DataFrame:
    """(event_type, users, members, spread, day): the states, written and read again. Rows without a time have no day and no state."""
    spark, folder = events.sparkSession, new_folder(events.sparkSession, "sketches")
    days = events.where("ts is not null").groupBy(F.to_date("ts").alias("day"), "event_type")
    states = days.agg(F.hll_sketch_agg("user_id", LG).alias("users"), F.theta_sketch_agg("user_id", LG).alias("members"), F.kll_sketch_agg_double("value", K).alias("spread"))
    states.write.partitionBy("day").parquet(folder)
    until_end(spark, folder)
    return spark.read.schema(states.select("event_type", "users", "members", "spread", "day").schema).parquet(folder)


def merged(store: DataFrame, range_: Column) -> DataFrame:
    """One state for each range and kind of event."""
    of = store.groupBy(range_.alias("range"), "event_type")
    return of.agg(F.hll_union_agg("users").alias("users"), F.theta_union_agg("members", LG).alias("members"), F.kll_merge_agg_double("spread", K).alias("spread"))


def week(day: str) -> Column:
    """Weeks from START on, from 0."""
    return F.floor(F.datediff(F.to_date(day), F.lit(START)) / 7).cast("long")


def within(estimate: Column, exact: Column, error: float) -> Column:
    """One more is allowed for, as estimates are rounded."""
    return F.abs(estimate - exact) <= 3 * error * exact + 1


def weekly_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and median of each week and kind of event: the exact number, and whether the merged sketches keep their bounds."""
    e = load(spark, sf_dir, "events").where("ts is not null")
    sketch = merged(stored(e), week("day")).select(F.col("range").alias("week"), F.col("event_type").alias("kind"), F.hll_sketch_estimate("users").alias("about"), F.theta_sketch_estimate("members").alias("around"), F.when(F.kll_sketch_get_n_double("spread") > 0, F.kll_sketch_get_quantile_double("spread", F.lit(0.5))).alias("middle"))
    exact = e.groupBy(week("ts").alias("week"), "event_type").agg(F.count_distinct("user_id").alias("users"), F.count("value").alias("n"))
    same = lambda a, b: (a["week"] == b["week"]) & a["event_type"].eqNullSafe(b["kind"])
    rows = e.select(week("ts").alias("week"), "event_type", "value")
    middle = sketch.select("week", "kind", "middle")
    share = rows.join(middle, same(rows, middle)).groupBy(rows["week"].alias("of_week"), rows["event_type"].alias("of_kind")).agg(F.count_if(F.col("value") < F.col("middle")).alias("below"), F.count_if(F.col("value") <= F.col("middle")).alias("up_to"))
    both = exact.join(sketch, same(exact, sketch)).join(share, (exact["week"] == share["of_week"]) & exact["event_type"].eqNullSafe(share["of_kind"]))
    near = (F.col("below") <= F.col("n") * (0.5 + 3 * KLL_ERROR) + 1) & (F.col("up_to") >= F.col("n") * (0.5 - 3 * KLL_ERROR) - 1)
    return both.select(
        exact["week"], "event_type", "users", "n", within(F.col("about"), F.col("users"), HLL_ERROR).alias("hll_holds"), within(F.col("around"), F.col("users"), THETA_ERROR).alias("theta_holds"), near.alias("kll_holds"),
    )


def weekly_viewers_who_bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a view and a purchase in a week: exactly, and whether the intersection of two theta states keeps its bound, which goes with the larger of the two."""
    e = load(spark, sf_dir, "events").where("ts is not null")
    states = merged(stored(e.where(F.col("event_type").isin("view", "purchase"))), week("day"))
    of = lambda kind: states.where(F.col("event_type") == kind).select(F.col("range").alias("week"), F.col("members").alias(kind))
    about = of("view").join(of("purchase"), "week").select("week", F.theta_sketch_estimate(F.theta_intersection("view", "purchase")).alias("about"), F.greatest(F.theta_sketch_estimate("view"), F.theta_sketch_estimate("purchase")).alias("larger"))
    each = e.groupBy(week("ts").alias("week"), "user_id").agg(F.bool_or(F.col("event_type") == "view").alias("viewed"), F.bool_or(F.col("event_type") == "purchase").alias("bought"))
    exact = each.where("viewed and bought and user_id is not null").groupBy("week").agg(F.count("*").alias("users"))
    rows = about.join(exact, "week", "left").fillna(0, ["users"])
    return rows.select("week", "users", (F.abs(F.col("about") - F.col("users")) <= 3 * THETA_ERROR * F.col("larger") + 1).alias("theta_holds"))


QUERIES = {"weekly_sketches": weekly_sketches, "weekly_viewers_who_bought": weekly_viewers_who_bought}
_WEEK = f"cast(floor(date_diff('day', date '{START}', cast(ts as date)) / 7) as bigint)"
ORACLES = {
    "weekly_sketches": f"""
select {_WEEK} as week, event_type, count(distinct user_id) as users, count(value) as n, true as hll_holds, true as theta_holds, true as kll_holds
from events where ts is not null group by 1, 2""",
    "weekly_viewers_who_bought": f"""
with u as (select {_WEEK} as week, user_id, bool_or(event_type = 'view') as viewed, bool_or(event_type = 'purchase') as bought from events where ts is not null group by 1, 2)
select week, count(*) filter (where viewed and bought and user_id is not null) as users, true as theta_holds from u
group by week having bool_or(viewed) and bool_or(bought)""",
}
