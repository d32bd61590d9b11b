"""Correlated top-k: for each row of one table the last k rows of another before it, without a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.relational import ranked
from loomwork.tables import load


def last_before(left: DataFrame, right: DataFrame, key: str, time: str, order: str, k: int) -> DataFrame:
    """(id, place, other): for each left(id, key, time) the k last rows of right(id, key, time) up to and with its time, the latest at place 1.

    What a lateral subquery with an order and a limit asks for, decorrelated: right rows are numbered within their key, and a left row's
    number of right rows so far is its rank among all rows less its rank among the left ones. So it is joined by equality to k numbers, not to all that is before it,
    and ranks are taken over ranges, so a key of any size is spread. Rows with a null key or time have and are no match; equal times go by id, right rows first.
    """
    known = F.col(key).isNotNull() & F.col(time).isNotNull()
    a = left.where(known).select(F.col(order).alias("id"), key, time, F.lit(1).alias("side"))
    b = right.where(known).select(F.col(order).alias("id"), key, time, F.lit(0).alias("side"))
    among_all = ranked(a.union(b), key, time, "side", "id").where("side = 1").select("id", key, F.col("rank").alias("all"))
    among_left = ranked(a, key, time, "id").select("id", F.col("rank").alias("own"))
    numbered = ranked(b, key, time, "id").select(F.col("id").alias("other"), F.col(key).alias("of"), F.col("rank").alias("number"))
    so_far = among_all.join(among_left, "id").select("id", key, (F.col("all") - F.col("own")).alias("seen"))
    wanted = so_far.select("id", key, "seen", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("place")).where("place <= seen")
    same = (F.col(key) == F.col("of")) & (F.col("seen") - F.col("place") + 1 == F.col("number"))
    return wanted.join(numbered, same).select("id", F.col("place").cast("long").alias("place"), "other")


def views_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase's three last views by the same user."""
    e = load(spark, sf_dir, "events")
    of = lambda kind: e.where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    found = last_before(of("purchase"), of("view"), "user_id", "ts", "event_id", 3)
    return found.select(F.col("id").alias("purchase_id"), "place", F.col("other").alias("view_id"))


QUERIES = {"views_before_purchases": views_before_purchases}
ORACLES = {
    "views_before_purchases": """
select p.event_id as purchase_id, v.place, v.event_id as view_id
from events p, lateral (select event_id, row_number() over (order by ts desc, event_id desc) as place from events v
                        where v.event_type = 'view' and v.user_id = p.user_id and v.ts <= p.ts order by ts desc, event_id desc limit 3) v
where p.event_type = 'purchase'""",
}
