"""Join of intervals of any length, without comparing all pairs.

Two closed intervals overlap if and only if the later of their starts lies in both. So each pair is found once: where one start lies in the other
interval. Time is halved again and again; an interval is cut into the largest whole halves that
make it up, two of each size at most, and a start lies in one half of each size. The halves of an interval don't overlap, so a start meets
it in one of them at most, and no pair comes twice. As good as every meeting is a result: only at the finest size, of `unit`, are the ends compared.

The meetings are counted beforehand, half by half, and set the number of tasks; a half with more than MEETINGS is split among several. Rows with keys
meet those of the other table directly where these are FEW of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.shared import written
from loomwork.tables import load

SIZES = 40
FEW = 64
MEETINGS = 1 << 23


def halves(start: Column, end: Column, sizes: int = SIZES) -> Column:
    """array<struct<size, place>>: the halves that make up the units start to end (both in), fewer than 2**sizes, `place` counted in steps of 2**size units."""

    def of(size: int) -> list[Column]:
        # what is left at this size begins at the first whole half at or after start, and ends at the last before end
        low, high = F.ceil(start / (1 << size)).cast("long"), F.floor((end + 1) / (1 << size)).cast("long") - 1
        one = lambda at, there: F.when(there, F.struct(F.lit(size).alias("size"), at.alias("place")))
        # an odd first one is not the first of a larger half, an even last one not its second
        alone = F.pmod(low, F.lit(2)) == 1
        return [one(low, (low <= high) & alone), one(high, (low <= high) & (F.pmod(high, F.lit(2)) == 0) & ~((low == high) & alone))]

    return F.array_compact(F.array(*(h for size in range(sizes) for h in of(size))))


def starts_in(starts: DataFrame, spans: DataFrame, keys: list[str], after: bool = False) -> DataFrame:
    """(id, other) with the start of `id` in the interval of `other` (or, with `after`, behind its start), of tables (keys, id, low, high, low_unit, high_unit)."""
    longest = spans.agg(F.max(F.col("high_unit") - F.col("low_unit") + 1)).first()[0] or 0
    cut = written(spans.select(*keys, F.col("id").alias("other"), F.col("low").alias("from"), F.col("high").alias("to"), F.explode(halves(F.col("low_unit"), F.col("high_unit"), min(SIZES, max(1, longest.bit_length())))).alias("half")).select("*", "half.size", "half.place").drop("half"), "halves")
    sizes = [r["size"] for r in cut.select("size").distinct().collect()]  # SIZES at most
    if not sizes:
        return starts.select("id", F.col("id").alias("other")).limit(0)
    at = F.array(*(F.struct(F.lit(s).alias("size"), F.floor(F.col("low_unit") / (1 << s)).cast("long").alias("place")) for s in sizes))
    points = starts.select(*keys, "id", "low", F.explode(at).alias("half")).select("*", "half.size", "half.place").drop("half")
    inside = F.col("low") > F.col("from") if after else F.col("low") >= F.col("from")
    points, cut, on = spread(points, cut, [*keys, "size", "place"])
    return points.join(cut, on).where(inside & (F.col("low") <= F.col("to"))).select("id", "other")


def spread(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an inner join and its columns, such that no task has many more than MEETINGS pairs: by its bytes alone a partition doesn't show how many it has."""
    count = lambda df, name: df.groupBy(on).agg(F.count("*").alias(name))
    pairs = F.col("n").cast("double") * F.col("m")
    met = written(count(left, "n").join(count(right, "m"), on).select(*on, F.ceil(pairs / MEETINGS).cast("int").alias("shares"), pairs.alias("pairs")), "meetings")
    total, most = met.agg(F.sum("pairs"), F.max("shares")).first()
    if (total or 0) <= MEETINGS:
        return left, right, on
    if most > 1:
        hot = met.where("shares > 1").select(*on, "shares")
        shares = F.coalesce("shares", F.lit(1))
        left = left.join(hot, on, "left").withColumn("part", F.pmod(F.xxhash64("id", "low"), shares).cast("int")).drop("shares")
        right = right.join(hot, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
        on = [*on, "part"]
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 14, int(total // MEETINGS) + 1))
    return left.repartition(tasks, *on), right.repartition(tasks, *on), on


def overlaps(left: DataFrame, right: DataFrame, start: str, end: str, keys: list[str] | None = None, unit: float = 3600) -> DataFrame:
    """(left_id, right_id) of all rows (id, start, end, keys) whose closed intervals share a moment and whose keys are equal.

    Null ids, ends and keys and intervals that end before they start overlap nothing. `unit` is in seconds; results don't depend on it.
    """
    keys = keys or []

    def ready(df: DataFrame) -> DataFrame:
        seconds = lambda c: F.unix_micros(F.col(c).cast(T.TimestampType())) / 1e6
        in_units = lambda c: F.floor(seconds(c) / unit).cast("long")
        known = [F.col(c).isNotNull() for c in ("id", start, end, *keys)]
        fit = F.col(start) <= F.col(end)
        for c in known:
            fit &= c
        return df.where(fit).select(*keys, "id", F.col(start).alias("low"), F.col(end).alias("high"), in_units(start).alias("low_unit"), in_units(end).alias("high_unit"))

    a, b = ready(left), ready(right)
    if not keys:
        return _by_halves(a, b, keys)
    b = written(b.withColumn("n", F.count("*").over(Window.partitionBy(keys))), "spans_by_key")
    few, many = (b.where(of).drop("n") for of in (F.col("n") <= FEW, F.col("n") > FEW))
    other = few.select(*keys, F.col("id").alias("right_id"), F.col("low").alias("from"), F.col("high").alias("to"))
    direct = a.join(other, keys).where((F.col("low") <= F.col("to")) & (F.col("from") <= F.col("high"))).select(F.col("id").alias("left_id"), "right_id")
    if many.isEmpty():
        return direct
    return direct.unionByName(_by_halves(written(a.join(many.select(keys).distinct(), keys, "left_semi"), "many_of_key"), many, keys))


def _by_halves(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    later = starts_in(a, b, keys).select(F.col("id").alias("left_id"), F.col("other").alias("right_id"))
    # equal starts are in the first part
    earlier = starts_in(b, a, keys, after=True).select(F.col("other").alias("left_id"), F.col("id").alias("right_id"))
    return later.unionByName(earlier)


def spans_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order from its first date to its last, of ordering or shipping."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    orders = load(spark, sf_dir, "orders")
    both = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.least("o_orderdate", "first").alias("begins"), F.greatest("o_orderdate", "last").alias("ends"))


def orders_open_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders that were open on a common day."""
    spans = written(spans_of_orders(spark, sf_dir), "spans")
    pairs = overlaps(spans, spans, "begins", "ends", ["customer"], unit=7 * 86400)
    return pairs.where("left_id < right_id").select(F.col("left_id").alias("orderkey"), F.col("right_id").alias("other_orderkey"))


def sessions_with(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    s = load(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.min("event_id").alias("id"), F.count_if(F.col("event_type") == kind).alias("n"))
    return s.where("n > 0").select("id", "user_id", F.col("s.start").alias("begins"), F.col("s.end").alias("ends"))


def signups_during_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a signup and sessions with an error, of any users, that overlap; each named by its first event."""
    pairs = overlaps(written(sessions_with(spark, sf_dir, "signup"), "sessions"), written(sessions_with(spark, sf_dir, "error"), "sessions"), "begins", "ends", unit=900)
    return pairs.select(F.col("left_id").alias("signup_session"), F.col("right_id").alias("error_session"))


QUERIES = {"orders_open_together": orders_open_together, "signups_during_errors": signups_during_errors}
ORACLES = {
    "orders_open_together": """
with s as (select o_orderkey, o_custkey, least(o_orderdate, min(l_shipdate)) as begins, greatest(o_orderdate, max(l_shipdate)) as ends
           from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_custkey, o_orderdate)
select a.o_orderkey as orderkey, b.o_orderkey as other_orderkey from s a join s b
on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.begins <= b.ends and b.begins <= a.ends""",
    "signups_during_errors": """
with g as (select *, sum(case when p is null or ts - p >= interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id) as sid
           from (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events)),
s as (select min(event_id) as id, min(ts) as begins, max(ts) + interval 30 minute as ends, bool_or(event_type = 'signup') as signup, bool_or(event_type = 'error') as error from g group by user_id, sid)
select a.id as signup_session, b.id as error_session from s a join s b on a.signup and b.error and a.begins <= b.ends and b.begins <= a.ends""",
}
