"""Queries over the star schema and the event table, each with the SQL that checks it.

Sums are taken over exact decimals and given as whole numbers of their last digit (e2, e4), so
they don't depend on the order of the rows.
Integers that the two engines give in different widths are cast to bigint on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.shared import written
from loomwork.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def money(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)")


def revenue() -> Column:
    return money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """With `rank` (from 1, by `order`, which must be unique in a group) and `n` of each row's group. Nulls come last, and are a group too.

    Rows are sorted in ranges of (group, order), so a group of any size is spread over tasks; a range's ranks begin
    after the rows of the ranges before it. Joined to all rows are only these counts, one for each group of a range.
    """
    by = [F.asc_nulls_last(c) for c in (group, *order)]
    rows = written(df.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "ranges")
    counts = rows.groupBy(group, "part").agg(F.count("*").alias("here"))
    of = Window.partitionBy(group)
    before = F.coalesce(F.sum("here").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("of"), F.col("part").alias("of_part"), before.alias("before"), F.sum("here").over(of).alias("n"))
    here = F.row_number().over(Window.partitionBy(group, "part").orderBy(*by[1:]))
    same = F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    return rows.withColumn("here", here).join(starts, same).withColumn("rank", F.col("before") + F.col("here")).drop("part", "here", "before", "of", "of_part")


# -- joins and aggregates --------------------------------------------------------------


@query("""
select r_name, n_name,
       cast(10000 * sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))) as bigint) as revenue_e4,
       count(*) as n
from lineitem join orders on l_orderkey = o_orderkey
     join customer on o_custkey = c_custkey
     join nation on c_nationkey = n_nationkey
     join region on n_regionkey = r_regionkey
group by r_name, n_name""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: load(spark, sf_dir, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name", "n_name").agg((10000 * F.sum(revenue())).cast("long").alias("revenue_e4"), F.count("*").alias("n"))


@query("""
select l_returnflag, l_linestatus, count(*) as n,
       cast(100 * sum(cast(l_quantity as decimal(18,2))) as bigint) as quantity_e2,
       min(l_shipdate) as first_ship, max(l_shipdate) as last_ship,
       count(distinct l_orderkey) as orders
from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00'
group by l_returnflag, l_linestatus""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), (100 * F.sum(money("l_quantity"))).cast("long").alias("quantity_e2"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.countDistinct("l_orderkey").alias("orders"))


@query("""
select o_orderkey, o_orderpriority from orders
where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)""")
def orders_with_large_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = load(spark, sf_dir, "lineitem").where("l_quantity > 45")
    orders = load(spark, sf_dir, "orders")
    return orders.join(large, orders["o_orderkey"] == large["l_orderkey"], "left_semi").select("o_orderkey", "o_orderpriority")


@query("""
select o_orderkey, o_custkey from orders
where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""")
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left_anti").select("o_orderkey", "o_custkey")


@query("""
select c_custkey, count(o_orderkey) as orders, max(o_orderdate) as latest
from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F'
group by c_custkey""")
def orders_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    customer = load(spark, sf_dir, "customer")
    return customer.join(done, customer["c_custkey"] == done["o_custkey"], "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.max("o_orderdate").alias("latest"))


@query("""
select c_nationkey, c_mktsegment, cast(grouping(c_nationkey) as bigint) as all_nations,
       cast(grouping(c_mktsegment) as bigint) as all_segments, count(*) as n
from customer group by cube (c_nationkey, c_mktsegment)""")
def customers_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").cube("c_nationkey", "c_mktsegment").agg(F.grouping("c_nationkey").cast("long").alias("all_nations"), F.grouping("c_mktsegment").cast("long").alias("all_segments"), F.count("*").alias("n"))


@query("""
select user_id, count(*) filter (where event_type = 'click') as clicks,
       count(*) filter (where event_type = 'purchase') as purchases
from events group by user_id having count(*) filter (where event_type = 'purchase') > 0""")
def buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"clicks": "click", "purchases": "purchase"}
    return load(spark, sf_dir, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items())).where("purchases > 0")


# -- windows, order, sets --------------------------------------------------------------


@query("""
select o_custkey, o_orderkey, cast(rn as bigint) as rn, cast(rk as bigint) as rk from (
  select o_custkey, o_orderkey,
         row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn,
         rank() over (partition by o_custkey order by o_orderdate) as rk
  from orders) where rn <= 3""")
def top_orders_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("o_custkey")
    ranked = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(own.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rn"), F.rank().over(own.orderBy("o_orderdate")).alias("rk"))
    return ranked.where("rn <= 3").select("o_custkey", "o_orderkey", F.col("rn").cast("long"), F.col("rk").cast("long"))


@query("""
select event_id, user_id, lag(event_type) over w as before, lead(event_type) over w as after,
       count(*) over (partition by user_id order by ts, event_id rows between 4 preceding and current row) as recent
from events window w as (partition by user_id order by ts, event_id)""")
def neighbouring_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select("event_id", "user_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), F.count("*").over(w.rowsBetween(-4, 0)).alias("recent"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest: the limit is what is asked for."""
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("""
select c_nationkey as nationkey from customer intersect select s_nationkey from supplier
except select n_nationkey from nation where n_regionkey = 0""")
def shared_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name, key: load(spark, sf_dir, name).select(F.col(key).alias("nationkey"))
    africa = load(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("nationkey"))
    return t("customer", "c_nationkey").intersect(t("supplier", "s_nationkey")).subtract(africa)


# -- time ------------------------------------------------------------------------------


@query("""
with g as (select *, sum(case when p is null or ts - p >= interval 30 minute then 1 else 0 end)
                     over (partition by user_id order by ts, event_id) as sid
           from (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events))
select user_id, min(ts) as begins, max(ts) + interval 30 minute as ends, count(*) as n
from g group by user_id, sid""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("begins"), F.col("s.end").alias("ends"), "n")


@query("""
select w as begins, event_type, count(*) as n
from (select event_type, unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) as w from events)
group by w, event_type""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("begins"), "event_type", "n")


@query("""
select p.event_id, c.event_id as click_id
from (select * from events where event_type = 'purchase') p
asof left join (select * from events where event_type = 'click') c
on p.user_id = c.user_id and p.ts >= c.ts""")
def click_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: one sort of both kinds by user and time, and the last click seen so far. Linear in the events of a user."""
    e = load(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type")).rowsBetween(Window.unboundedPreceding, 0)
    seen = e.withColumn("click_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w))
    return seen.where("event_type = 'purchase'").select("event_id", "click_id")


@query("""
select cast(year(o_orderdate) as bigint) as year, cast(quarter(o_orderdate) as bigint) as quarter, o_orderstatus,
       count(*) as n, cast(100 * sum(cast(o_totalprice as decimal(18,2))) as bigint) as total_e2
from orders group by all""")
def orders_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year"), F.quarter("o_orderdate").cast("long").alias("quarter"), "o_orderstatus").agg(F.count("*").alias("n"), (100 * F.sum(money("o_totalprice"))).cast("long").alias("total_e2"))


# -- strings, JSON, arrays -------------------------------------------------------------


@query("""
select json_extract_string(props, '$.k') as k, count(*) as n, min(event_id) as first_event
from events group by 1""")
def events_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""
select p_partkey, upper(p_name) as name, cast(length(p_type) as bigint) as type_length,
       case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as class
from part where p_brand like '%1' and p_type in ('ECONOMY', 'LARGE', 'PROMO') and p_size between 5 and 40""")
def parts_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").where(F.col("p_brand").like("%1") & F.col("p_type").isin("ECONOMY", "LARGE", "PROMO") & F.col("p_size").between(5, 40))
    return p.select("p_partkey", F.upper("p_name").alias("name"), F.length("p_type").cast("long").alias("type_length"), F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large").alias("class"))


@query("""
select label, cast(pos as bigint) as pos, count(*) as n, count(*) filter (where x > 0) as positive
from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings)
group by label, pos""")
def embedding_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.count("*").alias("n"), F.count_if(F.col("x") > 0).alias("positive"))


@query("select md5(text) as digest, min(doc_id) as first_doc, count(*) as n from documents group by 1")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


# -- more joins ------------------------------------------------------------------------


@query("""
select a.event_id, b.event_id as later_id from events a join events b
on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval 1 hour""")
def events_within_an_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join: the hour is an equality key, so a user's events meet those of the same or the next hour only."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    a = e.withColumn("hour", F.explode(F.array(F.date_trunc("hour", "ts"), F.date_trunc("hour", F.col("ts") + F.expr("interval 1 hour"))))).alias("a")
    b = e.withColumn("hour", F.date_trunc("hour", "ts")).alias("b")
    near = a.join(b, ["user_id", "hour"]).where("b.ts > a.ts and b.ts <= a.ts + interval 1 hour")
    return near.select(F.col("a.event_id").alias("event_id"), F.col("b.event_id").alias("later_id"))


@query("""
select n_nationkey, count(distinct c_custkey) as customers, count(distinct s_suppkey) as suppliers
from nation left join customer on c_nationkey = n_nationkey left join supplier on s_nationkey = n_nationkey
group by n_nationkey""")
def parties_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side is counted before it is joined, so customers never meet suppliers row by row."""
    count = lambda name, key, n: load(spark, sf_dir, name).groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(n))
    all_ = load(spark, sf_dir, "nation").select("n_nationkey").join(count("customer", "c_nationkey", "customers"), "n_nationkey", "left").join(count("supplier", "s_nationkey", "suppliers"), "n_nationkey", "left")
    return all_.fillna(0, ["customers", "suppliers"])


@query("""
select coalesce(c.k, s.k) as nationkey, c.n as rich_customers, s.n as rich_suppliers
from (select c_nationkey as k, count(*) as n from customer where c_acctbal > 9500 group by 1) c
full join (select s_nationkey as k, count(*) as n from supplier where s_acctbal > 5000 group by 1) s on c.k = s.k""")
def rich_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("rich_customers"))
    s = load(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("rich_suppliers"))
    return c.join(s, "nationkey", "full")


@query("""
select o_orderkey, o_totalprice from orders o
where o_totalprice > 1.5 * (select avg(cast(o_totalprice as decimal(18,2))) from orders i where i.o_custkey = o.o_custkey)""")
def outstanding_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated average, as a join with the averages of all customers."""
    orders = load(spark, sf_dir, "orders")
    mean = orders.groupBy("o_custkey").agg(F.avg(money("o_totalprice")).cast("double").alias("mean"))
    return orders.join(mean, "o_custkey").where("o_totalprice > 1.5 * mean").select("o_orderkey", "o_totalprice")


# -- more aggregates and windows -------------------------------------------------------


@query("""
select p_brand, p_type, count(*) as n, min(p_size) as least_size from part
group by grouping sets ((p_brand), (p_type), (p_brand, p_type), ())""")
def part_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    b, t = F.col("p_brand"), F.col("p_type")
    return p.groupingSets([[b], [t], [b, t], []], b, t).agg(F.count("*").alias("n"), F.min("p_size").alias("least_size"))


@query("""
select year(o_orderdate)::bigint as year, o_orderstatus, count(*) as n, cast(grouping(o_orderstatus) as bigint) as of_all
from orders group by rollup (year(o_orderdate)::bigint, o_orderstatus)""")
def orders_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate").cast("long")).rollup("year", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("long").alias("of_all"))


@query("""
select event_type, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as high,
       round(avg(value), 6) as mean, round(stddev_samp(value), 6) as deviation
from events group by event_type""")
def value_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles from the values at the two ranks around each, so no group's values are held in one place."""
    e = load(spark, sf_dir, "events").select("event_type", "value", "event_id")
    rows = ranked(e.where("value is not null"), "event_type", "value", "event_id")
    r = lambda c, name: F.round(c, 6).alias(name)

    def at(q: float) -> Column:
        place = (F.col("n") - 1) * q
        weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col("rank") - 1 - place))
        return F.sum(F.col("value") * weight)

    near = lambda q: F.abs(F.col("rank") - 1 - (F.col("n") - 1) * q) < 1
    high = rows.where(near(0.5) | near(0.95)).groupBy(F.col("event_type").alias("of")).agg(r(at(0.5), "median"), r(at(0.95), "high"))
    plain = e.groupBy("event_type").agg(r(F.avg("value"), "mean"), r(F.stddev_samp("value"), "deviation"))
    return plain.join(high, F.col("event_type").eqNullSafe(F.col("of")), "left").drop("of")


@query("""
select user_id, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'view') as view
from events group by user_id""")
def events_pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.count("event_id"))
    return p.fillna(0, ["click", "view"])


@query("""
select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as last_hour
from events""")
def events_of_the_last_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr("event_id", "count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as last_hour")


@query("""
select o_orderkey, cast(ntile(4) over w as bigint) as quartile, round(percent_rank() over w, 9) as share, round(cume_dist() over w, 9) as cumulated
from orders window w as (partition by o_orderpriority order by o_totalprice, o_orderkey)""")
def price_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From ranks, as a window would sort each priority in one task."""
    o = ranked(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice", "o_orderkey")
    # the first n % 4 quarters have a row more than the others
    size, more = F.floor(F.col("n") / 4), F.col("n") % 4
    wide = more * (size + 1)
    quartile = F.when(F.col("rank") <= wide, F.ceil(F.col("rank") / (size + 1))).otherwise(more + F.ceil((F.col("rank") - wide) / F.greatest(size, F.lit(1))))
    share = F.when(F.col("n") > 1, (F.col("rank") - 1) / (F.col("n") - 1)).otherwise(0.0)
    return o.select("o_orderkey", quartile.cast("long").alias("quartile"), F.round(share, 9).alias("share"), F.round(F.col("rank") / F.col("n"), 9).alias("cumulated"))


@query("""
select l_suppkey, l_partkey from lineitem where l_returnflag = 'R'
except all select l_suppkey, l_partkey from lineitem where l_returnflag = 'A'""")
def returns_beyond_accepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    of = lambda flag: lines.where(F.col("l_returnflag") == flag).select("l_suppkey", "l_partkey")
    return of("R").exceptAll(of("A"))


# -- nested values ---------------------------------------------------------------------


@query("""
select a.vec_id, b.vec_id as other_id, round(list_sum(list_transform(generate_series(1, 64), lambda i: cast(a.embedding[i] as double) * cast(b.embedding[i] as double))), 5) as dot
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def neighbouring_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("v").alias("u"))
    dot = F.aggregate(F.zip_with("v", "u", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return e.join(other, "vec_id").select("vec_id", "other_id", F.round(dot, 5).alias("dot"))


@query("""
select r_name, list_sort(list(n_name)) as nations from nation join region on n_regionkey = r_regionkey group by r_name""")
def nations_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))


@query("""
select conv_id, count(*) as turns, string_agg(role, '>' order by turn) as roles,
       cast(sum(length(text)) as bigint) as chars
from conversations group by conv_id""")
def conversation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), roles.alias("roles"), F.sum(F.length("text")).alias("chars"))


@query("""
select lower(regexp_extract(url, '^https?://([^/]+)', 1)) as host, count(*) as pages, cast(max(length(html)) as bigint) as longest
from pages group by 1""")
def pages_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").groupBy(F.lower(F.regexp_extract("url", r"^https?://([^/]+)", 1)).alias("host")).agg(F.count("*").alias("pages"), F.max(F.length("html")).cast("long").alias("longest"))


@query("""
with recursive days(d) as (
  select min(date_trunc('day', ts)) from events
  union all select d + interval 1 day from days where d < (select max(date_trunc('day', ts)) from events))
select d as day, count(event_id) as n from days left join events on date_trunc('day', ts) = d group by d""")
def events_of_each_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first day to the last, days without events as well."""
    e = load(spark, sf_dir, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_id")
    days = e.agg(F.min("day").alias("a"), F.max("day").alias("z")).where("a is not null").select(F.explode(F.expr("sequence(a, z, interval 1 day)")).alias("day"))
    return days.join(e.groupBy("day").agg(F.count("event_id").alias("n")), "day", "left").fillna(0, ["n"])


# -- unions, math, approximations ------------------------------------------------------


@query("""
select 'customer' as kind, c_nationkey as nation from customer union select 'supplier', s_nationkey from supplier""")
def nations_of_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind, key: load(spark, sf_dir, kind).select(F.lit(kind).alias("kind"), F.col(key).alias("nation"))
    return of("customer", "c_nationkey").union(of("supplier", "s_nationkey")).distinct()


@query("""
select nation, count(*) as n, cast(100 * sum(balance) as bigint) as balance_e2 from (
  select c_nationkey as nation, cast(c_acctbal as decimal(18,2)) as balance from customer
  union all select s_nationkey, cast(s_acctbal as decimal(18,2)) from supplier) group by nation""")
def balances_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind, x: load(spark, sf_dir, kind).select(F.col(f"{x}_nationkey").alias("nation"), money(f"{x}_acctbal").alias("balance"))
    both = of("customer", "c").unionByName(of("supplier", "s"))
    return both.groupBy("nation").agg(F.count("*").alias("n"), (100 * F.sum("balance")).cast("long").alias("balance_e2"))


@query("""
select p_partkey, cast(floor(p_retailprice) as bigint) as down, cast(ceil(p_retailprice) as bigint) as up,
       round(sqrt(p_retailprice), 6) as root, round(pow(p_size, 1.5), 6) as power, round(ln(p_retailprice), 6) as log,
       p_size % 7 as rest, cast(sign(p_size - 25) as bigint) as side, abs(p_size - 25) as off, greatest(p_size, 10) as least_ten
from part""")
def part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.floor(price).alias("down"), F.ceil(price).alias("up"), F.round(F.sqrt(price), 6).alias("root"), F.round(F.pow(size, F.lit(1.5)), 6).alias("power"), F.round(F.log(price), 6).alias("log"),
        (size % 7).alias("rest"), F.signum(size - 25).cast("long").alias("side"), F.abs(size - 25).alias("off"), F.greatest(size, F.lit(10)).alias("least_ten"),
    )


@query("""
select lang, cast(sum(len(string_split(text, ' '))) as bigint) as pieces, cast(max(len(string_split(text, chr(10)))) as bigint) as most_lines,
       count(*) filter (where len(list_filter(string_split(text, ' '), lambda x: length(x) > 12)) > 0) as with_long
from documents group by lang""")
def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    longest = F.array_max(F.transform(F.split("text", " "), F.length))
    return d.groupBy("lang").agg(F.sum(F.size(F.split("text", " "))).alias("pieces"), F.max(F.size(F.split("text", "\n"))).cast("long").alias("most_lines"), F.count_if(longest > 12).alias("with_long"))


@query("""
select event_type, true as distinct_users_close, true as median_close from events group by event_type""")
def sketches_are_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of a fixed size against exact figures: users to 15 %, the median to a twentieth of the ranks."""
    e = load(spark, sf_dir, "events")
    sketch = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.03).alias("about"), F.percentile_approx("value", 0.5, 1000).alias("middle"))
    users = e.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("user_id").alias("users"))
    below = e.join(sketch, "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("middle")).cast("double")).alias("share"))
    all_ = sketch.join(users, "event_type").join(below, "event_type")
    return all_.select("event_type", (F.abs(F.col("about") - F.col("users")) <= 0.15 * F.col("users")).alias("distinct_users_close"), (F.abs(F.col("share") - 0.5) < 0.05).alias("median_close"))


@query("""
select user_id, event_id, dense_rank() over (partition by user_id order by event_type) as kind,
       first_value(event_id) over w as first_event, nth_value(event_id, 2) over w as second_event
from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)""")
def places_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast("long")
    return load(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"), F.first("event_id").over(w).alias("first_event"), F.nth_value("event_id", 2).over(w).alias("second_event"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 10")
def next_dearest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20)


@query("""
select s_suppkey, count(c_custkey) as richer from supplier left join customer on c_nationkey = s_nationkey and c_acctbal > s_acctbal
group by s_suppkey""")
def richer_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join by an inequality beside the nation, without its pairs: a supplier's rank among all parties less that among suppliers.

    What has no nation or no balance is richer than nobody, and nobody is richer than it.
    """
    known = F.col("nation").isNotNull() & F.col("debt").isNotNull()
    every = load(spark, sf_dir, "supplier").select("s_suppkey")
    c = load(spark, sf_dir, "customer").where("c_custkey is not null").select(F.col("c_nationkey").alias("nation"), (-F.col("c_acctbal")).alias("debt"), F.lit(True).alias("customer"), F.col("c_custkey").alias("party"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (-F.col("s_acctbal")).alias("debt"), F.lit(False).alias("customer"), F.col("s_suppkey").alias("party"))
    order = ["debt", "customer", "party"]  # at equal balances the supplier comes first
    among_all = ranked(c.union(s).where(known), "nation", *order).where(~F.col("customer")).select(F.col("party").alias("s_suppkey"), "rank")
    own = ranked(s.where(known), "nation", *order).select(F.col("party").alias("s_suppkey"), F.col("rank").alias("own"))
    return every.join(among_all.join(own, "s_suppkey"), "s_suppkey", "left").select("s_suppkey", F.coalesce(F.col("rank") - F.col("own"), F.lit(0)).alias("richer"))


@query("""
with recursive chain(event_id, depth) as (
  select min(event_id), 0 from events
  union all select e.event_id, depth + 1 from chain c join events e on e.event_id = 2 * c.event_id + 1 where depth < 40)
select event_id, cast(depth as bigint) as depth from chain""")
def doubling_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive query: one join for each step, which ends when a step finds no event."""
    view = f"loomwork_{uuid.uuid4().hex}"
    load(spark, sf_dir, "events").select("event_id").createOrReplaceTempView(view)
    try:
        return spark.sql(f"""
        with recursive chain(event_id, depth) as (
          select min(event_id), 0 from {view}
          union all select e.event_id, depth + 1 from chain c join {view} e on e.event_id = 2 * c.event_id + 1 where depth < 40)
        select event_id, cast(depth as bigint) as depth from chain""")
    finally:
        spark.catalog.dropTempView(view)
