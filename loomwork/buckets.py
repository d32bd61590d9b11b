"""Tables in sorted buckets, which are joined and grouped by their bucketing columns without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.shared import until_end
from loomwork.tables import load

BUCKET_BYTES = 128 << 20


def buckets_for(df: DataFrame, at_least: int = 8) -> int:
    """A power of two, so that tables of different sizes share a divisor; by the planner's estimate of the bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(at_least, 1 << max(0, (size // BUCKET_BYTES)).bit_length())


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The table as written in `buckets` buckets by `keys`, sorted by them in each, in the warehouse until the application ends.

    Rows are dealt to their buckets first, so that a bucket is one sorted file. A catalogue that outlives the application keeps the table's name.
    """
    spark = df.sparkSession
    name = f"loomwork_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    until_end(spark, spark.sql(f"describe formatted {name}").where("col_name = 'Location'").first()["data_type"])
    return spark.table(name)


def line_totals_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the number and price of their lines, from two tables in buckets by the order's key: neither the grouping nor the join moves a row.

    Orders without lines have none and no price. Keys that are null match nothing.
    """
    orders, lines = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), load(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    n = max(buckets_for(orders), buckets_for(lines))
    left, right = bucketed(orders, ["o_orderkey"], n), bucketed(lines, ["l_orderkey"], n)
    totals = right.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"))
    both = left.hint("merge").join(totals, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.select("o_orderkey", "o_orderpriority", F.coalesce("lines", F.lit(0)).alias("lines"), (100 * F.col("price")).cast("long").alias("price_e2"))


QUERIES = {"line_totals_of_orders": line_totals_of_orders}
ORACLES = {
    "line_totals_of_orders": """
select o_orderkey, o_orderpriority, coalesce(lines, 0) as lines, price_e2
from orders left join (select l_orderkey, count(*) as lines, cast(100 * sum(cast(l_extendedprice as decimal(18,2))) as bigint) as price_e2 from lineitem group by 1) on l_orderkey = o_orderkey""",
}
