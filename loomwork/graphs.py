"""Recursion to a fixed point over tables: rounds that follow only what the round before has found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.shared import new_folder, until_end, written
from loomwork.tables import load


def hops(pairs: DataFrame, start: DataFrame) -> DataFrame:
    """(node, hops): the least number of steps from start(node) to each node of pairs(node, via); a step leads to all nodes of a common `via`.

    Semi-naive: a round joins its new nodes to their vias, drops the vias seen before, and goes on to nodes not seen before. Nodes of a via
    are never paired with each other, and every pair is followed once from each side, so the work is that of reading the pairs, however hot a via.
    What is seen is appended to two tables, one file set a round; rounds end when one finds nothing, at no fixed depth. Cycles are no matter, nulls lead nowhere.
    """
    spark = pairs.sparkSession
    edges = written(pairs.where("node is not null and via is not null").select("node", "via").distinct(), "pairs")
    folder = new_folder(spark, "hops")
    until_end(spark, folder)
    kind = {"node": dict(edges.dtypes)["node"], "via": dict(edges.dtypes)["via"]}

    def seen(name: str) -> DataFrame:
        return spark.read.schema(f"{name} {kind[name]}, hops long").parquet(f"{folder}/{name}").select(name, "hops")

    def add(df: DataFrame, name: str, depth: int) -> DataFrame:
        path = f"{folder}/{name}/round={depth}"
        df.write.parquet(path)
        return spark.read.schema(f"{name} {kind[name]}, hops long").parquet(path)

    depth = 0
    new = add(start.where("node is not null").select(F.col("node").cast(kind["node"])).distinct().withColumn("hops", F.lit(0).cast("long")), "node", 0)
    spark.createDataFrame([], f"via {kind['via']}, hops long").write.parquet(f"{folder}/via/round=-1")
    while new.limit(1).count():
        depth += 1
        vias = edges.join(new.select("node"), "node", "left_semi").select("via").distinct().join(seen("via"), "via", "left_anti")
        vias = add(vias.withColumn("hops", F.lit(depth).cast("long")), "via", depth)
        nodes = edges.join(vias.select("via"), "via", "left_semi").select("node").distinct().join(seen("node"), "node", "left_anti")
        new = add(nodes.withColumn("hops", F.lit(depth).cast("long")), "node", depth)
    return seen("node")


def supplier_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from the supplier of most pairs to the others, by parts that both have sold many of and had returned."""
    lines = load(spark, sf_dir, "lineitem").where("l_quantity >= 47 and l_returnflag = 'R'")
    pairs = lines.select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("via"))
    first = pairs.where("node is not null and via is not null").distinct().groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(1)
    return hops(pairs, first).select(F.col("node").alias("suppkey"), "hops")


QUERIES = {"supplier_hops": supplier_hops}
ORACLES = {
    "supplier_hops": """
with recursive e as materialized (select distinct l_suppkey as s, l_partkey as p from lineitem where l_quantity >= 47 and l_returnflag = 'R' and l_suppkey is not null and l_partkey is not null),
n as materialized (select distinct a.s as a, b.s as b from e a join e b on a.p = b.p and a.s <> b.s),
h(s, d) as ((select s, 0 from e group by s order by count(*) desc, s limit 1) union select n.b, h.d + 1 from h join n on n.a = h.s where h.d < (select count(distinct s) from e))
select s as suppkey, cast(min(d) as bigint) as hops from h group by s""",
}
