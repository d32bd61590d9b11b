"""Connected components of an edge table, without any vertex's neighbours in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of edges(a, b): the least vertex it is connected with.

    Each round takes the least label among neighbours, then follows that label to its own
    label, so paths shorten by halves. Both steps are joins and a minimum that is combined
    before the shuffle; a vertex of very many edges is a skewed inner join, which Spark splits.
    """
    edges = edges.where("a != b").select("a", "b").distinct()
    both = kept(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = kept(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("v") == F.col("a")).select("v", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("label").alias("after"))
        new = kept(step.join(jump, "next").select("v", F.least("next", "after").alias("label"), (F.least("next", "after") != F.col("label")).alias("moved")), "labels")
        labels = new.select("v", "label")
        if not new.where("moved").limit(1).count():
            return labels
