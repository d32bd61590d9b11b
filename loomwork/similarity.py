"""Exact nearest neighbours by an inverted file of k-means cells.

Every vector lies in the cell of its nearest centre. A query first searches the cells nearest to it; the k-th distance
found there then rules out each cell that is farther away than that, by the triangle inequality: its centre's distance less its radius. What is left is
searched too, so nothing is missed, whatever the data; how much is ruled out depends on how well they fall into cells.

A cell is cut into blocks of about `block` vectors, its queries into blocks of about `block` queries, and a task sees one of each at a time.
From a block each query takes its k best only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.shared import written
from loomwork.tables import load

#: Room for the rounding of distances when cells and candidates are ruled out.
SLACK = 1e-7


def rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a to each of b, by a product of matrices; right to about SLACK for lengths near 1."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def centres(vectors: DataFrame, cells: int, sample: int, rounds: int = 8) -> np.ndarray:
    """By k-means over `sample` vectors at most, those whose ids hash lowest."""
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").toArrow()
    if not len(drawn):
        return np.zeros((0, 1))
    points = rows_of(drawn.column("v"))
    found = points[: max(1, min(cells, math.isqrt(len(points))))].copy()
    for _ in range(rounds):
        near = distances(points, found).argmin(1)
        for i in range(len(found)):
            if (near == i).any():
                found[i] = points[near == i].mean(0)
    return found


def in_cells(vectors: DataFrame, centre: np.ndarray) -> DataFrame:
    """(vec_id, v, cell, off): the nearest centre, and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = distances(rows_of(b.column("v")), centre)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(d.argmin(1)), pa.array(d.min(1))], ["vec_id", "v", "cell", "off"])

    return vectors.mapInArrow(run, "vec_id long, v array<double>, cell long, off double")


def _probes(queries: DataFrame, choose: Callable[[np.ndarray, np.ndarray], np.ndarray], centre: np.ndarray) -> DataFrame:
    """(vec_id, v, cell) for each cell that `choose` marks, of the distances to all centres and the query's `bound`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                marked = choose(distances(rows_of(b.column("v")), centre), b.column("bound").to_numpy(zero_copy_only=False))
                row, cell = np.nonzero(marked)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(row)), b.column("v").take(pa.array(row)), pa.array(cell)], ["vec_id", "v", "cell"])

    return queries.select("vec_id", "v", "bound").mapInArrow(run, "vec_id long, v array<double>, cell long")


def _searched(points: DataFrame, probes: DataFrame, k: int, block: int) -> DataFrame:
    """(vec_id, near_id, distance): the k best of each block for each query, the query's own id left out."""
    sizes = lambda df, name: df.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).alias(name))
    of = written(sizes(points, "parts").join(sizes(probes, "turns"), "cell"), "cell-sizes")  # a row for each cell
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = points.join(F.broadcast(of), "cell").select("cell", "vec_id", "v", deal("parts").alias("part"), each("turns").alias("turn"))
    right = probes.join(F.broadcast(of), "cell").select("cell", "vec_id", "v", deal("turns").alias("turn"), each("parts").alias("part"))
    schema = pa.schema([("vec_id", pa.int64()), ("near_id", pa.int64()), ("distance", pa.float64())])

    def search(have: pa.Table, want: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if len(have) and len(want):
            ids, rows = have.column("vec_id").to_numpy(), rows_of(have.column("v"))
            asked, vectors = want.column("vec_id").to_numpy(), rows_of(want.column("v"))
            rough = distances(vectors, rows)
            for i, q in enumerate(asked):
                other = np.flatnonzero(ids != q)
                near = rough[i, other]
                if len(other) > k:
                    other = other[near <= np.partition(near, k - 1)[k - 1] + SLACK]
                exact = np.sqrt(((rows[other] - vectors[i]) ** 2).sum(1))
                best = np.lexsort((ids[other], exact))[:k]
                out += zip([int(q)] * len(best), ids[other[best]].tolist(), exact[best].tolist(), strict=True)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), schema.types, strict=True)], schema=schema)

    keys = ["cell", "part", "turn"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "vec_id long, near_id long, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("vec_id").orderBy("distance", "near_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, cells: int = 128, sample: int = 10_000, probes: int = 4, block: int = 4096) -> DataFrame:
    """(vec_id, place, near_id, distance): the k nearest of vectors(vec_id, embedding) to each row that `queries` marks.

    Rows without an id, without a vector, or with a null or non-finite component are left out, and so are vectors of
    another length than most have. Ids should be unique: an id is never its own neighbour. Ties go to the lower id.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    fit = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    points = written(vectors.select("vec_id", v.alias("v")).where("vec_id is not null and v is not null").where(fit), "vectors")
    length = points.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("of")).orderBy(F.desc("of"), "n").first()
    points = points.where(F.size("v") == (length["n"] if length else 0))
    centre = centres(points, cells, sample)
    held = written(in_cells(points, centre), "cells") if len(centre) else points.select("vec_id", "v", F.lit(0).cast("long").alias("cell"), F.lit(0.0).alias("off"))
    count, radius = np.zeros(len(centre), np.int64), np.zeros(len(centre))
    for r in held.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("off")).collect():  # a row for each cell
        count[r["cell"]], radius[r["cell"]] = r["n"], r["off"]

    def first(to: np.ndarray, _: np.ndarray) -> np.ndarray:
        """The nearest `probes` cells, and as many more as it takes to have k neighbours."""
        order = to.argsort(1, kind="stable")
        before = np.cumsum(count[order], 1) - count[order]
        marked = np.zeros(to.shape, bool)
        np.put_along_axis(marked, order, (before < k + 1) | (np.arange(to.shape[1]) < probes), 1)
        return marked & (count > 0)

    def rest(to: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return ~first(to, bound) & (count > 0) & (to - radius <= bound[:, None] + SLACK)

    asked = held.where(queries).select("vec_id", "v", F.lit(float("inf")).alias("bound"))
    near = written(_best(_searched(held, _probes(asked, first, centre), k, block), k), "near")
    bounds = near.groupBy("vec_id").agg(F.when(F.count("*") == k, F.max("distance")).otherwise(float("inf")).alias("bound"))
    again = asked.drop("bound").join(bounds, "vec_id", "left").fillna(float("inf"), ["bound"])
    far = _searched(held, _probes(again, rest, centre), k, block)
    return _best(near.drop("place").unionByName(far), k).select("vec_id", F.col("place").cast("long").alias("place"), "near_id", "distance")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to each whose id is divisible by 20."""
    found = nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("vec_id", "place", "near_id", F.round("distance", 6).alias("distance"))


QUERIES = {"nearest_vectors": nearest_vectors}
ORACLES = {
    "nearest_vectors": """
with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
d as (select q.vec_id, p.vec_id as near_id, sqrt(list_sum(list_transform(list_zip(q.v, p.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as distance
      from e q join e p on p.vec_id <> q.vec_id and q.vec_id % 20 = 0)
select vec_id, place, near_id, round(distance, 6) as distance
from (select *, row_number() over (partition by vec_id order by distance, near_id) as place from d) where place <= 10""",
}
