"""Vector compression: product quantisation in exact integers, with a kd-tree for each codebook.

A component x becomes the integer floor(scale * x). Vectors are cut into equal consecutive parts, and each position of a part has a
codebook, at first that part of the vectors of the least ids. A round sends the codebooks' kd-trees to all tasks,
assigns every part to its nearest entry, and replaces each entry by the mean of its parts, rounded down. A task adds up
its parts for each entry; Spark adds up the tasks' sums, so what comes to the driver is as large as the codebooks.

The search goes down the tree with all vectors of a batch at a time, the nearer half first. It leaves out a half only if
its box lies farther away than the best entry so far, not if it lies as far, so of entries at an equal distance the
one of the lowest index is found. Numbers are 64-bit integers as long as their squares fit, and Python's own beyond that.

Nulls, ties and the like: a row is dropped whose vector is null or empty, holds a null or a component that isn't finite
(before or after scaling), or is of another length than the first codebook's vectors. Rows with a null id stay, and come
last where ids are ordered. Repeated rows stay; an id that has several vectors gives the codebook the
least of them. Labels are grouped with null as a label of its own. An error beyond 64 bits is null. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import kept, table

#: Below this, the squared distance of two parts of up to 64 components fits 63 bits.
SMALL = 1 << 27
FEW_LABELS, SALTS, LIMB = 10_000, 32, 32


# -- search ------------------------------------------------------------------------------


def whole(values: np.ndarray) -> np.ndarray:
    """Whole numbers held as doubles, as integers of a kind whose squares don't overflow."""
    return values.astype(np.int64) if not values.size or np.abs(values).max() < SMALL else np.vectorize(int, otypes=[object])(values)


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (a, b) if a.dtype == b.dtype else (a.astype(object), b.astype(object))


class KdTree:
    """Nearest entries of a small table of integer points; ties go to the lower index."""

    LEAF = 2

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, items: np.ndarray) -> dict:
        points = self.entries[items]
        node = {"low": points.min(0), "high": points.max(0), "items": items.tolist()}
        spread = node["high"] - node["low"]
        if len(items) > self.LEAF and (spread > 0).any():
            axis = max(range(points.shape[1]), key=lambda i: spread[i])
            order = items[sorted(range(len(items)), key=lambda i: (points[i, axis], items[i]))]
            node["halves"] = self._node(order[: len(order) // 2]), self._node(order[len(order) // 2 :])
        return node

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry."""
        points, entries = alike(points, self.entries)
        none = np.iinfo(np.int64).max if points.dtype == np.int64 else float("inf")
        best, index = np.full(len(points), none, points.dtype), np.full(len(points), len(entries))

        def bound(node: dict, rows: np.ndarray) -> np.ndarray:
            x = points[rows]
            out = np.maximum(np.maximum(node["low"] - x, x - node["high"]), 0)
            return (out * out).sum(1)

        def visit(node: dict, rows: np.ndarray, bounds: np.ndarray) -> None:
            rows = rows[bounds <= best[rows]]
            if not len(rows):
                return
            if "halves" not in node:
                for i in node["items"]:
                    off = points[rows] - entries[i]
                    far = (off * off).sum(1)
                    better = (far < best[rows]) | ((far == best[rows]) & (i < index[rows]))
                    best[rows[better]], index[rows[better]] = far[better], i
                return
            a, b = node["halves"]
            to_a, to_b = bound(a, rows), bound(b, rows)
            first = to_a <= to_b
            for near, far, there, near_by, far_by in ((a, b, first, to_a, to_b), (b, a, ~first, to_b, to_a)):
                visit(near, rows[there], near_by[there])
                visit(far, rows[there], far_by[there])

        visit(self.root, np.arange(len(points)), np.zeros(len(points), points.dtype))
        return index, best


# -- tasks -------------------------------------------------------------------------------


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def chunks(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, most) for at in range(0, batch.num_rows, most))


def limbs(x: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a number in base 2**LIMB; the last digit has the sign, and sums of digits are digits of sums."""
    place = 0
    while not -(1 << LIMB) <= x < 1 << LIMB:
        yield place, x & ((1 << LIMB) - 1)
        x, place = x >> LIMB, place + 1
    yield place, x


def part_sums(vectors: DataFrame, trees: list[KdTree]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each (part, entry) that is nearest to anything: how many parts it has, and their sum by component."""
    shared = vectors.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list[int]] = {}
        for b in chunks(batches):
            rows = matrix(b.column("v"))
            width = rows.shape[1] // len(shared.value)
            for part, tree in enumerate(shared.value):
                points = whole(rows[:, part * width : (part + 1) * width])
                index, _ = tree.nearest(points)
                for entry in np.unique(index).tolist():
                    mine = points[index == entry]
                    new = [len(mine), *map(int, mine.sum(0))]
                    totals[part, entry] = [x + y for x, y in zip(totals[part, entry], new, strict=True)] if (part, entry) in totals else new
        out = [(part, entry, at, place, digit) for (part, entry), values in totals.items() for at, x in enumerate(values) for place, digit in limbs(x)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["part", "entry", "at", "place", "digit"])

    parts = vectors.select("v").mapInArrow(run, "part long, entry long, at long, place long, digit long")
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in parts.groupBy("part", "entry", "at", "place").agg(F.sum("digit").alias("digit")).collect():  # as many rows as the codebooks have numbers
        sums = found.setdefault((r["part"], r["entry"]), {})
        sums[r["at"]] = sums.get(r["at"], 0) + (r["digit"] << LIMB * r["place"])
    shared.unpersist()
    return {key: (sums[0], [sums[i] for i in range(1, len(sums))]) for key, sums in found.items()}


def as_entries(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(x) < SMALL for row in rows for x in row)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), -1)


# -- the operator ------------------------------------------------------------------------


def whole_vectors(df: DataFrame, scale: int = 4096) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is fit for use; v holds the scaled, whole numbers, as doubles."""
    v = F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double"))
    fit = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select("vec_id", "label", v.alias("v")).where(F.col("v").isNotNull()).where(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by numpy, as Spark's floor gives a bigint, which large numbers don't fit
        for b in batches:
            lists = b.column("v")
            down = pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py(), pa.int32()), pa.array(np.floor(lists.flatten().to_numpy(zero_copy_only=False)) + 0.0))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), down], ["vec_id", "label", "v"])

    return rows.mapInArrow(run, rows.schema)


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> list[list[list[int]]]:
    """Of each part, that part of the vectors of the least ids."""
    order = F.asc_nulls_last("vec_id")
    ids = vectors.select("vec_id").distinct().orderBy(order).limit(entries)
    least = vectors.join(F.broadcast(ids.withColumnRenamed("vec_id", "chosen")), F.col("vec_id").eqNullSafe(F.col("chosen")), "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = [list(map(int, r["v"])) for r in least.orderBy(order).collect()]
    if not rows:
        return [[] for _ in range(parts)]
    rows = [r for r in rows if len(r) == len(rows[0])]
    if len(rows[0]) % parts:
        raise ValueError(f"vectors of {len(rows[0])} components can't be cut into {parts} equal parts")
    width = len(rows[0]) // parts
    return [[r[p * width : (p + 1) * width] for r in rows] for p in range(parts)]


def compressed(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code, error) of df(vec_id, embedding, label), and the codebooks by part, entry and component.

    `code` has two hexadecimal digits for each part, `error` is the squared distance of the vector and its code.
    """
    vectors = kept(whole_vectors(df, scale), "vectors")
    books = first_codebooks(vectors, parts, entries)
    length = parts * len(books[0][0]) if books[0] else 0
    vectors = vectors.where(F.size("v") == length)
    trees = lambda: [KdTree(as_entries(b)) for b in books] if length else []
    for _ in range(rounds if length else 0):
        for (part, entry), (n, sums) in part_sums(vectors, trees()).items():
            books[part][entry] = [s // n for s in sums]
    shared = df.sparkSession.sparkContext.broadcast(trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            rows = matrix(b.column("v"))
            found = [tree.nearest(whole(p)) for tree, p in zip(shared.value, np.split(rows, parts, axis=1), strict=True)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            errors = sum(far.astype(object) for _, far in found)
            fits = pa.array([int(e) if e < 1 << 63 else None for e in errors], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes]), fits], ["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), books


def fingerprint(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """With `label_error`, the error summed over the rows of a label."""
    sums = kept(codes.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        return codes.join(F.broadcast(sums), same).drop("of")
    # a label may have a third of all rows: it is dealt to SALTS places
    dealt = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    copies = sums.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, same & (F.col("salt") == F.col("place"))).drop("of", "salt", "place")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compressed(table(spark, sf_dir, "embeddings"))
    out = with_label_errors(kept(codes, "codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """All distances of all rounds, as joins."""
    steps = [f"""
kept as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v from embeddings
         where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cut as (select vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as x from kept, range({parts}) as r(p)),
book0 as (select p, e, x as c from (select p, x, row_number() over (partition by p order by vec_id) - 1 as e from cut) where e < {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
near{i} as materialized (select vec_id, label, p, x, min((d, e)) as best from (
    select vec_id, label, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from cut join book{i} using (p)) group by all)""")
        if i < rounds:
            steps.append(f"""
mean{i} as (select p, e, list(m order by i) as c from (
    select p, best[2] as e, i, cast(floor(cast(sum(x[i]) as double) / count(*)) as bigint) as m from near{i}, unnest(generate_series(1, len(x))) as g(i) group by all) group by all),
book{i + 1} as materialized (select p, e, coalesce(m.c, b.c) as c from book{i} b left join mean{i} m using (p, e))""")
    return "with" + ",".join(steps) + f""",
rows_ as (select vec_id, label, string_agg(format('{{:02x}}', best[2]), '' order by p) as code, cast(sum(best[1]) as bigint) as error from near{rounds} group by vec_id, label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from book{rounds}) as codebooks_sha256
from rows_"""


OP12_SQL = _sql()
