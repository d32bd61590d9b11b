"""An aggregate of one's own that merges: trimmed means from digests of each group.

A digest is a row of centres with weights in the order of their means, small where little is below or above. A task makes one of each group it
sees, and digests are merged in two levels, the first by a part of the tasks each, so no group's values come to one task: what does are
digests of at most SIZE + 2 centres. A merge keeps every centre within one step of an arcsine scale, 2 * pi / SIZE * sqrt(q * (1 - q)) of all weight at the
quantile q; sums are kept exactly, so a trimmed mean is off only by the centres that a cut goes through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.relational import ranked
from loomwork.tables import load

SIZE, LEVELS = 400, 3
#: Centres that a task holds before it gives out its digests and begins new ones.
HELD = 1 << 21


def merged(means: np.ndarray, weights: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Of centres in any order: fewer, in order."""
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    total = weights.sum()
    middle = (np.cumsum(weights) - weights / 2) / max(total, 1)
    step = np.floor(size / (2 * math.pi) * np.arcsin(np.clip(2 * middle - 1, -1, 1)))
    first = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])) if len(step) else np.zeros(0, np.int64)
    if not len(first):
        return means, weights
    sums = np.add.reduceat(weights, first)
    return np.add.reduceat(means * weights, first) / sums, sums


def trimmed(means: np.ndarray, weights: np.ndarray, cut: int) -> float | None:
    """The mean of all but the `cut` least and the `cut` greatest."""
    end = np.cumsum(weights)
    total = int(end[-1]) if len(end) else 0
    inside = np.clip(np.minimum(end, total - cut) - np.maximum(end - weights, cut), 0, None)
    return float((means * inside).sum() / inside.sum()) if inside.sum() else None


def error(share: float) -> float:
    """How far a trimmed mean may be off, of the whole range of values: each cut by a centre's weight for each level."""
    return 2 * LEVELS * (2 * math.pi / SIZE * math.sqrt(share * (1 - share))) / (1 - 2 * share)


def digests(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, means, weights) of each group's values that are numbers; a null group is one of its own."""
    key = dict(df.dtypes)[group]
    schema = f"part long, {group} {key}, means array<double>, weights array<double>"
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(group, F.col(value).cast("double").alias("value"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, room = TaskContext.get().partitionId(), {}, 0

        def given() -> pa.RecordBatch:
            small = {k: merged(np.concatenate(m), np.concatenate(w)) for k, (m, w) in held.items()}
            columns = [pa.array([part] * len(small), pa.int64()), pa.array(list(small), batch.schema.field(0).type), pa.array([m for m, _ in small.values()], pa.list_(pa.float64())), pa.array([w for _, w in small.values()], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, ["part", group, "means", "weights"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode(null_encoding="encode")
            code, values = names.indices.to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(code, kind="stable")
            for k, mine in zip(names.dictionary.to_pylist(), np.split(values[order], np.searchsorted(code[order], np.arange(1, len(names.dictionary)))), strict=True):
                means, weights = merged(mine, np.ones(len(mine)))
                room += len(means)
                have = held.setdefault(k, ([], []))
                have[0].append(means)
                have[1].append(weights)
                if len(have[0]) > 32:
                    m, w = merged(np.concatenate(have[0]), np.concatenate(have[1]))
                    room += len(m) - sum(map(len, have[0]))
                    held[k] = ([m], [w])
            if room > HELD:
                yield given()
                held, room = {}, 0
        if held:
            yield given()

    def join(table: pa.Table) -> pa.Table:
        flat = lambda name: np.concatenate([np.zeros(0), *(np.asarray(x) for x in table.column(name).to_pylist())])
        means, weights = merged(flat("means"), flat("weights"))
        return pa.table({"part": pa.array([0], pa.int64()), group: table.column(group).slice(0, 1), "means": pa.array([means], pa.list_(pa.float64())), "weights": pa.array([weights], pa.list_(pa.float64()))})

    tasks = rows.mapInArrow(make, schema)
    fan = max(2, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    halfway = tasks.groupBy((F.col("part") % fan).alias("of"), group).applyInArrow(join, schema)
    return halfway.groupBy(group).applyInArrow(join, schema).drop("part")


def trimmed_values(spark: SparkSession, sf_dir: str, share: float = 0.1) -> DataFrame:
    """Of each kind of event the mean of its values without a tenth at each end: from all ranks, and whether the digest's is as near as proven."""
    e = load(spark, sf_dir, "events").select("event_type", "value", "event_id").where("value is not null and not isnan(value)")

    def from_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for means, weights in zip(b.column("means").to_pylist(), b.column("weights").to_pylist(), strict=True):
                m, w = np.asarray(means), np.asarray(weights)
                out.append(trimmed(m, w, int(round(w.sum())) * round(share * 1000) // 1000))
            yield pa.RecordBatch.from_arrays([b.column("event_type"), pa.array(out, pa.float64())], ["kind", "about"])

    about = digests(e, "event_type", "value").mapInArrow(from_digest, "kind string, about double")
    cut = F.floor(F.col("n") * round(share * 1000) / 1000)
    inside = (F.col("rank") > cut) & (F.col("rank") <= F.col("n") - cut)
    exact = ranked(e, "event_type", "value", "event_id").groupBy("event_type").agg(F.first("n").alias("n"), F.avg(F.when(inside, F.col("value"))).alias("mean"), (F.max("value") - F.min("value")).alias("range"))
    both = exact.join(about, F.col("event_type").eqNullSafe(F.col("kind")))
    return both.select("event_type", "n", F.round("mean", 6).alias("trimmed_mean"), (F.abs(F.col("about") - F.col("mean")) <= error(share) * F.col("range") + 1e-9).alias("digest_holds"))


QUERIES = {"trimmed_values": trimmed_values}
ORACLES = {
    "trimmed_values": """
with r as (select event_type, value, row_number() over (partition by event_type order by value, event_id) as rank, count(*) over (partition by event_type) as n
           from events where value is not null and not isnan(value))
select event_type, any_value(n) as n, round(avg(value) filter (where rank > n * 100 // 1000 and rank <= n - n * 100 // 1000), 6) as trimmed_mean, true as digest_holds
from r group by event_type""",
}
