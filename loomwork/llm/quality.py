"""Quality by Bradley-Terry ranking.

A document's score is a linear function of features of its whole text. Its weights
come from preference pairs: in each pair a document labelled good beats one labelled
bad, and the logistic loss of the difference of the two feature vectors is minimised.
The threshold is the quantile of the training scores at the share of bad documents;
the score is moved so that 0.5 lies there.

All usable labels are learned from. Their documents are dealt by a hash of the id to groups of about `group`, and in its group every good one
meets every bad one, so the pairs grow with the rows, not with their square; up to `group` rows, all pairs are taken. If there are fewer than LEAST
of a class to a group, they are dealt to several groups each. Tasks add up the gradient and the second derivatives of their groups; these sums are all that the
driver sees. The threshold is the exact quantile, found by counting in ever narrower bins.
The features of all documents are made in one pass over the texts and written; training and scoring read them. The order of rows doesn't matter.

Nulls: a null text counts as an empty one, which has a defined score (features 0).
A null id is never held out. Repeated rows score alike. Without labels of both
classes every score is 0.5. An empty table gives no rows; a score that equals the threshold counts as good.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import kept, remainder, table
from loomwork.llm.text import slices, sums, words

LOWER, UPPER, DIGIT = range(97, 123), range(65, 91), range(48, 58)
MARKS = [b for b in range(33, 127) if b not in {*LOWER, *UPPER, *DIGIT}]
#: Group of each byte: a mark of ASCII has one of its own.
GROUP = np.full(256, 5)
GROUP[0:33] = 4
for _group, _bytes in enumerate((LOWER, UPPER, DIGIT, [10])):
    GROUP[list(_bytes)] = _group
GROUP[MARKS] = 6 + np.arange(len(MARKS))
GROUPS = 6 + len(MARKS)
LEAST = 32


def features(column: pa.Array) -> np.ndarray:
    """One row for each text."""
    w = words(column)
    n = len(column)
    size = np.maximum(np.diff(w.offsets), 1)[:, None]
    doc = np.repeat(np.arange(n), np.diff(w.offsets))
    shares = np.bincount(doc * GROUPS + GROUP[w.data], minlength=n * GROUPS).reshape(n, GROUPS) / size
    count = np.maximum(w.counts, 1)
    h, of = w.hashes(), w.docs()
    length = (w.ends - w.starts).astype(float)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    # distinct words of each text: sort by text and hash, count changes
    order = np.lexsort((h, of))
    fresh = np.ones(len(h))
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    last = w.data[w.ends - 1] if len(h) else np.zeros(0, np.uint8)
    bare = np.isin(GROUP[last], (0, 1, 5)).astype(float)
    single = (length == 1).astype(float)
    capital = (GROUP[w.data[w.starts]] == 1).astype(float) if len(h) else single
    per = np.stack([sums(x, w.first) / count for x in (length, length**2, same, fresh, bare, single, capital)], 1)
    per[:, 1] = np.sqrt(np.maximum(per[:, 1] - per[:, 0] ** 2, 0))
    long = np.log1p(w.counts)[:, None]
    return np.hstack([np.log1p(200 * shares), per, per[:, 2:4] ** 2, long, long**2 / 10, per[:, 3:4] * long])


def newton(sums_at: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, float]], size: int, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """The weights of least mean loss, from the gradient, the second derivatives and the number of pairs, as sums at given weights."""
    w = np.zeros(size)
    for _ in range(rounds):
        gradient, hessian, n = sums_at(w)
        step = np.linalg.solve(hessian / n + ridge * np.eye(size), gradient / n + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def rank(x: np.ndarray, y: np.ndarray, rivals: int = 8, ridge: float = 1e-3, rounds: int = 30, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean and deviation of the features, Bradley-Terry weights, and the score at the threshold, of a small table in memory and drawn pairs. `quality` draws none."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    rng = np.random.default_rng(seed)
    loser = np.repeat(bad, rivals)
    d = z[rng.choice(good, len(loser))] - z[loser]

    def sums_at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # that the loser wins
        return -(d * p[:, None]).sum(0), (d * (p * (1 - p))[:, None]).T @ d, len(d)

    w = newton(sums_at, z.shape[1], ridge, rounds)
    return mean, scale, w, float(np.quantile(z @ w, len(bad) / len(y)))


def all_pairs(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient and second derivatives of the loss, summed over all pairs of a row of each, without forming the differences."""
    p = 1 / (1 + np.exp(np.clip((good @ w)[None, :] - (bad @ w)[:, None], -30, 30)))  # that the bad one wins
    q = p * (1 - p)
    cross = bad.T @ q @ good
    return p.sum(1) @ bad - p.sum(0) @ good, (good.T * q.sum(0)) @ good + (bad.T * q.sum(1)) @ bad - cross - cross.T, p.size


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        x = np.round(features(b.column("text")), 9)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())], ["doc_id", "x"])


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _group(t: pa.Table) -> pa.Table:
    """A group's good and bad rows, each as one value."""
    x, y = _rows(t["x"].combine_chunks()), t["label"].to_numpy() > 0
    return pa.table({"good": pa.array([x[y].tobytes()], pa.binary()), "bad": pa.array([x[~y].tobytes()], pa.binary())})


def added(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of an array of fixed size over all batches: each task adds its own, Spark the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = of(b) if total is None else total + of(b)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    return np.array([r["v"] for r in df.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])


def nth(values: DataFrame, n: int, bins: int = 4096) -> float:
    """The n-th of the column `s` in ascending order, from 0: the bin that holds it is cut into bins until it holds equal values only."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    before = 0
    while low < high:
        inside = values.where(F.col("s").between(low, high))
        at = F.least(F.floor((F.col("s") - low) / (high - low) * bins), F.lit(bins - 1))
        for r in inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("at").collect():
            if n < before + r["n"]:
                low, high = r["low"], r["high"]
                break
            before += r["n"]
    return low


def quantile(values: DataFrame, n: int, share: float) -> float:
    """Of the n values of the column `s`, exact, between two neighbours as numpy has it."""
    place = (n - 1) * share
    low = nth(values, int(place))
    return low if place == int(place) else low + (nth(values, int(place) + 1) - low) * (place - int(place))


def dealt(train: DataFrame, counts: dict[bool, int], group: int) -> DataFrame:
    """(good, bad) of each group: every row is in one at least."""
    groups = -(-sum(counts.values()) // group)
    copies = {good: min(groups, -(-LEAST * groups // n)) for good, n in counts.items()}
    turn = F.explode(F.sequence(F.lit(0), F.when(F.col("label") > 0, copies[True]).otherwise(copies[False]) - 1))
    rows = train.withColumn("turn", turn).withColumn("grp", F.pmod(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(groups)) + F.col("turn"), F.lit(groups)))
    return rows.select("grp", "label", "x").groupBy("grp").applyInArrow(_group, "good binary, bad binary")


def quality(docs: DataFrame, labels: DataFrame, usable=None, group: int = 256) -> DataFrame:
    """(doc_id, score, predicted) of every document; labels(doc_id, quality) where `usable` holds are learned from, all of them."""
    of_id = dict(docs.dtypes)["doc_id"]
    known = labels.where((F.lit(True) if usable is None else usable) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    featured = kept(docs.select("doc_id", "text").mapInArrow(_featured, f"doc_id {of_id}, x array<double>"), "features")
    train = kept(featured.join(known, "doc_id"), "training")
    counts = {True: 0, False: 0} | {r["good"]: r["n"] for r in train.groupBy((F.col("label") > 0).alias("good")).agg(F.count("*").alias("n")).collect()}
    if not min(counts.values()):
        return docs.select("doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    n = sum(counts.values())
    mean = added(train.select("x"), lambda b: _rows(b.column("x")).sum(0)) / n
    scale = np.sqrt(added(train.select("x"), lambda b: ((_rows(b.column("x")) - mean) ** 2).sum(0)) / n)
    scale, size = np.where(scale > 1e-9, scale, 1.0), len(mean)
    groups = kept(dealt(train, counts, group), "groups")

    def sums_at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def of(b: pa.RecordBatch) -> np.ndarray:
            total = np.zeros(size + size**2 + 1)
            for good, bad in zip(b.column("good"), b.column("bad"), strict=True):
                z = [(np.frombuffer(m.as_buffer(), float).reshape(-1, size) - mean) / scale for m in (good, bad)]
                gradient, hessian, pairs = all_pairs(*z, w)
                total += np.concatenate([gradient, hessian.ravel(), [pairs]])
            return total

        total = added(groups, of)
        return total[:size], total[size:-1].reshape(size, size), total[-1]

    w = newton(sums_at, size)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array((_rows(b.column("x")) - mean) / scale @ w)], ["s"])

    threshold = quantile(kept(train.select("x").mapInArrow(score, "s double"), "scores"), n, counts[False] / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = (_rows(b.column("x")) - mean) / scale @ w - threshold
                score = np.round(1 / (1 + np.exp(-np.clip(s, -30, 30))), 9)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return featured.mapInArrow(run, f"doc_id {of_id}, score double, predicted int")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
