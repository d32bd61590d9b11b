"""Digests that merge: bounds of trimmed means, exact sums, and odd rows."""

import random

import numpy as np
import pytest

from loomwork import digests


def exact(values, cut):
    v = np.sort(values)
    return v[cut : len(v) - cut].mean()


@pytest.mark.parametrize("kind", ["uniform", "skewed", "ties", "two ends"])
def test_merges_keep_the_bound(kind):
    rng = np.random.default_rng(3)
    values = {"uniform": rng.random(60_000), "skewed": rng.exponential(1, 60_000) ** 2, "ties": rng.integers(0, 3, 60_000).astype(float), "two ends": np.where(rng.random(60_000) < 0.11, 0.0, 1.0)}[kind]
    parts = [digests.merged(p, np.ones(len(p))) for p in np.array_split(values, 64)]
    half = [digests.merged(*(np.concatenate(x) for x in zip(*parts[i::8], strict=True))) for i in range(8)]
    means, weights = digests.merged(*(np.concatenate(x) for x in zip(*half, strict=True)))
    assert len(means) <= digests.SIZE + 2 and weights.sum() == 60_000 and abs((means * weights).sum() - values.sum()) < 1e-6 * abs(values).sum()
    for share in (0.02, 0.1, 0.25):
        cut = int(share * 60_000)
        assert abs(digests.trimmed(means, weights, cut) - exact(values, cut)) <= digests.error(share) * (values.max() - values.min())


def test_nothing_and_little():
    none = digests.merged(np.zeros(0), np.zeros(0))
    assert digests.trimmed(*none, 0) is None
    assert digests.trimmed(*digests.merged(np.array([3.0]), np.ones(1)), 0) == 3.0


def test_tasks_that_give_out_in_between(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.random()) for _ in range(6000)]
    monkeypatch.setattr(digests, "HELD", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        got = {r["k"]: (np.array(r["means"]), np.array(r["weights"])) for r in digests.digests(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in ("a", "b", None):
        mine = np.array([v for g, v in rows if g == k])
        assert got[k][1].sum() == len(mine) and abs(digests.trimmed(*got[k], len(mine) // 10) - exact(mine, len(mine) // 10)) <= digests.error(0.1)


def test_trimmed_values_with_nulls(held):
    rows = [(i, None if i % 5 == 0 else "ab"[i % 2], None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(i % 13)) for i in range(400)] + [(1000, "null only", None)]
    schema = "event_id long, event_type string, value double"
    assert len(held("trimmed_values", digests, events=(schema, rows))) == 3
    assert held("trimmed_values", digests, events=(schema, [])) == []
