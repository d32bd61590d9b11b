"""Similarity search, interval joins, sketches, recursion and correlated top-k on tables with nulls, ties and no rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomwork import graphs, intervals, lateral, similarity, sketches

# -- similarity --------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed, n, kinds=4, length=6):
    """Around a few centres, on a grid, with equal vectors."""
    rng = random.Random(seed)
    return [(i, [rng.randrange(3) / 4 + (i % kinds == j % kinds) for j in range(length)], None) for i in range(n)]


def test_nearest_with_nulls_and_ties(held):
    rows = [*vectors(1, 90), (100, None, 1), (120, [None] * 6, 1), (140, [float("nan")] * 6, 1), (None, [0.5] * 6, 1), (160, [], 1)]
    assert len(held("nearest_vectors", similarity, embeddings=(VECTORS, rows))) == 50
    assert held("nearest_vectors", similarity, embeddings=(VECTORS, [])) == []
    assert len(held("nearest_vectors", similarity, embeddings=(VECTORS, vectors(2, 4)))) == 3


def test_blocks_and_cells_lose_nothing(spark):
    """Small blocks, so that a cell is cut, and one cell to probe first; against all pairs, with cells ruled out."""
    rows = [(i, [x + 40 * (i % 5) for x in v], label) for i, v, label in vectors(3, 200)]
    df = spark.createDataFrame(rows, VECTORS)
    got = similarity.nearest(df, F.col("vec_id") % 7 == 0, k=5, cells=8, probes=1, block=9).collect()
    want = []
    for q, v, _ in rows[::7]:
        far = sorted((sum((a - b) ** 2 for a, b in zip(v, u, strict=True)), i) for i, u, _ in rows if i != q)
        want += [(q, place + 1, i) for place, (_, i) in enumerate(far[:5])]
    assert sorted((r["vec_id"], r["place"], r["near_id"]) for r in got) == sorted(want)


# -- intervals ---------------------------------------------------------------------------

DAY = dt.datetime(2024, 1, 1)


def spans(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randrange(0, 400)
        out.append((i, rng.choice([1, 2, None]), DAY + dt.timedelta(hours=a), DAY + dt.timedelta(hours=a + rng.choice([0, 1, longest]))))
    return out


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("unit", [900.0, 3600.0, 86400.0])
def test_overlaps(spark, keys, unit):
    odd = [(900, 1, None, DAY), (901, 1, DAY, None), (902, 1, DAY + dt.timedelta(9), DAY), (903, 1, DAY - dt.timedelta(4000), DAY + dt.timedelta(4000)), (None, 1, DAY, DAY)]
    left, right = [*spans(1, 60, 50), *odd], [*spans(2, 60, 7), *odd, spans(2, 60, 7)[3]]
    schema = "id long, k int, begins timestamp, ends timestamp"
    got = intervals.overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "begins", "ends", keys, unit)
    fit = lambda rows: [r for r in rows if None not in (r[0], r[2], r[3]) and r[2] <= r[3] and not (keys and r[1] is None)]
    want = [(a[0], b[0]) for a in fit(left) for b in fit(right) if a[2] <= b[3] and b[2] <= a[3] and (not keys or a[1] == b[1])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_overlaps_of_crowded_halves_are_spread(spark, monkeypatch, keys):
    """Keys beyond those few that are compared directly, halves with more meetings than a task is to have: the same pairs, by as many tasks as these ask for."""
    left, right = spans(1, 90, 50), [*spans(2, 80, 7), *[(500 + i, 1, DAY, DAY + dt.timedelta(hours=2)) for i in range(40)]]
    left += [(600 + i, 1, DAY + dt.timedelta(hours=1), DAY + dt.timedelta(hours=3)) for i in range(40)] + [(700, 3, DAY, DAY + dt.timedelta(hours=300))]
    right += [(701, 3, DAY + dt.timedelta(hours=300), DAY + dt.timedelta(hours=301)), (702, 3, DAY + dt.timedelta(hours=301), DAY + dt.timedelta(hours=302))]
    schema = "id long, k int, begins timestamp, ends timestamp"
    monkeypatch.setattr(intervals, "FEW", 4)
    monkeypatch.setattr(intervals, "MEETINGS", 100)
    sides = []
    given = intervals.spread

    def watched(*sides_and_columns):
        found = given(*sides_and_columns)
        sides.append((found[0].rdd.getNumPartitions(), found[1].rdd.getNumPartitions(), found[2]))
        return found

    monkeypatch.setattr(intervals, "spread", watched)
    got = intervals.overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "begins", "ends", keys)
    want = [(a[0], b[0]) for a in left for b in right if a[2] <= b[3] and b[2] <= a[3] and (not keys or a[1] == b[1] is not None)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    tasks, same, on = max(sides)
    assert tasks == same > 16 and "part" in on  # 1600 pairs and more, in one half for the most part


def test_overlaps_of_nothing(spark):
    none = spark.createDataFrame([], "id long, begins timestamp, ends timestamp")
    assert intervals.overlaps(none, none, "begins", "ends").collect() == []


# -- sketches ----------------------------------------------------------------------------

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def events(n, seed=4):
    rng = random.Random(seed)
    return [(i, None if i % 41 == 0 else DAY + dt.timedelta(minutes=rng.randrange(40_000)), None if i % 17 == 0 else rng.randrange(n // 2), rng.choice(["view", "purchase", None]), None if i % 5 == 0 else float(rng.randrange(9))) for i in range(n)]


@pytest.mark.parametrize("name", ["weekly_sketches", "weekly_viewers_who_bought"])
def test_sketches_keep_their_bounds(held, name):
    assert held(name, sketches, events=(EVENTS, events(30_000)))
    assert held(name, sketches, events=(EVENTS, [])) == []


def test_states_of_days_merge_as_those_of_the_whole(spark):
    """Theta is exact up to its size, and its merged states of days equal the state of all rows."""
    e = spark.createDataFrame(events(3000), EVENTS).where("ts is not null")
    merged = sketches.merged(sketches.stored(e), F.lit(0)).select("event_type", F.theta_sketch_estimate("members").alias("users"))
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(map(tuple, exact.collect()), key=str)


# -- recursion ---------------------------------------------------------------------------


def test_hops_over_cycles_and_hot_vias(spark):
    chain = [(i, f"v{i}") for i in range(24)] + [(i + 1, f"v{i}") for i in range(24)]
    pairs = [*chain, (12, "v12"), (0, "v0"), *((1000 + i, "v23") for i in range(300)), (5000, "alone"), (None, "v1"), (3, None)]
    got = dict(map(tuple, graphs.hops(spark.createDataFrame(pairs, "node long, via string"), spark.createDataFrame([(11,), (None,)], "node int")).collect()))
    edges = [(a, v) for a, v in pairs if a is not None and v is not None]
    want, new = {11: 0}, {11}
    while new:
        vias = {v for a, v in edges if a in new}
        new = {a for a, v in edges if v in vias} - want.keys()
        want |= dict.fromkeys(new, max(want.values()) + 1)
    assert got == want and max(got.values()) >= 13


def test_hops_of_nothing(spark):
    none = spark.createDataFrame([], "node long, via string")
    assert graphs.hops(none, none.select("node")).collect() == []
    assert [tuple(r) for r in graphs.hops(none, spark.createDataFrame([(1,)], "node long")).collect()] == [(1, 0)]


# -- correlated top-k --------------------------------------------------------------------


def test_views_before_purchases(held):
    rows = [(i, None if i % 13 == 0 else DAY + dt.timedelta(minutes=(i * 7) % 50), None if i % 11 == 0 else i % 3, ["view", "purchase", None][i % 7 % 3], 1.0) for i in range(150)]
    assert len(held("views_before_purchases", lateral, events=(EVENTS, rows))) > 50
    assert held("views_before_purchases", lateral, events=(EVENTS, [])) == []


def test_no_nested_loop(spark):
    plan = lateral.views_before_purchases(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_funnels_with_nulls_and_ties(held):
    from loomwork import timers

    rng = random.Random(6)
    rows = [(i, None if i % 29 == 0 else DAY + dt.timedelta(minutes=rng.randrange(2000)), None if i % 23 == 0 else i % 4, rng.choice(["view", "click", "purchase", None]), 1.0) for i in range(400)]
    found = held("stream_closed_funnels", timers, events=(EVENTS, rows))
    assert {r[2] for r in found} == {"1", "2", "3"}


def test_funnels_call_the_state_a_few_times_whatever_the_hours():
    from types import SimpleNamespace

    from pyspark.sql import Row

    from loomwork import timers

    hour, users = 3_600_000_000, 64

    class Handle:
        value, calls, timers = None, 0, ()

        def getValueState(self, name, schema):  # noqa: N802
            return SimpleNamespace(get=self.get, update=self.update, clear=lambda: self.update(None))

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def registerTimer(self, ms):  # noqa: N802
            self.calls, self.timers = self.calls + 1, (*self.timers, ms)

    calls = []
    for hours in (1, 50):
        handle, funnel = Handle(), timers.Funnel(3600)
        funnel.init(handle)
        # of each user in each second hour: a view, a click in the hour after it, three quarters of an hour later, and a purchase too late
        rows = [Row(user_id=u, event_id=3 * h + k, us=2 * h * hour + (k + 1) * hour // 4 * (k + 1), kind=k) for u in range(users) for h in range(hours) for k in range(3)]
        random.Random(3).shuffle(rows)
        assert list(funnel.handleInputRows((0,), iter(rows), None)) == []
        assert handle.timers == (2 * 3600 * 1000 - 1,)
        mark = SimpleNamespace(getCurrentWatermarkInMs=lambda h=hours: 2 * h * 3600 * 1000)
        found = list(funnel.handleExpiredTimer((0,), mark, None))
        assert len(found) == users * hours and {r.user_id for r in found} == set(range(users))
        assert {(r.step, r.click_id, r.purchase_id) for r in found} == {(2, 3 * h + 1, None) for h in range(hours)}
        calls.append(handle.calls)
    assert calls[0] == calls[1] <= 6


def test_funnels_of_many_users_close_at_their_hours(held):
    """Users in and across the sets whose state is held together, negative ids too, over days and an exact end of the last hour."""
    from loomwork import timers

    rng = random.Random(7)
    rows = [(i, DAY + dt.timedelta(minutes=rng.randrange(600)), rng.choice([-65, -64, -1, 0, 63, 64, 127, 128, 1 << 60]), rng.choice(["view", "click", "purchase"]), 1.0) for i in range(600)]
    rows += [(600, DAY + dt.timedelta(hours=10, minutes=10), 1, "view", 1.0)]  # its watermark is the very end of an hour
    assert len({r[-1] for r in held("stream_closed_funnels", timers, events=(EVENTS, rows))}) > 5
