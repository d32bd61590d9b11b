"""Row patterns, variants and bucketed tables on odd rows."""

import datetime as dt
import random
import re

import pytest

from loomwork import buckets, patterns, variants

DAY = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("pattern", ["down+ up+", "down up", "up+ down+ up+", "same+", "down+ same up+", "up down+"])
def test_matches_against_regular_expressions(pattern):
    steps = patterns.parsed(pattern)
    regex = re.compile("".join(f"({kind[0]}{'+' if many else ''})" for kind, many in steps))
    rng = random.Random(1)
    for _ in range(300):
        values = [rng.choice([1, 2, 3, None] if rng.random() < 0.3 else [1, 2, 3]) for _ in range(rng.randint(0, 25))]
        kinds = "".join("x" if a is None or b is None else "d" if b < a else "u" if b > a else "s" for a, b in zip(values, values[1:], strict=False))
        want, at = [], 0
        while m := regex.search(kinds, at):
            want.append((m.start(), [m.end(i + 1) for i in range(len(steps))], m.end() - m.start() + 1))
            at = m.end()
        m = patterns.Matches(steps)
        got = [x for i, v in enumerate(values) for x in m.add(i, v)] + list(m.close())
        assert got == want, (pattern, values)


def test_patterns_that_are_none():
    for bad in ("", "sideways", "up, down"):
        with pytest.raises(ValueError, match="pattern"):
            patterns.parsed(bad)


def test_dips_with_nulls_and_ties(held):
    rng = random.Random(2)
    rows = [(i, None if i % 31 == 0 else DAY + dt.timedelta(minutes=rng.randrange(60)), None if i % 19 == 0 else i % 3, rng.choice([1.0, 2.0, 3.0, None, float("nan")])) for i in range(300)]
    schema = "event_id long, ts timestamp_ntz, user_id long, value double"
    assert len(held("dips", patterns, events=(schema, rows))) > 10
    assert held("dips", patterns, events=(schema, [])) == []


PROPS = ['{"k": 3}', '{"k": -7, "x": 1}', '{"k": 2.5}', '{"k": "5"}', '{"k": true}', '{"k": null}', '{"k": [1, 2]}', '{"k": {"a": 1}}', "{}", "[1]", "3", "", "{", '{"k": 1', "nonsense", None]


@pytest.mark.parametrize("name", ["props_by_type", "nested_props"])
def test_variants_of_every_type(held, name):
    rows = [(i, None if i % 7 == 0 else i % 3, ["view", None][i % 2], p) for i, p in enumerate(PROPS * 3)]
    if name == "nested_props":  # what a string or a truth value is as a number is each engine's own
        rows = [r for r in rows if r[3] not in ('{"k": true}', '{"k": 2.5}')]
    schema = "event_id long, user_id long, event_type string, props string"
    assert len(held(name, variants, events=(schema, rows))) >= 10
    assert held(name, variants, events=(schema, [])) == []


def test_buckets_join_without_an_exchange(spark, held):
    orders = [(None if i == 5 else i, "p") for i in range(40)]
    lines = [(None if i % 9 == 0 else i % 30, float(i) / 4 if i % 4 else None) for i in range(200)]
    kinds = "o_orderkey long, o_orderpriority string", "l_orderkey long, l_extendedprice double"
    assert len(held("line_totals_of_orders", buckets, orders=(kinds[0], orders), lineitem=(kinds[1], lines))) == 40
    assert held("line_totals_of_orders", buckets, orders=(kinds[0], []), lineitem=(kinds[1], [])) == []
    plan = buckets.line_totals_of_orders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
