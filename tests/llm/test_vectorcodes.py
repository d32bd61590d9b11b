"""Vector codes against plain loops over Python integers, ties of distances included."""

import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm.vectorcodes import OP12_SQL, KdTree, as_entries, compressed, fingerprint, limbs, with_label_errors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v string, error string"


def plain(rows, parts, entries, rounds):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = [v for _, v, _ in sorted(kept, key=lambda r: r[0])[:entries]]
    books = [[cut(v, p) for v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: [min((far(cut(v, p), e), i) for i, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        found = [near(v) for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), n in zip(kept, found, strict=True) if n[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = [(i, "".join(f"{e:02x}" for _, e in near(v)), sum(d for d, _ in near(v)), label) for i, v, label in kept]
    return sorted((i, code, error, sum(r[2] for r in out if r[3] == label)) for i, code, error, label in out), books


def ours(spark, rows, parts=4, entries=5, rounds=3):
    df = spark.createDataFrame([(*r, "c", "v", "e") for r in rows], SCHEMA)
    codes, books = compressed(df, parts, entries, rounds)
    return sorted(tuple(r[c] for c in ("vec_id", "code", "error", "label_error")) for r in with_label_errors(codes).collect()), books


def vectors(seed, n=120, length=8, grid=4):
    """On a coarse grid, so that distances tie."""
    rng = random.Random(seed)
    return [(i * 3, [rng.randrange(-grid, grid) / 8 for _ in range(length)], rng.choice([1, 2, None])) for i in range(n)]


def test_against_plain_loops(spark):
    rows = vectors(1)
    assert ours(spark, rows) == plain(rows, 4, 5, 3)


def test_odd_rows(spark):
    bad = [(1000, None, 1), (1001, [0.5] * 7 + [None], 1), (1002, [0.5] * 7 + [float("nan")], 1), (1003, [float("inf")] + [0.5] * 7, None)]
    rows = vectors(2) + [(5000, [0.25] * 8, None), (5000, [0.25] * 8, None)]  # repeated
    found, books = ours(spark, rows + bad + [(-1, [], 1)])
    assert (found, books) == plain(rows, 4, 5, 3)
    # a null id stays and comes last, another length goes
    df = spark.createDataFrame([(*r, "c", "v", "e") for r in [*vectors(3), (None, [0.0] * 8, 1), (9999, [1.0] * 4, 1)]], SCHEMA)
    ids = [r["vec_id"] for r in with_label_errors(compressed(df, 4, 5, 1)[0]).collect()]
    assert None in ids and 9999 not in ids and len(ids) == 121


def test_empty_few_and_uneven(spark):
    assert ours(spark, []) == ([], [[], [], [], []])
    assert ours(spark, [(1, None, 1)])[0] == []
    few = vectors(4, 3)
    assert ours(spark, few) == plain(few, 4, 5, 3)
    with pytest.raises(ValueError, match="equal parts"):
        ours(spark, [(1, [0.5] * 7, 1)])


def test_large_numbers_stay_exact(spark):
    rows = [(i, [x * 3.0e4 * (1 + i % 5) for x in v], label) for i, v, label in vectors(5, 40)]
    assert ours(spark, rows) == plain(rows, 4, 5, 3)
    huge = [(i, [x * 1e30 for x in v], label) for i, v, label in vectors(6, 30)]
    df = spark.createDataFrame([(*r, "c", "v", "e") for r in huge], SCHEMA)
    codes, books = compressed(df, 4, 5, 3)
    rounded = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in huge]
    want, plain_books = plain(rounded, 4, 5, 3)
    assert books == plain_books
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in codes.collect()) == sorted((i, c, e if e < 1 << 63 else None) for i, c, e, _ in want)


def test_many_labels_meet_their_sums(spark, monkeypatch):
    from loomwork.llm import vectorcodes

    rows = [(i, v, i % 7 or None) for i, (_, v, _) in enumerate(vectors(7))]
    monkeypatch.setattr(vectorcodes, "FEW_LABELS", 3)
    assert ours(spark, rows) == plain(rows, 4, 5, 3)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=20), st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=20))
def test_nearest_is_the_lowest_of_the_nearest(entries, points):
    index, far = KdTree(as_entries(entries)).nearest(np.array(points, np.int64))
    want = [min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), i) for i, e in enumerate(entries)) for p in points]
    assert [(int(d), int(i)) for d, i in zip(far, index, strict=True)] == want


@given(st.lists(st.integers(-(1 << 100), 1 << 100), max_size=5))
def test_digits_add_up(numbers):
    sums = {}
    for x in numbers:
        for place, digit in limbs(x):
            sums[place] = sums.get(place, 0) + digit
    assert sum(d << 32 * p for p, d in sums.items()) == sum(numbers)


def test_sql(spark):
    rows = [(i, [x for x in v for _ in range(2)], label) for i, v, label in vectors(8, 90)]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    got = con.execute(OP12_SQL).fetchall()
    want, books = plain(rows, 8, 16, 6)
    assert sorted(r[:4] for r in got) == want and {r[4] for r in got} == {fingerprint(books)}
