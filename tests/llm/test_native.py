"""Mixing, decontamination and the pipeline."""

import collections
import math
import random
import re

import duckdb
import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

from loomwork.llm import decontamination, mixing
from loomwork.llm.common import kept

# -- mixing ----------------------------------------------------------------------------


def columns(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rate string, blocks string")


@pytest.fixture(scope="module")
def uneven(spark):
    rows, n = [], 0
    for source, docs in (("big", 400), ("mid", 120), ("small", 30), (None, 20)):
        for _ in range(docs):
            rows.append((n, "w " * (n % 17), source, "x", "y"))
            n += 1
    rows += [rows[5], rows[5], (9000, None, "big", "x", "y"), (9001, "", "void", "x", "y")]
    return columns(spark, rows)


def test_mixing_against_sql(spark, uneven):
    m = mixing.mixed(uneven).select("doc_id", "source", F.round("weight", 6).alias("weight"), F.col("block").cast("long"), F.col("pass").cast("int"), "position", "tokens")
    con = duckdb.connect()
    given = uneven.select("doc_id", "text", "source").toArrow()
    con.register("documents", given)
    want = con.execute(mixing.OP3_SQL).fetchall()
    assert sorted(map(tuple, m.collect()), key=str) == sorted(((None if r[0] is None or r[0] != r[0] else r[0], *r[1:]) for r in want), key=str)


def test_nothing_is_lost_and_no_source_passes_too_often(uneven):
    m = mixing.mixed(uneven)
    by = m.groupBy("source").agg(F.sum("tokens").alias("t"), F.max("pass").alias("p"), F.first("weight").alias("w")).toPandas()
    assert m.select("doc_id").distinct().count() == uneven.select("doc_id").distinct().count()
    whole = uneven.select(F.coalesce("source", F.lit("")).alias("source"), mixing.tokens(F.col("text")).alias("n")).groupBy("source").sum("n").toPandas().set_index("source")["sum(n)"]
    for r in by.itertuples():
        assert whole[r.source] <= r.t <= 2 * whole[r.source] + 17
    got = by.t / by.t.sum()
    assert (abs(got - by.w) < 0.01).all()


def test_entropy_target_and_budget(uneven):
    units = uneven.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), mixing.tokens(F.col("text")).alias("tokens"))
    stats = units.groupBy("source").agg(F.sum("tokens").alias("total"))
    a = mixing.exponent(stats, None, entropy=1.2)
    p = [r.total for r in stats.collect() if r.total]
    w = [(x / sum(p)) ** a for x in p]
    assert abs(-sum(x / sum(w) * math.log(x / sum(w)) for x in w) - 1.2) < 1e-4
    m = mixing.mixed(uneven, repetition_limit=1.0, budget=600.0)
    assert abs(m.agg(F.sum("tokens")).first()[0] - 600) < 17 * 5 and m.agg(F.max("pass")).first()[0] == 0


def test_mixture_keeps_columns(uneven):
    m = mixing.mixture(uneven)
    assert m.dtypes == uneven.dtypes and m.count() == mixing.mixed(uneven).count()
    none = uneven.limit(0)
    assert mixing.mixed(none).count() == mixing.mixture(none).count() == 0


def test_small_blocks_hold_the_budget(uneven):
    m = mixing.mixed(uneven, block_docs=10)
    assert m.where("source = 'big'").select("block").distinct().count() > 20
    assert m.where("pass = 0").count() >= uneven.count()


@pytest.mark.parametrize("budget", [0.0, 0.00001])
def test_no_budget_no_rows(uneven, budget):
    assert mixing.mixed(uneven, budget=budget).where("tokens > 0").count() == 0


def test_null_ids_spread_over_the_blocks(spark):
    df = columns(spark, [(None, f"w{i % 5} " * (i % 9), "one", "x", "y") for i in range(600)] + [(i, "a b", "two", "x", "y") for i in range(900)])
    m = kept(mixing.mixed(df, block_docs=50), "test-nulls")
    counts = [r["count"] for r in m.where("source = 'one' and pass = 0").groupBy("block").count().collect()]
    assert sum(counts) == 600 and len(counts) > 6 and max(counts) < 200
    assert m.where("pass = 0").count() == 1500


def test_ties_of_an_id_are_decided(spark):
    rows = [(1, t, "s", "x", "y") for t in ("a b", "c d", "e f", "g h", "i j k")] + [(n, "a b c", "t", "x", "y") for n in range(2, 40)]
    a, b = (sorted((r.text, r.n) for r in mixing.mixture(columns(spark, x).repartition(n, "text"), 1.0, budget=60.0).groupBy("text").agg(F.count("*").alias("n")).collect()) for x, n in ((rows, 3), (rows[::-1], 5)))
    assert a == b


def test_order_of_the_mixture_keeps_copies_apart(spark, uneven):
    m = kept(mixing.mixture(uneven.where("doc_id is not null")), "test-mixture")
    rows = mixing.in_mixed_order(m).orderBy("mixed_order").select("doc_id", "source", "mixed_order").collect()
    assert len({r.mixed_order for r in rows}) == len(rows) == m.count()
    assert sum(a.doc_id == b.doc_id for a, b in zip(rows, rows[1:], strict=False)) <= 5
    half = [sum(r.source == "mid" for r in x) for x in (rows[: len(rows) // 2], rows[len(rows) // 2 :])]
    assert min(half) > 0.3 * sum(half)  # sources interleave
    assert [r.doc_id for r in mixing.in_mixed_order(m).orderBy("mixed_order").collect()] == [r.doc_id for r in rows]


# -- decontamination -------------------------------------------------------------------


def norm(t):
    return [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]


def weigh(w):
    return {s: n * (len(s) - 4) for s, n in collections.Counter(" ".join(w[j : j + 5]) for j in range(len(w) - 4)).items()}


def leaked(docs, items):
    out = set()
    for d, t in docs:
        w = norm(t)
        for i, u in items:
            u = norm(u)
            m = weigh(u)
            for s in range(len(w)):
                v = weigh(w[s : s + len(u)])
                both = sum(min(x, m.get(k, 0)) for k, x in v.items())
                if m and both and both / (sum(v.values()) + sum(m.values()) - both) >= 0.8 - 1e-9:
                    out.add((d, i))
    return out


@pytest.fixture(scope="module")
def items(spark, prose):
    texts = [(i, prose(15 + i, 40 + i)) for i in range(12)] + [(12, prose(4, 3)), (13, None), (14, ""), (15, "ab cd ef gh ij"), (None, prose(20, 60)), (3, prose(18, 43)), (16, "la la la la la la la la")]
    return spark.createDataFrame([(i, t, "x") for i, t in texts], "item_id long, text string, similarity string"), texts


def test_leaks_against_plain_python(frame, prose, items):
    table, listed = items
    texts = list(ODD)
    for i, t in listed:
        w = (t or "").split()
        texts += [t, f"{prose(30, i or 99)} {(t or '').upper()} {prose(20, 7)}", " ".join(w[:-2] + ["other", "words"]), " ".join(w[: len(w) // 2] + ["more"] + w[len(w) // 2 :]), " ".join(w[1:] + ["tail"]), "... ".join(w), prose(9, 8) + " " + " ".join(w[:-1])]
    texts += [f"{listed[5][1]} {prose(5, 1)} {listed[6][1]}"] * 2 + ["la " * 40]
    ids = [None, *range(len(texts) - 1)]
    df = frame(texts, ids)
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, table).collect()}
    assert got == leaked(list(zip(ids, texts, strict=True)), listed)
    stays = decontamination.without_leaks(df, table)
    bad = {d for d, _ in got}
    assert stays.dtypes == df.dtypes and sorted((r.doc_id for r in stays.collect()), key=str) == sorted((i for i in ids if i not in bad), key=str)


def test_windows_between_two_alignments(spark, frame, prose):
    texts, listed = [], []
    for seed in (192, 1066, 1462, 1842, 1981, 2260, 2281, 2386):  # only a start between those of the two halves reaches 0.8
        rng = random.Random(seed)
        n, more = rng.choice([60, 80]), rng.choice([3, 4, 5])
        w = prose(n, 10_000 + seed).split()
        cut = rng.randint(n // 4, 3 * n // 4)
        listed.append((seed, " ".join(w)))
        texts += [" ".join(w[:cut] + prose(more, 20_000 + seed).split() + w[cut:]), " ".join([prose(7, seed), *w[:cut], prose(more, 20_000 + seed), *w[cut:], prose(9, seed)]), " ".join([prose(3, seed), *w[2:]])]
    want = leaked(list(enumerate(texts)), listed)
    assert len(want) == len(texts)
    got = decontamination.contaminated(frame(texts), spark.createDataFrame(listed, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    for r in got:
        a, b = weigh(norm(texts[r.doc_id])[r.start : r.start + r.n_words]), weigh(norm(dict(listed)[r.item_id]))
        both = sum(min(x, b.get(k, 0)) for k, x in a.items())
        assert abs(r.similarity - both / (sum(a.values()) + sum(b.values()) - both)) < 1e-9


def test_long_tokens_do_not_hide_a_leak(spark, frame, prose):
    texts, listed = [], []
    for i in range(60):
        rng = random.Random(700 + i)
        w = prose(rng.randint(40, 59), 30_000 + i).split()
        key = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([100, 130, 160])))
        listed.append((i, " ".join([*w, key] if i % 3 == 0 else w)))
        texts.append(" ".join(["xx", *prose(4, i).split(), *w[5:], key] if i % 3 == 0 else [*w[:-1], key]))
    want = leaked(list(enumerate(texts)), listed)
    assert len(want) > 30
    got = decontamination.contaminated(frame(texts), spark.createDataFrame(listed, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_shuffled_way_gives_the_same(frame, items, monkeypatch):
    df = frame([t for _, t in items[1]])
    a = sorted(map(tuple, decontamination.contaminated(df, items[0]).collect()), key=str)
    monkeypatch.setattr(decontamination, "MOST_SHINGLES", 0)
    monkeypatch.setattr(decontamination, "MOST_WINDOWS", -1)
    assert sorted(map(tuple, decontamination.contaminated(df, items[0]).collect()), key=str) == a


def test_nothing_leaks_from_nothing(frame, empty, items):
    assert decontamination.contaminated(empty, items[0]).count() == 0
    assert decontamination.without_leaks(frame(["a b c d e f"]), items[0].limit(0)).count() == 1


def test_index_finds_every_fingerprint_within_the_radius(spark):
    rng = random.Random(1)
    rows, signed = [], lambda x: x - (1 << 64) * (x >> 63)
    for i in range(300):
        x = rng.getrandbits(128)
        y = x
        for b in rng.sample(range(128), i % decontamination.RADIUS + 1):
            y ^= 1 << b
        rows.append((i, *(signed(v & (1 << 64) - 1) for v in (x, x >> 64, y, y >> 64))))
    df = spark.createDataFrame(rows, "i int, a long, b long, print_a long, print_b long")
    left = df.select("i", decontamination.blocks(F.col("a"), F.col("b")).alias("p")).select("i", "p.block", "p.bits")
    right = decontamination.near_blocks(df, "i")
    assert decontamination.RADIUS < decontamination.BLOCKS * (decontamination.NEAR + 1)
    assert left.join(right, ["i", "block", "bits"]).select("i").distinct().count() == 300


def test_two_words_inserted_between_long_ones(spark, frame):
    """Windows that line up with the item have a similarity of 0.782 at most; one between them has 0.856."""
    middle = "k l m n o p q r s t".split()
    item = ["a", "b", "c", "d", "e", "x" * 120, *middle, "y" * 120, "v", "w", "x", "y", "z"]
    text = item[:11] + ["new", "words"] + item[11:]
    want = leaked([(0, " ".join(text))], [(1, " ".join(item))])
    assert want == {(0, 1)}
    items, docs = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), frame([" ".join(text)])
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()} == want
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    con.register("benchmark", items.toArrow())
    assert {r[:2] for r in con.execute(decontamination.OP7_SQL).fetchall()} == want


@pytest.fixture(scope="module")
def altered(prose):
    """Passages of the items with words replaced, left out or put in, so that many lie close to 0.8."""
    listed, texts = [(i, prose(random.Random(i).randint(14, 58), 50_000 + i)) for i in range(30)], []
    for i, t in listed:
        for k in range(6):
            rng, w = random.Random(i * 10 + k), t.split()
            at = rng.choice([0, 1, len(w) // 2, len(w) - 1, len(w) - 2])
            w[at : at + rng.randint(0, 2)] = prose(rng.randint(0, 3), 60_000 + i * 10 + k).split()
            texts.append(" ".join([prose(rng.randint(0, 30), 70_000 + i * 10 + k), *w, prose(rng.randint(0, 30), 80_000 + i * 10 + k)]))
    return texts, listed


def test_recall_on_altered_passages_and_selection_of_the_index(spark, frame, prose, altered):
    texts, listed = altered
    want = leaked(list(enumerate(texts)), listed)
    listed = listed + [(1000 + i, prose(random.Random(i).randint(14, 58), 90_000 + i)) for i in range(500)]  # that nothing holds
    table = spark.createDataFrame(listed, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(texts), table).collect()}
    recall = len(got & want) / len(want)
    items = decontamination.Items(table)
    matched = decontamination.matched_texts(frame(texts), items)
    places = decontamination.windowed(matched, "windows", "p", "n_words", "start").select("text_key", "n_words", "start", "value.*")
    prints = kept(decontamination.fingerprints(places, "text_key", "n_words", "start"), "test-prints")
    every = prints.join(items.prints, "n_words")
    near = every.where(decontamination.distance(("print_a", "print_b"), ("item_a", "item_b")) <= decontamination.RADIUS)
    mine = prints.select("n_words", decontamination.blocks(F.col("print_a"), F.col("print_b")).alias("p")).select("n_words", "p.block", "p.bits")
    joined, pairs, within = mine.join(items.index, ["n_words", "block", "bits"]).count(), every.count(), near.count()
    assert decontamination.candidates(prints, items).distinct().count() == within
    print(f"altered passages: {len(want)} leaks, recall {recall:.4f}; windows x items of a size {pairs}, rows of the multi-index {joined}, pairs within the radius {within}")
    assert got <= want and recall > 0.98 and joined < pairs and within < pairs / 2


def test_time_is_linear_in_a_text(spark, frame):
    import time

    items = spark.createDataFrame([(1, "la la la la la la la la")], "item_id long, text string")
    decontamination.contaminated(frame(["la " * 100]), items).count()
    took = []
    for n in (2_500, 20_000):
        began = time.time()
        assert decontamination.contaminated(frame(["la " * n]), items).count() == 1
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 5, took


def test_a_phrase_that_all_items_share_makes_no_windows(spark, frame, prose):
    """A hundred items of different lengths begin alike, and texts hold that beginning; two hold an item."""
    items = [(i, f"which of the following is {prose(8 + i, 3000 + i)}") for i in range(100)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    given = [f"{prose(150, i)} which of the following is {prose(150, 500 + i)}" for i in range(20)]
    given += [f"{given[0]} {items[30][1]} {given[1]}", f"{items[70][1]} {given[2]}"]
    matched = decontamination.matched_texts(frame(given), decontamination.Items(bench))
    rows = matched.select(F.explode("windows").alias("w")).agg(F.sum(F.col("w.n_words") - 4)).first()[0] or 0
    words = sum(len(t.split()) for t in given)
    assert rows < 60 * words
    found = decontamination.contaminated(frame(given), bench).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, found)) == [(20, 30), (21, 70)]
