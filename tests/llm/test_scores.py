"""Toxicity, quality and language: held-out accuracy on the test tables, and odd rows."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

from loomwork.llm.language import Chain, Lexicon, drawn, fit, languages, op5_language
from loomwork.llm.quality import op9_quality, quality
from loomwork.llm import quality as quality_model
from loomwork.llm import toxicity as kn
from loomwork.llm.toxicity import op1_toxicity, toxicity, without_toxic

SF = "/root/testdata/sf0.1"


def labels(spark, df):
    return spark.createDataFrame([(r.doc_id, r.doc_id % 2, (r.doc_id // 2) % 2) for r in df.select("doc_id").collect() if r.doc_id is not None], "doc_id long, quality int, toxic int")


def auc(score, label):
    low = np.sort(score[label == 0])
    return np.searchsorted(low, score[label == 1]).mean() / len(low)


def test_kneser_ney_against_plain_python(spark, prose):
    """The log-likelihoods of both classes, from counts made anew; each class's probabilities add up to 1."""
    rng, start = random.Random(5), "\0"
    texts = [(" ".join(rng.choice(["you", "fool", "kind", "the", "word", *"abcdefghij"]) for _ in range(rng.randint(0, 60))), i % 2) for i in range(60)]
    texts += [texts[0], (texts[1][0].upper() + "!", 1), (None, 1), ("", 0)]
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "doc_id long, text string, label int")
    others = spark.createDataFrame([(t,) for t, _ in texts] + [(prose(50, 1),), ("fool you",)], "text string")
    model = kn.estimate(kn.pair_counts(docs), others)
    split = lambda t: re.findall("[0-9a-z]+", (t or "").lower())
    left, k = [collections.defaultdict(set), collections.defaultdict(set)], collections.Counter(w for r in others.collect() for w in set(split(r.text)))
    label = {}
    for t, y in texts:
        label[t or ""] = max(y, label.get(t or "", 0))
    for t, y in label.items():
        w = [start, start, *split(t)]
        for i in range(2, len(w)):
            left[y][w[i - 1], w[i]].add(w[i - 2])
    p = lambda w: (k[w] + 1) / (sum(k.values()) + len(k) + 1)
    before = [collections.Counter(w for _, w in c) for c in left]
    low = lambda c, w: (max(before[c][w] - kn.DISCOUNT, 0) + sum(min(x, kn.DISCOUNT) for x in before[c].values()) * p(w)) / sum(before[c].values())

    def likelihood(c, v, w):
        after = {x: len(s) for (u, x), s in left[c].items() if u == v}
        rest = kn.STRENGTH + sum(min(x, kn.DISCOUNT) for x in after.values())
        return (max(after.get(w, 0) - kn.DISCOUNT, 0) + rest * low(c, w)) / (sum(after.values()) + kn.STRENGTH)

    unseen = 1 - sum(p(w) for w in k)
    for c in (0, 1):
        assert abs(sum(likelihood(c, "you", w) for w in k) + likelihood(c, "you", "neverseen") / p("neverseen") * unseen - 1) < 1e-9
    for t in [t for t, _ in texts[:12]] + ["you zebra fool", prose(9, 1), "fool"]:
        w = [start, *split(t)]
        want = sum(np.log(likelihood(1, w[i - 1], w[i]) / likelihood(0, w[i - 1], w[i])) for i in range(1, len(w)))
        assert abs((model.evidence(pa.array([t]))[0, 0] + model.new) * (len(w) - 1) - want) < 1e-3 or len(w) == 1


def test_best_passage_is_that_of_all_passages(spark, prose):
    model = kn.Model((np.zeros(0, np.uint64), np.zeros(0)), (np.zeros(0, np.uint64), np.zeros(0)), (np.zeros(0, np.uint64), np.zeros(0)), 0.0)
    rng = np.random.default_rng(1)
    texts = [prose(n, n + 1) for n in (1, 7, 30, 200)]
    values = rng.normal(size=300)
    model.ratios = lambda word, before, pair: values[word.astype(np.int64) % 300].astype(np.float32)
    got = model.evidence(pa.array([None, *texts, ""]))
    assert not got[[0, 5]].any()
    for row, t in zip(got[1:5], texts, strict=True):
        r = values[kn._pairs(pa.array([t]))[1].astype(np.int64) % 300]
        for j, k in enumerate(kn.PASSAGES):
            assert abs(row[3 + j] - max(0, max(r[i : i + k].sum() / k for i in range(len(r))))) < 1e-5


def test_toxicity_on_held_out_rows(spark):
    r = op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    said, is_toxic = r.predicted == 1, r.toxic == 1
    print(f"toxicity, held out: {(said & is_toxic).sum()} of {is_toxic.sum()} found, {(said & ~is_toxic).sum()} of {(~is_toxic).sum()} wrong")
    assert (said & is_toxic).sum() / said.sum() > 0.75  # a twentieth of the labels is turned round
    assert (said & is_toxic).sum() / is_toxic.sum() > 0.8
    assert auc(r.score.to_numpy(), r.toxic.to_numpy()) > 0.9
    assert (said & ~is_toxic).sum() / (~is_toxic).sum() < 0.03


def test_quality_on_held_out_rows(spark):
    r = op9_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (r.predicted == r.quality).mean() > 0.98


def test_bradley_terry_against_plain_gradient_descent():
    """The same pairs, the loss written out pair by pair, and plain descent to its least."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3)) * [1, 5, 0.2] + 3
    y = (x @ [1, -0.4, 3] + rng.normal(size=40) > np.median(x @ [1, -0.4, 3])).astype(int)
    mean, scale, w, threshold = quality_model.rank(x, y, rivals=4, ridge=0.05)
    z = [[(v - m) / s for v, m, s in zip(r, x.mean(0), x.std(0), strict=True)] for r in x]
    good, bad = [i for i in range(40) if y[i]], [i for i in range(40) if not y[i]]
    picked = np.random.default_rng(5).choice(np.array(good), 4 * len(bad))
    pairs = [(int(g), bad[i // 4]) for i, g in enumerate(picked)]
    v = [0.0] * 3
    for _ in range(4000):
        grad = [0.05 * a for a in v]
        for g, b in pairs:
            d = [p - q for p, q in zip(z[g], z[b], strict=True)]
            lose = 1 / (1 + np.exp(sum(a * c for a, c in zip(v, d, strict=True))))
            grad = [a - lose * c / len(pairs) for a, c in zip(grad, d, strict=True)]
        v = [a - 0.3 * c for a, c in zip(v, grad, strict=True)]
        if max(map(abs, grad)) < 1e-9:
            break
    assert np.allclose(w, v, atol=1e-4)
    scores = sorted(sum(a * c for a, c in zip(v, r, strict=True)) for r in z)
    assert abs(np.mean(np.array(scores) < threshold) - len(bad) / 40) < 0.05


def test_quality_does_not_depend_on_the_order_of_rows(spark, prose):
    df = spark.createDataFrame([(i, prose(20 + i % 7, i) if i % 3 else f"{prose(9, i)} ### $$$ " * 3) for i in range(90)], "doc_id long, text string")
    label = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    a, b = ({r.doc_id: r.score for r in quality(d, label).collect()} for d in (df, df.repartition(7, "text")))
    assert a == pytest.approx(b, abs=1e-8)


def test_quality_learns_from_every_label(spark, monkeypatch):
    """More labels than the 8000 that were once drawn: each is in a group, and in its group each of a class meets each of the other."""
    n = 9000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.when(F.col("id") % 90 == 0, "### ").otherwise("more. "), F.hex("id")).alias("text"))
    label = docs.select("doc_id", F.when(F.col("doc_id") % 90 == 0, 0).otherwise(1).alias("quality"))
    seen = []

    def watched(train, counts, group):
        seen.append((counts, [(np.frombuffer(r.good).size, np.frombuffer(r.bad).size) for r in dealt(train.select("doc_id", "label", F.array(F.col("doc_id").cast("double")).alias("x")), counts, group).collect()]))
        return dealt(train, counts, group)

    dealt = quality_model.dealt
    monkeypatch.setattr(quality_model, "dealt", watched)
    out = quality(docs, label).toPandas().set_index("doc_id").predicted
    assert len(out) == n and (out[out.index % 90 == 0] == 0).mean() > 0.9 and (out[out.index % 90 > 0] == 1).mean() > 0.9
    [(counts, sizes)] = seen
    assert counts == {True: n - 100, False: 100}
    assert sum(g for g, _ in sizes) == n - 100 and sum(b for _, b in sizes) >= 100 and min(b for _, b in sizes) > 0 and max(g for g, _ in sizes) < 400


def test_sums_over_pairs_against_pair_by_pair():
    rng = np.random.default_rng(6)
    good, bad, w = rng.normal(size=(7, 3)), rng.normal(size=(5, 3)), rng.normal(size=3)
    gradient, hessian = np.zeros(3), np.zeros((3, 3))
    for g in good:
        for b in bad:
            p = 1 / (1 + np.exp((g - b) @ w))
            gradient -= p * (g - b)
            hessian += p * (1 - p) * np.outer(g - b, g - b)
    found = quality_model.all_pairs(good, bad, w)
    assert np.allclose(found[0], gradient) and np.allclose(found[1], hessian) and found[2] == 35


def test_quantile_is_exact(spark):
    rng = np.random.default_rng(8)
    for values in (rng.normal(size=3001) ** 5, np.repeat([1.0, 2.0], 50), np.array([3.0]), np.concatenate([[1e9], rng.normal(size=100)])):
        df = spark.createDataFrame([(float(v),) for v in values], "s double")
        for share in (0.0, 0.137, 0.5, 1.0):
            assert quality_model.quantile(df, len(values), share) == pytest.approx(float(np.quantile(values, share)), rel=1e-12)


def test_languages_are_drawn_without_a_shuffle_of_texts(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "de" if i % 3 else "en") for i in range(30)], "doc_id long, text string, lang string")
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables whose size isn't known
        sample = drawn(docs, F.lit(True), 500, 1 << 24)
        plan = sample._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sample.count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)


def test_language_on_held_out_rows(spark):
    r = op5_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    print(f"language, held out: {(r.lang_pred == r.lang).mean():.4f} of {len(r)} right")
    assert (r.lang_pred == r.lang).mean() > 0.98


@pytest.fixture(scope="module")
def odd(frame):
    texts = ODD + ["the fool said no " * 5, "kind words here " * 5] * 20 + ["the fool said no " * 5]
    return frame(texts, [None, *range(1, len(texts) - 1), 8])


def test_odd_rows_get_a_score(spark, odd):
    for f in (toxicity, quality):
        out = f(odd, labels(spark, odd)).toPandas()
        assert len(out) == odd.count() and out.score.between(0, 1).all() and out.predicted.isin([0, 1]).all()
    out = languages(odd).toPandas()
    assert len(out) == odd.count() and out.score.between(0, 1).all()
    by = odd.join(languages(odd).groupBy(F.col("doc_id").alias("id")).agg(F.max("lang_pred").alias("p")), F.col("doc_id") == F.col("id"))
    assert {r.p for r in by.where(F.col("text").isin("", " \t\n", "123 !?")).collect()} == {"und"}


def test_filter_keeps_columns_and_repeats(spark, odd):
    kept = without_toxic(odd, labels(spark, odd))
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert without_toxic(odd, none).count() == odd.count()


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity(empty, none).count() == quality(empty, none).count() == languages(empty).count() == without_toxic(empty, none).count() == 0


def test_no_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert set(r.score for r in toxicity(odd, none).collect()) == {0.0}
    assert set(r.score for r in quality(odd, none).collect()) == {0.5}
    assert set(r.lang_pred for r in languages(odd, F.lit(False)).collect()) == {"und"}


@pytest.mark.parametrize("seed", range(4))
def test_forward_backward_against_all_paths_in_log_space(seed):
    rng = np.random.default_rng(seed)
    k, lengths = 3, [0, 1, 5, 300, 129, 128, 700, 2]
    first = np.concatenate([[0], np.cumsum(lengths)])
    e, chain = rng.normal(size=(first[-1], k)), Chain(rng.normal(size=k), rng.normal(size=(k, k)))
    got = chain.marginals(e, first)
    for a, z in zip(first[:-1], first[1:], strict=True):
        alpha, beta = np.zeros((z - a, k)), np.zeros((z - a, k))
        for t in range(z - a):
            alpha[t] = e[a + t] + (chain.start if t == 0 else np.logaddexp.reduce(alpha[t - 1][:, None] + chain.move, 0))
        for t in range(z - a - 2, -1, -1):
            beta[t] = np.logaddexp.reduce(chain.move + (e[a + t + 1] + beta[t + 1])[None, :], 1)
        want = alpha + beta
        want = np.exp(want - np.logaddexp.reduce(want, 1, keepdims=True)) if z > a else want
        assert np.allclose(got[a:z], want, atol=1e-9)


def test_gradient_against_all_paths_and_finite_differences():
    rng = np.random.default_rng(8)
    k, lengths = 3, [5, 0, 1, 4, 2]
    first = np.concatenate([[0], np.cumsum(lengths)])
    e, start, move, label = rng.normal(size=(12, k)), rng.normal(size=k), rng.normal(size=(k, k)), rng.integers(0, k, 12)

    def likelihood(e, start, move):
        total = 0.0
        for a, z in zip(first[:-1], first[1:], strict=True):
            score = lambda path: sum(e[a + t, s] + (move[path[t - 1], s] if t else start[s]) for t, s in enumerate(path))  # noqa: B023, E731
            if z > a:
                total += score(label[a:z]) - np.log(sum(np.exp(score(p)) for p in itertools.product(range(k), repeat=int(z - a))))
        return total

    got = dict(zip(("e", "start", "move"), Chain(start, move).gradient(e, first, label), strict=True))
    for name in ("e", "start", "move"):
        value = {"e": e, "start": start, "move": move}[name]
        for at in np.ndindex(value.shape):
            up, down = value.copy(), value.copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            here = [likelihood(**({"e": e, "start": start, "move": move} | {name: v})) for v in (up, down)]
            assert abs(got[name][at] - (here[0] - here[1]) / 2e-5) < 1e-6


def test_gradient_across_segments():
    rng = np.random.default_rng(9)
    first = np.array([0, 300, 429])
    e, chain, label = rng.normal(size=(429, 3)), Chain(rng.normal(size=3), rng.normal(size=(3, 3))), rng.integers(0, 3, 429)
    by_word, by_start, by_move = chain.gradient(e, first, label)
    assert np.allclose(by_word.sum(1), 0) and abs(by_move.sum()) < 1e-9 and abs(by_start.sum()) < 1e-9
    # the expected pairs of neighbours add up to the words' own distributions
    p = chain.marginals(e, first)
    inner = np.ones(429, bool)
    inner[first[:-1]] = False
    there = np.bincount(label[np.flatnonzero(inner) - 1] * 3 + label[inner], minlength=9).reshape(3, 3)
    assert np.allclose((there - by_move).sum(0), p[inner].sum(0))


def test_lexicon_is_learned_from_the_texts():
    h, texts, label = np.array([7, 7, 7, 7, 8, 8, 8, 9], np.uint64), np.array([0, 1, 2, 2, 0, 1, 3, 0]), np.array([1, 1, 1, 1, 1, 1, 0, 1])
    assert Lexicon.learned(h, texts, label, 2).of(np.array([7, 8, 9, 1], np.uint64)).tolist() == [2, 0, 0, 0]


def test_rare_languages_and_the_order_of_rows(spark, prose):
    rows = [(i, prose(30, i), "xx") for i in range(300)] + [(1000 + i, " ".join(f"zq{w}ov" for w in prose(30, i).split()), "yy") for i in range(6)] + [(None, "ab cd", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a = {r.doc_id: tuple(r) for r in languages(df, per_language=40).collect()}
    b = {r.doc_id: tuple(r) for r in languages(df.repartition(5, "text"), per_language=40).collect()}
    assert a == b and all(a[1000 + i][1] == "yy" for i in range(6)) and a[0][1] == "xx" and a[None][1] in ("xx", "yy")


def test_words_of_a_code_switched_text():
    left, right = "the cat sat on that mat and this thing was with them".split(), "der hund und die katze sind nicht auf dem dach".split()
    rng = np.random.default_rng(0)
    runs = [" ".join(rng.choice(left, 20)) for _ in range(60)] + [" ".join(rng.choice(right, 20)) for _ in range(60)]
    tagger = fit(runs, ["en"] * 60 + ["de"] * 60)
    w, p = tagger.tag(pa.array([" ".join(left + right)]))
    want = [tagger.languages.index("en")] * len(left) + [tagger.languages.index("de")] * len(right)
    assert (p.argmax(1) == want).mean() > 0.9
