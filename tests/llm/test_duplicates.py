"""Substring dedup and near duplicates against plain Python."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from conftest_llm import ODD

from loomwork.llm import neardup, substrings
from loomwork.llm.fmindex import FmIndex, suffix_array
from loomwork.llm.graph import components

# -- substrings ------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_backward_search_counts_windows(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(4, 30, 25)
    parts = [rng.integers(0, 3, n) for n in sizes]
    text = np.concatenate([np.append(p, 3 + i) for i, p in enumerate(parts)])
    order = suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    got = FmIndex(text, 3 + len(parts)).repeated(text, begin, sizes - 3, 4)
    count = collections.Counter(tuple(p[i : i + 4]) for p in parts for i in range(len(p) - 3))
    for p, mask in zip(parts, got, strict=True):
        assert [int(mask) >> i & 1 for i in range(len(p) - 3)] == [int(count[tuple(p[i : i + 4])] > 1) for i in range(len(p) - 3)]


def repeats(rows, width=35):
    w = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    count = collections.Counter(tuple(x[j : j + width]) for x in w for j in range(len(x) - width + 1))
    out = []
    for (i, _), x in zip(rows, w, strict=True):
        gone = [False] * len(x)
        for j in range(len(x) - width + 1):
            if count[tuple(x[j : j + width])] > 1:
                gone[j : j + width] = [True] * width
        kept = b" ".join(a for a, g in zip(x, gone, strict=True) if not g)
        out.append((i, len(x), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1000, 3])
def test_repeats_against_plain_python(frame, prose, hot):
    rng, passage = random.Random(4), [prose(n, n) for n in (34, 35, 36, 50, 90)]
    texts = ODD + ["la " * 200, "do re mi " * 50, prose(35, 1), prose(35, 1)]
    for i in range(80):
        parts = [prose(rng.randint(0, 60), 100 + i)]
        for p in rng.sample(passage, rng.randint(0, 3)):
            w = p.split()
            parts += [" ".join(w[rng.randint(0, 3) : len(w) - rng.randint(0, 3)]), prose(rng.randint(0, 40), 1000 + i)]
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    texts += texts[-5:]
    ids = [None, None, *range(len(texts) - 2)]
    out = substrings.without_repeats(frame(texts, ids), hot=hot).collect()
    assert sorted(map(tuple, out), key=str) == repeats(list(zip(ids, texts, strict=True)))


def test_no_repeats_of_nothing(empty):
    assert substrings.without_repeats(empty).count() == 0


# -- near duplicates -------------------------------------------------------------------


def classes(rows):
    """Components of equal texts and of weighted Jaccard similarity of 0.8 or more."""
    grams, n = [], len(rows)
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams.append(collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else []))
    df = collections.Counter(g for c in grams for g in c)
    weight = {g: 1 + min(1, math.log(n / d) / math.log(1 / neardup.RARE)) for g, d in df.items()}
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            inter = sum(min(c, grams[j][g]) * weight[g] for g, c in grams[i].items())
            union = sum(max(grams[i][g], grams[j][g]) * weight[g] for g in grams[i].keys() | grams[j].keys())
            if (rows[i][1] or "") == (rows[j][1] or "") or union and inter / union >= 0.8:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def changed(text, n, seed):
    rng, w = random.Random(seed), text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.random()}"
    return " ".join(w)


def corpus(prose):
    texts = ODD + ["", "a b c", "a  b c", "x y z w v", "x y z w v u"]
    for i in range(12):
        base = prose(150, i)
        texts += [base, base, base.replace(" ", "\n"), *(changed(base, n, i * 10 + n) for n in (1, 2, 3, 6, 20)), prose(150, 500 + i)]
    chain = prose(200, 77)
    for i in range(30):  # each near the last, the ends far apart
        texts.append(chain)
        chain = changed(chain, 2, 900 + i)
    return texts


@pytest.mark.parametrize("small", [True, False])
def test_classes_against_plain_python(frame, prose, monkeypatch, small):
    if not small:  # all groups take the way of the large ones
        monkeypatch.setattr(neardup, "GROUP_DOCS", 3)
        monkeypatch.setattr(neardup, "LEADERS", 4)
        monkeypatch.setattr(neardup, "BLOCK_DOCS", 8)
    texts = corpus(prose)
    out = {r.doc_id: r for r in neardup.duplicates(frame(texts)).collect()}
    want = classes(list(enumerate(texts)))
    assert [out[i].class_id for i in range(len(texts))] == want


def test_one_row_of_each_class_stays(frame, prose):
    texts = corpus(prose)
    df = frame(texts + texts[:40], [*range(len(texts)), *range(40)])  # repeated rows
    kept = neardup.without_duplicates(df)
    assert kept.dtypes == df.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes(list(enumerate(texts)))))


def test_null_ids(frame):
    out = neardup.without_duplicates(frame(["same text in all of these rows"] * 3 + ["another text that has no copy", None], [None, 7, None, None, None])).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in out) == [(-1, ""), (-1, "another text that has no copy"), (7, "same text in all of these rows")]


def test_no_duplicates_of_nothing(empty):
    assert neardup.duplicates(empty).count() == 0 and neardup.without_duplicates(empty).count() == 0


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(3)
    g = np.sort(rng.integers(1, 1 << 63, 600, dtype=np.uint64))
    w = rng.choice([2.0, 2.0, 1.3, 4.0], 600).astype(np.float32)
    v = np.where(rng.random(600) < 0.8, w, rng.choice([1.0, 2.0, 5.0], 600)).astype(np.float32)
    keep = rng.random(600) < 0.9
    sampler = neardup.Sampler(2.0, samples=neardup.BANDS * neardup.ROWS)
    drawn = []
    for x, y in ((g, w), (g[keep], v[keep])):
        drawn.append([int(min((np.where(y == 2, sampler.common[s][l := ((x * sampler.factor[s]) >> np.uint64(64 - neardup.LEVEL_BITS)).astype(int)] ^ (x & np.uint64(0xFFFFFFFF)), sampler.key(s, l, y, x)))) & np.uint64(0xFFFFFFFF)) for s in range(100)])
    other = np.where(keep, v, 0)
    want = np.minimum(w, other).sum() / np.maximum(w, other).sum()
    assert abs(np.mean(np.array(drawn[0]) == np.array(drawn[1])) - want) < 0.15


def counted(df):
    n = df.count()
    return neardup.weights(df, neardup.stand_out(df, n), n)


def test_list_of_frequent_shingles_too_large_to_broadcast(frame, prose, monkeypatch):
    monkeypatch.setattr(neardup, "RARE", 0.05)
    texts = [*ODD, *(f"{prose(40, 1)} {prose(30, 50 + i // 3)} {prose(i % 3, 9 + i)}" for i in range(90)), "", "one"]
    df = frame(texts)
    found = [sorted(map(tuple, neardup.duplicates(df).select("doc_id", "class_id", "texts").collect()))]
    assert len(counted(df).keys) > 10
    monkeypatch.setattr(neardup, "MOST_FREQUENT", 0)
    found.append(sorted(map(tuple, neardup.duplicates(df).select("doc_id", "class_id", "texts").collect())))
    assert found[0] == found[1] and [c for _, c, _ in found[0]] == classes(list(enumerate(texts)))


def test_frequent_shingles_are_counted_exactly(frame, prose, monkeypatch):
    monkeypatch.setattr(neardup, "RARE", 0.1)
    monkeypatch.setattr(neardup, "CHUNK", 50)
    texts = [prose(30, 1) + " " + prose(20, 50 + i) if i % 3 == 0 else prose(40, 50 + i) for i in range(300)]
    w = counted(frame(texts))
    assert len(w.keys) == 26 and np.allclose(w.weight, 1 + math.log(3) / math.log(10))


@pytest.mark.parametrize("streams", [1, 7, 40])
def test_lossy_counts_are_short_by_their_allowance_at_most(streams):
    """Over streams of very different lengths, and the few keys that are reported are those that stand out."""
    rng = np.random.default_rng(streams)
    n, share = 6000, 0.005
    keys = np.sort(rng.integers(1, 1 << 63, 30_000, dtype=np.uint64) << np.uint64(1))
    often = rng.random(30_000) ** 40
    docs = [keys[rng.random(30_000) < often / 4 + 0.0002] for _ in range(n)]
    cuts = np.sort(np.concatenate([[0, n], rng.integers(0, n, streams - 1)]))
    said, reported = collections.Counter(), 0
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        tally = neardup.Tally(share, a)
        for i in range(a, z):
            tally.add(docs[i], 1)
            if tally.size > 500:
                tally.settle()
        tally.settle()
        out = tally.report(True)
        reported += out.num_rows
        said.update(dict(zip(out["shingle"].to_numpy().view(np.uint64).tolist(), out["n"].to_pylist(), strict=True)))
    true = collections.Counter(x for d in docs for x in d.tolist())
    for k, v in true.items():
        assert said[k] <= v <= said[k] + 2 * (share * n + 1)
    assert reported < sum(true.values()) / 4


def test_long_texts_have_the_same_weights(frame, prose):
    w = counted(frame([prose(2000, i) for i in range(20)]))
    assert abs(w.other - (1 + math.log(20) / math.log(1 / neardup.RARE))) < 1e-9


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {v: x for v, x in up.items() if v in got} and all(any(v in e and e[0] != e[1] for e in edges) == (v in got) for v in up)
