"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Similarity: weighted Jaccard of five-word shingles, 0.8 or more. A shingle's weight is its
count in the text times 1 + min(1, ln(N / df) / ln(1 / RARE)): shingles in fewer than the
share RARE of all N documents weigh 2, more frequent ones less, down to 1. Counts of
documents are over all documents, copies included.

1. Frequent shingles. Each partition of CHUNK documents or more counts its shingles lossily: counts
   within an allowance of a quarter of RARE times its documents are forgotten as it goes, and as
   much again is left off in the end. Allowances are rounded so that over all partitions they come to
   half of RARE * N and 2 at most. So a partition reports the few shingles that stand out in it, and
   what can still reach RARE * N is counted exactly in a second pass. At most 2 / RARE
   times the mean number of shingles can, so that list is broadcast: it doesn't grow with the
   number of documents, but does with their mean length; beyond MOST_FREQUENT entries, which are counted
   first, all shingles are shuffled to be joined with it instead, with the same results.
2. Signatures. One pass: BANDS * ROWS samples for each text. The random values of a shingle
   in a sample come from a table of 16,384 draws, indexed by a hash of it; ties go by the hash.
3. Candidates. Texts that share a band are joined to the band's least text, never to each
   other. Each text hangs on the least of its at most BANDS leads; the connected components
   of the leads are groups of candidates.
4. Verification. Shingles of the candidates' texts go to their group once. A group of up to
   GROUP_DOCS texts is compared within one task. In a larger one about LEADERS leaders are
   compared with all, in blocks; then every text outside the largest class found so far is
   compared with all texts of the group, in blocks. No pair of such a group that might join
   two classes is left out, and only links go on.
5. Classes are connected components of the verified links; copies follow their text.

Results: a class's id is its least doc_id. Null text: as an empty one. Texts without words
are duplicates only of equal texts; with fewer than five words, the words are one shingle.
Null ids don't become a class's id unless there is no other.
An empty table gives no rows; ties don't occur, as links have no order and a class's id is a minimum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import kept, table
from loomwork.llm.graph import components
from loomwork.llm.text import gram_mask, grams, mix, slices, words

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 5
RARE, CHUNK, RUN, TALLY = 1e-3, 8192, 250_000, 2_000_000
GROUP_DOCS, GROUP_SHINGLES, LEADERS, BLOCK_DOCS = 256, 1_000_000, 64, 512
MOST_FREQUENT = 2_000_000
LEVEL_BITS = 14
LEVELS = 1 << LEVEL_BITS


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order of their hash, how often each occurs, and where each text's begin."""
    w = words(column)
    h = w.hashes()
    ok = gram_mask(w.first, WIDTH)
    doc = w.docs()
    g, of = grams(h, WIDTH)[ok], doc[: len(ok)][ok]
    short = np.flatnonzero((w.counts > 0) & (w.counts < WIDTH))
    if len(short):
        whole = np.array([grams(h[a:b], b - a)[0] for a, b in zip(w.first[short].tolist(), w.first[short + 1].tolist(), strict=True)], np.uint64)
        g, of = np.concatenate([g, whole]), np.concatenate([of, short])
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(g)))
    return g[at], count, np.searchsorted(of[at], np.arange(len(column) + 1))


# -- frequent shingles -----------------------------------------------------------------


class Tally:
    """Counts of keys in a stream of documents, by lossy counting: what is within its allowance so far is forgotten.

    A key's allowance is how far floor(x + u) has moved since the stream began, where x grows by `share`
    with each document and u, of [0, 1), is given by the key. If one stream begins with the x at which
    another ends, the allowances of all streams come to share * documents + 1 at most, however
    few documents each of them has.
    """

    def __init__(self, share: float, docs_before: int):
        self.share, self.before, self.docs, self.settled = share, docs_before, 0, 0
        self.keys, self.n, self.missed = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.parts, self.size = [], 0

    def allowance(self, keys: np.ndarray, docs: int) -> np.ndarray:
        (low, from_low), (high, from_high) = (divmod(self.share * x, 1.0) for x in (self.before, self.before + docs))
        # floor(x + u) is one more from where u fills up what x lacks to the next whole number
        up = lambda part: (keys >= np.uint64(min(int((1 - part) * 2.0**64), (1 << 64) - 1))).view(np.int8)
        return np.int32(high - low) + up(from_high) - up(from_low)

    def add(self, keys: np.ndarray, docs: int) -> None:
        self.parts.append(keys)
        self.size, self.docs = self.size + len(keys), self.docs + docs

    def settle(self) -> None:
        """Counts what came since the last time. What is new may have been forgotten before, up to its allowance then."""
        keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.parts]), return_counts=True)
        n, self.parts, self.size = n.astype(np.int32), [], 0
        i = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[i] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.n[i[known]] += n[known]
        keys, n = keys[~known], n[~known]
        missed = np.concatenate([self.missed, self.allowance(keys, self.settled)])
        keys, n, self.settled = np.concatenate([self.keys, keys]), np.concatenate([self.n, n]), self.docs
        stay = np.flatnonzero(n + missed > self.allowance(keys, self.docs))
        stay = stay[np.argsort(keys[stay])]
        self.keys, self.n, self.missed = keys[stay], n[stay], missed[stay]

    def report(self, less: bool) -> pa.RecordBatch:
        """The counts, less the allowance once more or as they are, and nothing left here."""
        n = self.n - self.allowance(self.keys, self.docs) if less else self.n
        out = pa.RecordBatch.from_arrays([pa.array(self.keys[n > 0].view(np.int64)), pa.array(n[n > 0].astype(np.int64))], ["shingle", "n"])
        self.keys, self.n, self.missed = self.keys[:0], self.n[:0], self.missed[:0]
        return out


def _stand_out(share: float, before):
    """(shingle, n) of each partition: n is short of the true count by twice the allowance at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(share, before.value.get(TaskContext.get().partitionId(), 0))
        for b in slices(batches):
            tally.add(shingles(b.column("text"))[0], b.num_rows)
            if tally.size >= RUN:
                tally.settle()
            if len(tally.keys) >= TALLY:  # of very long texts: reported in full, so memory stays bounded
                yield tally.report(False)
        tally.settle()
        yield tally.report(True)

    return run


def _among(shared):
    """Exact counts of documents, by slice, of the shingles in the broadcast list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            g = shingles(b.column("text"))[0]
            keys = shared.value
            i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            found, n = np.unique(g[keys[i] == g], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["shingle", "n"])

    return run


class Weights:
    """Shingle weights: the frequent shingles in order, their weights, and the weight of all others."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, n: int, rare: float):
        order = np.argsort(keys)
        self.keys, scale = keys[order], math.log(1 / rare)
        self.other = 1 + min(1.0, math.log(max(n, 1)) / scale)
        self.weight = (1 + np.minimum(1, np.log(np.maximum(n / np.maximum(df[order], 1), 1)) / scale)).astype(np.float32)

    def of(self, g: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = np.full(len(g), self.other, np.float32)
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            w = np.where(self.keys[i] == g, self.weight[i], w)
        return (w * count).astype(np.float32)


def stand_out(docs: DataFrame, n: int) -> DataFrame:
    """(shingle) of all that may be frequent, written: one pass, and one that counts the rows of each partition."""
    rare = RARE
    texts = docs.select("text").coalesce(max(1, n // CHUNK))
    sizes = dict(texts.groupBy(F.spark_partition_id().alias("part")).count().toArrow().to_pandas().itertuples(index=False, name=None))
    before = docs.sparkSession.sparkContext.broadcast({p: sum(v for q, v in sizes.items() if q < p) for p in sizes})
    # of so few documents that fewer than 8 make a shingle frequent, all counts are exact
    share = rare / 4 if rare * n >= 8 else 0.0
    need = max(2, math.ceil((rare - 2 * share) * n) - 2)
    stand = texts.mapInArrow(_stand_out(share, before), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return kept(stand.where(F.col("n") >= need).select("shingle"), "near")


def weights(docs: DataFrame, near: DataFrame, n: int) -> Weights:
    """Exact counts of the shingles in near, a broadcast list, in a second pass over all texts."""
    keys = near.toArrow()["shingle"].to_numpy()
    if not len(keys):
        return Weights(np.zeros(0, np.uint64), np.zeros(0), n, RARE)
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(keys.view(np.uint64)))
    exact = docs.select("text").mapInArrow(_among(shared), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, RARE * n)).toArrow()
    return Weights(exact["shingle"].to_numpy().view(np.uint64), exact["n"].to_numpy(), n, RARE)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different shingle of a text."""
    for b in slices(batches):
        g, count, first = shingles(b.column("text"))
        rest = [c for c in b.schema.names if c != "text"]
        of = pa.array(np.repeat(np.arange(b.num_rows), np.diff(first)))
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in rest), pa.array(g.view(np.int64)), pa.array(count.astype(np.int64))], [*rest, "shingle", "n"])


def shuffled_vectors(rows: DataFrame, near: DataFrame, n: int) -> DataFrame:
    """(text_key, g, w) of each different text of rows(text_key, text): what _vectors gives, with the frequent
    shingles joined by a shuffle. For texts so long that their list is too large to be broadcast."""
    texts = rows.groupBy("text_key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    each = kept(texts.select("text_key", "copies", "text").mapInArrow(_exploded, "text_key binary, copies long, shingle long, n long"), "shingles")
    df = each.join(near, "shingle").groupBy("shingle").agg(F.sum("copies").alias("df")).where(F.col("df") >= max(2, RARE * n))
    plain = Weights(np.zeros(0, np.uint64), np.zeros(0), n, RARE)
    scale = F.lit(math.log(1 / RARE))
    weight = F.coalesce(1 + F.least(F.lit(1.0), F.log(F.greatest(F.lit(n) / F.col("df"), F.lit(1.0))) / scale).cast("float"), F.lit(plain.other).cast("float"))
    joined = each.join(df, "shingle", "left").select("text_key", F.struct("shingle", (weight * F.col("n")).cast("float").alias("w")).alias("s"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, some in zip(b.column("text_key"), b.column("all"), strict=True):
                g = some.values.field("shingle").to_numpy().view(np.uint64)
                order = np.argsort(g)
                w = some.values.field("w").to_numpy()[order]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.binary()), pa.array([g[order].tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], ["text_key", "g", "w"])

    some = joined.groupBy("text_key").agg(F.collect_list("s").alias("all")).mapInArrow(packed, "text_key binary, g binary, w binary")
    return kept(texts.select("text_key").join(some, "text_key", "left").select("text_key", *(F.coalesce(c, F.lit(b"")).alias(c) for c in ("g", "w"))), "weighed")


# -- consistent weighted sampling ------------------------------------------------------


class Sampler:
    """Of each text, for each sample: which shingle, at which quantised weight, is drawn."""

    def __init__(self, other: float, samples: int = BANDS * ROWS, seed: int = 17):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.r = rng.gamma(2, 1, (samples, LEVELS)).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, (samples, LEVELS))).astype(np.float32)
        self.beta = rng.random((samples, LEVELS), np.float32)
        self.factor = rng.integers(1, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)
        self.other = np.float32(other)
        # the ordinary weight's keys, ready made for each level
        self.common = np.stack([self.key(s, np.arange(LEVELS), np.full(LEVELS, self.other), np.zeros(LEVELS, np.uint64)) for s in range(samples)])

    def key(self, s: int, level: np.ndarray, w: np.ndarray, shingle: np.ndarray) -> np.ndarray:
        """Order of a in the upper half, and (shingle, t) hashed in the lower."""
        r, beta = self.r[s, level], self.beta[s, level]
        t = np.floor(np.log(w) / r + beta)
        log_a = self.log_c[s, level] - r * (t - beta) - r
        bits = log_a.astype(np.float32).view(np.int32)
        order = np.where(bits < 0, ~bits, bits ^ np.int32(-(1 << 31))).view(np.uint32).astype(np.uint64)
        low = (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
        return order << np.uint64(32) | (low ^ (shingle & np.uint64(0xFFFFFFFF)))

    def bands(self, g: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One 64-bit value for each text and band; texts without shingles get 0."""
        n = len(first) - 1
        some = np.flatnonzero(np.diff(first) > 0)
        out = np.zeros((n, BANDS), np.uint64)
        if not len(some):
            return out
        low, odd = g & np.uint64(0xFFFFFFFF), np.flatnonzero(w != self.other)
        odd_w, begins = w[odd], first[some]
        for b in range(BANDS):
            value = np.zeros(len(some), np.uint64)
            for s in range(b * ROWS, (b + 1) * ROWS):
                level = ((g * self.factor[s]) >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)
                key = self.common[s][level] ^ low
                if len(odd):
                    key[odd] = self.key(s, level[odd], odd_w, g[odd])
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + (np.minimum.reduceat(key, begins) & np.uint64(0xFFFFFFFF)) + np.uint64(1))
            out[some, b] = value
        return out


def _signatures(weight, other: float):
    """Of rows with their text, or with g and w where no weights are given."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in slices(batches, "text" if weight else "g"):
            if weight:
                g, count, first = shingles(b.column("text"))
                yield b, g, weight.value.of(g, count), first
            else:
                g, w = ([np.frombuffer(x, kind) for x in b.column(c).to_pylist()] for c, kind in (("g", np.uint64), ("w", np.float32)))
                yield b, np.concatenate(g), np.concatenate(w), np.concatenate([[0], np.cumsum([len(x) for x in g])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(other)
        for b, g, w, first in vectors(batches):
            bands = sampler.bands(g, w, first)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(np.diff(first)), *(pa.array(np.ascontiguousarray(bands[:, i]).view(np.int64)) for i in range(BANDS))], ["doc_id", "text_key", "shingles", *(f"b{i}" for i in range(BANDS))])

    return run


# -- verification ----------------------------------------------------------------------


def _vectors(weight):
    """The shingles' hashes and their weights, as bytes, in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            g, count, first = shingles(b.column("text"))
            w = weight.value.of(g, count)
            cut = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array([g[x:y].tobytes() for x, y in cut], pa.binary()), pa.array([w[x:y].tobytes() for x, y in cut], pa.binary())], [*rest, "g", "w"])

    return run


def similar(ours: list, theirs: list, threshold: float = THRESHOLD) -> Iterator[tuple[int, np.ndarray]]:
    """For each (g, w) of ours, which of theirs have that weighted Jaccard similarity or more."""
    g = np.concatenate([x for x, _ in theirs])
    w = np.concatenate([x for _, x in theirs]).astype(float)
    owner = np.repeat(np.arange(len(theirs)), [len(x) for x, _ in theirs])
    total = np.bincount(owner, weights=w, minlength=len(theirs))
    order = np.argsort(g, kind="stable")
    g, w, owner = g[order], w[order], owner[order]
    for i, (mine, weight) in enumerate(ours):
        a, n = np.searchsorted(g, mine, "left"), 0
        n = np.searchsorted(g, mine, "right") - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(owner[at], weights=np.minimum(np.repeat(weight.astype(float), n), w[at]), minlength=len(theirs))
        yield i, np.flatnonzero(both >= (threshold - 1e-9) * (weight.sum(dtype=float) + total - both))


class _Sets:
    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _links(t: pa.Table) -> pa.Table:
    """Links of a block between the rows that ask and all rows: as many as it takes to join them."""
    asks = t["asks"].to_numpy()
    keys = t["text_key"].to_pylist()
    vectors = [(np.frombuffer(g, np.uint64), np.frombuffer(w, np.float32)) for g, w in zip(t["g"].to_pylist(), t["w"].to_pylist(), strict=True)]
    sets, out, who = _Sets(len(keys)), [], np.flatnonzero(asks)
    at: dict = {}
    for i, k in enumerate(keys):  # a text may be there as leader and as member
        if at.setdefault(k, i) != i:
            sets.join(at[k], i)
    for i, found in similar([vectors[j] for j in who], vectors) if len(who) else ():
        for j in found.tolist():
            if sets.join(int(who[i]), j):
                out.append((keys[who[i]], keys[j]))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _compare(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).applyInArrow(_links, "a binary, b binary")


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, class_id, class_key, texts) of every row of documents(doc_id, text).

    class_id and class_key name the row that stands for the class, texts is its number of different texts.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.unhex(F.md5("text")))
    n = rows.count()
    near = stand_out(rows, n)
    few = near.count() <= MOST_FREQUENT
    weight = spark.sparkContext.broadcast(weights(rows, near, n)) if few else None
    other = Weights(np.zeros(0, np.uint64), np.zeros(0), n, RARE).other
    bands = [f"b{i}" for i in range(BANDS)]
    kind = dict(docs.dtypes)["doc_id"]
    form = f"doc_id {kind}, text_key binary, shingles long, " + ", ".join(f"{b} long" for b in bands)
    weighed = None if few else shuffled_vectors(rows, near, n)
    with_vectors = rows if few else rows.select("doc_id", "text_key").join(weighed, "text_key").select("doc_id", "text_key", "g", "w")
    signed = kept(with_vectors.mapInArrow(_signatures(weight, other), form), "signatures")

    # copies fall together here; each different text goes on once
    texts = kept(signed.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.max("shingles").alias("shingles"), *(F.max(b).alias(b) for b in bands)), "texts")
    banded = texts.where("shingles > 0").select("text_key", F.posexplode(F.array(*bands)).alias("band", "value"))
    leads = banded.groupBy("band", "value").agg(F.min("text_key").alias("lead"), F.count("*").alias("n")).where("n > 1")
    stars = banded.join(leads, ["band", "value"]).groupBy("text_key").agg(F.collect_set("lead").alias("leads"))
    stars = kept(stars.withColumn("home", F.array_min("leads")), "stars")
    # a text hangs on the least of its leads, so that only leads are left to be connected
    ties = components(stars.select(F.col("home").alias("a"), F.explode("leads").alias("b")))
    candidates = stars.join(ties, F.col("home") == F.col("v"), "left").select("text_key", F.coalesce("label", "home").alias("batch"))

    members = kept(candidates.join(texts.select("text_key", "doc_id", "shingles"), "text_key"), "candidates")
    sizes = members.groupBy("batch").agg(F.count("*").alias("docs"), F.sum("shingles").alias("total"))
    sizes = sizes.withColumn("large", (F.col("docs") > GROUP_DOCS) | (F.col("total") > GROUP_SHINGLES))
    # one row of each text, combined before the shuffle. What goes with it is joined before the shingles
    # are made, so that these are shuffled once, to their group
    asked = members.join(sizes, "batch").select("text_key", "batch", "large", "docs", "total")
    if few:
        once = rows.groupBy("text_key").agg(F.first("text").alias("text")).join(asked.hint("merge"), "text_key")
        vectors = once.select("batch", "large", "docs", "total", "text_key", "text").mapInArrow(_vectors(weight), "batch binary, large boolean, docs long, total long, text_key binary, g binary, w binary")
    else:
        vectors = weighed.join(asked, "text_key")
    vectors = kept(vectors, "vectors")

    small = _compare(vectors.where("not large").select("batch", "text_key", "g", "w", F.lit(True).alias("asks")), "batch")
    links = kept(small, "links")
    large = vectors.where("large")
    if large.limit(1).count():
        blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("total") / GROUP_SHINGLES)).cast("int")
        mine = F.pmod(F.xxhash64("text_key"), blocks).cast("int")
        cols = ["batch", "block", "text_key", "g", "w", "asks"]
        member = large.withColumn("block", mine).withColumn("asks", F.lit(False)).select(cols)
        lead = large.where(F.pmod(F.xxhash64("text_key", F.lit(1)), F.lit(1 << 20)) < F.lit(LEADERS << 20) / F.col("docs"))
        lead = lead.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("asks", F.lit(True)).select(cols)
        links = kept(links.union(_compare(member.union(lead), "batch", "block")), "links")
        # what isn't in its batch's largest class yet asks all of the batch
        found = components(links)
        state = large.select("batch", "text_key").join(found, F.col("text_key") == F.col("v"), "left").select("batch", "text_key", F.coalesce("label", "text_key").alias("label"))
        state = kept(state, "state")
        top = state.groupBy("batch", "label").count().groupBy("batch").agg(F.max_by("label", "count").alias("top"))
        rest = state.join(top, "batch").where("label != top").select("text_key")
        asking = large.join(rest, "text_key", "left_semi").withColumn("ask", F.pmod(F.xxhash64("text_key", F.lit(2)), blocks).cast("int"))
        groups = asking.select("batch", "ask").distinct()
        asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("asks", F.lit(True)).select("ask", *cols)
        member = member.join(groups, "batch").select("ask", *cols)
        links = kept(links.union(_compare(member.union(asking), "batch", "ask", "block")), "links")

    classes = components(links)
    named = texts.select("text_key", "doc_id").join(classes, F.col("text_key") == F.col("v"), "left").select("text_key", "doc_id", F.coalesce("label", "text_key").alias("label"))
    named = kept(named, "named")
    first = F.min(F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "text_key"))
    ids = named.groupBy("label").agg(first.alias("first"), F.count("*").alias("texts"))
    named = named.join(ids, "label").select("text_key", F.col("first.doc_id").alias("class_id"), F.col("first.text_key").alias("class_key"), "texts")
    return signed.select("doc_id", "text_key").join(named, "text_key").select("doc_id", "text_key", "class_id", "class_key", "texts")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, that of the least doc_id, with all its columns."""
    first = duplicates(docs).where((F.col("text_key") == F.col("class_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "text_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"))
    same = (rows["text_key"] == first["text_key"]) & rows["doc_id"].eqNullSafe(first["doc_id"])
    return rows.join(first, same, "left_semi").dropDuplicates(["text_key", "doc_id"]).select("row.*")


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "texts", F.hex("text_key").alias("text_key"))


#: All pairs that share a shingle, and components by recursion: for small tables.
OP8_SQL = rf"""
with recursive rows_ as (select doc_id, coalesce(text, '') as text, upper(md5(coalesce(text, ''))) as text_key from documents),
texts as (
  select text_key, min(doc_id) as doc_id, count(*) as copies, regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+') as w from rows_ group by text_key),
places as (
  select text_key, array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' ') as s
  from (select text_key, w, unnest(range(1, greatest(1, len(w) - {WIDTH - 1}) + 1)) as i from texts where len(w) > 0)),
counts as (select text_key, s, count(*) as n from places group by text_key, s),
total as (select sum(copies) as n from texts),
weights as (
  select s, 1 + least(1, ln((select n from total) / sum(copies)) / ln({1 / RARE})) as w
  from counts join texts using (text_key) group by s),
weighed as (select text_key, s, n * w as w from counts join weights using (s)),
sizes as (select text_key, sum(w) as size from weighed group by text_key),
shared as (
  select a.text_key as x, b.text_key as y, sum(least(a.w, b.w)) as w
  from weighed a join weighed b on a.s = b.s and a.text_key < b.text_key group by 1, 2),
links as (
  select x, y from shared join sizes p on p.text_key = x join sizes q on q.text_key = y
  where shared.w >= ({THRESHOLD} - 1e-9) * (p.size + q.size - shared.w)),
edges as (select x, y from links union all select y, x from links),
reach(a, b) as (select text_key, text_key from texts union select a, y from reach join edges on b = x),
labels as (select a as text_key, min(b) as label from reach group by a),
classes as (select label, min(doc_id) as class_id, count(*) as texts from labels join texts using (text_key) group by label)
select doc_id, class_id, texts, text_key from rows_ join labels using (text_key) join classes using (label)
"""
