"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, toxic (c = 1) and ordinary (c = 0), of words after the word before:

    p_c(w | v) = (max(n_c(v w) - D, 0) + (B + sum_x min(n_c(v x), D)) p_c(w)) / (n_c(v) + B)
    p_c(w)     = (max(k_c(w) - D, 0) + sum_x min(k_c(x), D) p(w)) / sum_x k_c(x)
    p(w)       = (k(w) + 1) / (sum_x k(x) + words + 1)

n_c counts the different words before a pair, so that a passage copied from text to text counts
once, and k_c(w) is the number of different words before w. k(w), shared by both classes, is the number of
texts that hold w, over all documents given. Each p_c adds up to 1. A rare expression has no
more than D, so it rests on the shared counts alone and speaks for neither class.

A text's evidence is the difference of the two log-likelihoods, divided by its words: over the whole
text, and over the runs of PASSAGES words where it is largest. From each word's difference that of a new word is
taken off, as it tells the sizes of the classes' samples only; so new words count 0 in texts of any length. Logistic calibration on labelled
documents that the counts haven't seen turns it into a probability.

Training takes a bounded sample of labelled documents (about `max_docs`, and about `max_bytes` of text). What
both classes have D times at most follows from the shared counts without an entry of its own, so
the model that is broadcast has at most an entry for every third word of the sample. Every text
is scored whole. D, B and PASSAGES were chosen by four-fold cross-validation on the rows of sf0.1 whose
crc32(doc_id) mod 4 is not 2.

Nulls: a null text scores as an empty one, whose score is the calibrated prior.
A null id is never held out. Repeated rows score alike, each in a row of its own. Equal texts, and
rows of one id, with different labels count as toxic. With no labelled row of either class every score is 0.
An empty table of documents gives no rows; equal scores need no order, as each row is judged by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import labelled, remainder, table
from loomwork.llm.text import grams, mix, slices, sums, words

DISCOUNT, STRENGTH = 3, 10_000
PASSAGES = (1, 8, 24)
EVIDENCE = 3 + len(PASSAGES)
START = np.uint64(1)
#: Bytes that part words here: all of ASCII but letters and digits. Upper case is folded.
BREAK = np.zeros(256, bool)
BREAK[:128] = True
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _pairs(column: pa.Array):
    """Words, their hashes and the hash of each with the word before it (START at a text's begin)."""
    w = words(column, BREAK)
    h = w.hashes(FOLD[w.data])
    before = np.empty_like(h)
    before[1:], begins = h[:-1], w.first[:-1][w.counts > 0]
    before[begins] = START
    flat = np.empty(2 * len(h), np.uint64)
    flat[::2], flat[1::2] = before, h
    return w, h, before, grams(flat, 2)[::2]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice's different (word before, pair) with their classes: a passage that is copied counts once."""
    for batch in slices(batches):
        w, h, before, pair = _pairs(batch.column("text"))
        label = np.repeat(batch.column("label").to_numpy(zero_copy_only=False), w.counts) > 0
        left = np.empty_like(h)
        left[1:], left[w.first[:-1][w.counts > 0]] = before[:-1], START
        for c in (False, True):
            mine = np.flatnonzero(label == c)
            at = mine[np.unique(mix(pair[mine] ^ left[mine] * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[at].view(np.int64)) for x in (left, pair, before, h)), pa.array(np.full(len(at), c))], ["left", "pair", "ctx", "word", "toxic"])


def _texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): in how many of the texts each word occurs, combined over about a million words at a time."""
    parts, size = [], 0

    def counted() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in slices(batches):
        w, h, _, _ = _pairs(batch.column("text"))
        doc = w.docs()
        order = np.lexsort((h, doc))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        parts.append(h[order][new])
        size += len(parts[-1])
        if size >= 1_000_000:
            yield counted()
            parts, size = [], 0
    yield counted()


class Model:
    """Log ratios, by hash: of pairs, of words, and of the shares of a context that go to its words' own probabilities.

    What isn't there has the ratio that follows from the shared counts: `new` for a word, 0 for a context,
    and for a pair the sum of these two.
    """

    def __init__(self, pairs: tuple, contexts: tuple, words: tuple, new: float):
        by_key = lambda keys, x: (keys[order := np.argsort(keys)], x[order].astype(np.float32))
        (self.pair, self.of_pair), (self.context, self.of_context), (self.word, self.of_word) = (by_key(*x) for x in (pairs, contexts, words))
        self.new = np.float32(new)

    @staticmethod
    def find(keys: np.ndarray, values: np.ndarray, x: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        if not len(keys):
            return np.broadcast_to(np.float32(other) if np.isscalar(other) else other, x.shape)
        i = np.searchsorted(keys, x)
        i[i == len(keys)] = 0
        return np.where(keys[i] == x, values[i], other)

    def ratios(self, word: np.ndarray, before: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log p_1(w | v) - log p_0(w | v)."""
        alone = self.find(self.word, self.of_word, word, self.new) + self.find(self.context, self.of_context, before, np.float32(0))
        return self.find(self.pair, self.of_pair, pair, alone)

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Per text: mean log ratio beyond a new word's, the sum over the root of the length, the length damped, and the best passages' means."""
        w, h, before, pair = _pairs(column)
        out = np.zeros((len(column), EVIDENCE))
        if not len(h):
            return out
        # each distinct pair is looked up once
        _, at, back = np.unique(pair, return_index=True, return_inverse=True)
        ratio = (self.ratios(h[at], before[at], pair[at])[back] - self.new).astype(float)
        total, n = sums(ratio, w.first), np.maximum(w.counts, 1)
        out[:, 0], out[:, 1], out[:, 2] = total / n, total / np.sqrt(n), np.log1p(w.counts) / 10
        along, some, place = np.concatenate([[0], np.cumsum(ratio)]), np.flatnonzero(w.counts > 0), np.arange(len(h))
        end = np.repeat(w.first[1:], w.counts)
        for i, k in enumerate(PASSAGES):
            run = (along[np.minimum(place + k, end)] - along[:-1]) / k
            out[some, 3 + i] = np.maximum(np.maximum.reduceat(run, w.first[:-1][some]), 0)
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights, the last of them the intercept, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * len(y) * w * 1e-2
        hessian = (x * (p * (1 - p))[:, None]).T @ x + (ridge * len(y) * 1e-2 + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _entries(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.toArrow()
    return t["key"].to_numpy().view(np.uint64), t["ratio"].to_numpy()


def estimate(counts: DataFrame, texts: DataFrame) -> Model | None:
    """From counts(pair, ctx, word, n0, n1), and the words of all texts(text). None without words of both classes."""
    below = lambda c: F.least(F.col(c), F.lit(DISCOUNT))
    above = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0))
    vocabulary = counts.groupBy("word").agg(F.count_if(F.col("n0") > 0).alias("k0"), F.count_if(F.col("n1") > 0).alias("k1"))
    whole = vocabulary.agg(*(f.alias(a) for c in "01" for f, a in ((F.sum(f"k{c}"), f"all{c}"), (F.sum(below(f"k{c}")), f"low{c}")))).first()
    if not (whole["all0"] and whole["all1"]):
        return None
    shared = texts.select("text").mapInArrow(_texts_with, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).persist()
    total, kinds = shared.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    p = (F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total + kinds + 1))
    word = vocabulary.join(shared, "word", "left").select("word", "k0", "k1", *((above(f"k{c}") / F.lit(float(whole[f"all{c}"])) + F.lit(whole[f"low{c}"] / whole[f"all{c}"]) * p).alias(f"p{c}") for c in "01"))
    context = counts.groupBy("ctx").agg(*(f.alias(a) for c in "01" for f, a in ((F.sum(f"n{c}"), f"after{c}"), (F.sum(below(f"n{c}")), f"low{c}"))))
    left = lambda c: (F.lit(STRENGTH) + F.col(f"low{c}")) / (F.col(f"after{c}") + STRENGTH)
    pair = counts.where(F.greatest("n0", "n1") > DISCOUNT).join(context, "ctx").join(word, "word")
    full = lambda c: above(f"n{c}") / (F.col(f"after{c}") + STRENGTH) + left(c) * F.col(f"p{c}")
    model = Model(
        _entries(pair.select(F.col("pair").alias("key"), F.log(full("1") / full("0")).alias("ratio"))),
        _entries(context.where("after0 > low0 or after1 > low1").select(F.col("ctx").alias("key"), F.log(left("1") / left("0")).alias("ratio"))),
        _entries(word.where(F.greatest("k0", "k1") > DISCOUNT).select(F.col("word").alias("key"), F.log(F.col("p1") / F.col("p0")).alias("ratio"))),
        float(np.log(whole["low1"] / whole["all1"]) - np.log(whole["low0"] / whole["all0"])),
    )
    shared.unpersist()
    return model


def pair_counts(sample: DataFrame) -> DataFrame:
    """(pair, ctx, word, n0, n1) of sample(text, label): different words before each pair in the texts of each class."""
    each = sample.groupBy("text").agg(F.max("label").alias("label")).mapInArrow(_count, "left long, pair long, ctx long, word long, toxic boolean").distinct()
    return each.groupBy("pair", "ctx", "word").agg(F.count_if(~F.col("toxic")).alias("n0"), F.count_if("toxic").alias("n1"))


def train(sample: DataFrame, texts: DataFrame) -> tuple[Model, np.ndarray] | None:
    """Model from three quarters of sample(doc_id, text, label), calibration from the rest. None without both classes."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4))
    counts = pair_counts(sample.where(fold != 0)).persist()
    model = estimate(counts, texts)
    counts.unpersist()
    if model is None:
        return None
    rest = score_evidence(sample.where(fold == 0).select("text", "label"), model).toArrow()
    x = np.stack([rest[f"e{i}"].to_numpy() for i in range(EVIDENCE)], 1)
    y = rest["label"].to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # the sums are the same, whatever the partitions
    return model, fit_logistic(x[order], y[order]) if len(y) else np.array([1.0, 1.0, *[0.0] * (EVIDENCE - 1)])


def score_evidence(df: DataFrame, model: Model) -> DataFrame:
    """All columns but text, with the evidence e0, e1, ..."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            e = shared.value.evidence(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *(pa.array(e[:, i]) for i in range(EVIDENCE))], [*rest, *(f"e{i}" for i in range(EVIDENCE))])

    fields = [df.schema[c] for c in rest] + [T.StructField(f"e{i}", T.DoubleType()) for i in range(EVIDENCE)]
    return df.mapInArrow(run, T.StructType(fields))


def probability(weights: np.ndarray) -> Column:
    """Of the evidence e0, e1, ..."""
    z = sum((F.col(f"e{i}") * float(weights[i]) for i in range(EVIDENCE)), F.lit(float(weights[EVIDENCE])))
    return 1 / (1 + F.exp(-z))


def toxicity(docs: DataFrame, labels: DataFrame, usable=None, threshold: float = 0.3, max_docs: int = 8000, max_bytes: int = 1 << 26) -> DataFrame:
    """(doc_id, score, predicted) of every document; labels(doc_id, toxic) where `usable` holds are learned from."""
    trained = train(labelled(docs, labels, "toxic", F.lit(True) if usable is None else usable, max_docs, max_bytes), docs)
    if trained is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    scored = score_evidence(docs.select("doc_id", "text"), trained[0]).select("doc_id", probability(trained[1]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, usable=None, threshold: float = 0.3, max_docs: int = 8000, max_bytes: int = 1 << 26) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    trained = train(labelled(docs, labels, "toxic", F.lit(True) if usable is None else usable, max_docs, max_bytes), docs)
    if trained is None:
        return docs
    scored = score_evidence(docs.select(F.struct("*").alias("row"), "text"), trained[0])
    return scored.where(probability(trained[1]) < threshold).select("row.*")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity(docs, labels, remainder("doc_id", 4) != 2)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
