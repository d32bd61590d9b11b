"""Language by a linear-chain conditional random field over words.

Each word carries affix, byte n-gram and lexicon features, hashed into a table of weights
for each language; learned transitions tie neighbouring words. The lexicon of a language is
learned from the training rows: words of at least LEXICON_TEXTS of their texts, LEXICON_SHARE of these in
that language. Forward-backward gives each word's distribution over languages, so text that switches
language is labelled word by word; a document's language is the one with the largest mean over its words.

Training: at most about `per_language` documents of each language, whole, and about `max_bytes` of
text, drawn by a hash of the id, so a rare language is learned as well. Their words go in runs of
`run` words; runs of different documents are strung together, so the transitions see switches. The order of rows
doesn't matter. The weights have a fixed size, and the lexicon is no larger than the sample's
vocabulary; they are what is broadcast. Prediction is one pass over whole texts, without any shuffle.
Long texts are cut into segments whose transfer matrices are multiplied, which gives the same
values as going word by word.

Nulls: `und` with score 0 where the text is null or has no letter, or where nothing could
be learned. A null language or id isn't learned from. Repeated rows are predicted alike.
Of languages with equal scores the first by name is given. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import remainder, table
from loomwork.llm.text import mix, slices, sums, words

BITS = 17
LEXICON_TEXTS, LEXICON_SHARE = 3, 0.9
SEGMENT = 128
#: Words are runs of ASCII letters and of all bytes beyond ASCII.
BREAK = np.zeros(256, bool)
BREAK[:128] = True
BREAK[[*range(65, 91), *range(97, 123)]] = False


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the accented capitals of Latin-1."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each run, one run after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


class Lexicon:
    """Words, by hash, that belong to one language."""

    def __init__(self, hashes: np.ndarray, language: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.language = hashes[order], language[order]

    @classmethod
    def learned(cls, words: np.ndarray, texts: np.ndarray, label: np.ndarray, k: int) -> Lexicon:
        """From each word's hash, text and language."""
        order = np.lexsort((texts, words))
        words, texts, label = words[order], texts[order], label[order]
        once = np.ones(len(words), bool)
        once[1:] = (words[1:] != words[:-1]) | (texts[1:] != texts[:-1])
        keys, at = np.unique(words[once], return_inverse=True)
        n = np.bincount(at * k + label[once], minlength=len(keys) * k).reshape(-1, k)
        sure = (n.sum(1) >= LEXICON_TEXTS) & (n.max(1, initial=0) >= LEXICON_SHARE * n.sum(1))
        return cls(keys[sure], n[sure].argmax(1) if sure.any() else np.zeros(0, np.int64))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """1 + the language of each word, or 0."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[i] == hashes, self.language[i] + 1, 0)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of words, flat, and how many each has: the word itself, affixes of 1 to 4 bytes, its lexicon, all trigrams."""
    n, size = len(starts), ends - starts
    fixed = np.empty((n, 10), np.uint64)
    fixed[:, 0] = hashes
    fixed[:, 9] = mix(lexicon.of(hashes).astype(np.uint64) + np.uint64(1 << 52))
    with np.errstate(over="ignore"):
        left, right = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(4):
            left = np.where(k < size, left * np.uint64(257) + data[np.minimum(starts + k, ends - 1)] + np.uint64(1), left)
            right = np.where(k < size, right * np.uint64(257) + data[np.maximum(ends - 1 - k, starts)] + np.uint64(1), right)
            fixed[:, 1 + k] = mix(left + np.uint64((2 * k + 1) << 40))
            fixed[:, 5 + k] = mix(right + np.uint64((2 * k + 2) << 40))
        m = np.maximum(size - 2, 0)
        at = spread(starts, m)
        tri = mix(data[at].astype(np.uint64) << np.uint64(16) | data[at + 1].astype(np.uint64) << np.uint64(8) | data[at + 2] | np.uint64(1 << 50)) if len(at) else np.zeros(0, np.uint64)
    counts = 10 + m
    flat = np.empty(int(counts.sum()), np.uint64)
    begin = np.cumsum(counts) - counts
    flat[spread(begin, np.full(n, 10))] = fixed.ravel()
    flat[spread(begin + 10, m)] = tri
    return (flat & np.uint64((1 << BITS) - 1)).astype(np.int64), counts


class Chain:
    """The transitions, and forward-backward over many texts at once."""

    def __init__(self, start: np.ndarray, move: np.ndarray):
        self.start, self.move = start, move

    def marginals(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each word, given the words' potentials and where each text's words begin."""
        forward, backward, _ = self.passes(e, first)
        result = forward * backward
        return result / result.sum(1, keepdims=True) if len(result) else result

    def gradient(self, e: np.ndarray, first: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the labels' log-likelihood, by the potentials, the start and the transitions: what is there less what is expected."""
        forward, backward, potential = self.passes(e, first)
        p = forward * backward
        by_word = -p / p.sum(1, keepdims=True) if len(p) else -p
        by_word[np.arange(len(label)), label] += 1
        inner = np.ones(len(label), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        j, k = np.flatnonzero(inner), len(self.start)
        pair = forward[j - 1][:, :, None] * np.exp(self.move - self.move.max())[None] * (potential[j] * backward[j])[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        by_move = np.bincount(label[j - 1] * k + label[j], minlength=k * k).reshape(k, k) - pair.sum(0)
        return by_word, by_word[~inner].sum(0), by_move

    def passes(self, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word, each up to a factor: forward with the word itself, backward without it, and its potentials, not in logs."""
        e = np.exp(e - e.max(1, keepdims=True)) if len(e) else e
        start, move = np.exp(self.start - self.start.max()), np.exp(self.move - self.move.max())
        k, counts = len(start), np.diff(first)
        pieces = -(-counts // SEGMENT)
        owner = np.repeat(np.arange(len(counts)), pieces)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = first[owner] + step * SEGMENT
        size = np.minimum(SEGMENT, first[owner + 1] - at)
        order = np.argsort(-size, kind="stable")
        at_, size_, head = at[order], size[order], step[order] == 0
        active = np.searchsorted(-size_, -np.arange(1, SEGMENT + 1), "right")  # segments with more than t words

        into, out = np.ones((len(owner), k)), np.ones((len(owner), k))
        into[step == 0] = start
        if pieces.max(initial=0) > 1:
            many = np.flatnonzero(pieces[owner[order]] > 1)
            a, s, h = at_[many], size_[many], head[many]
            mats = np.broadcast_to(np.eye(k), (len(many), k, k)).copy()
            for t in range(int(s[0])):
                n = int(np.searchsorted(-s, -t, "left"))
                moved = mats[:n] @ move
                if t == 0:
                    moved[h[:n]] = mats[:n][h[:n]]
                moved *= e[a[:n] + t][:, None, :]
                mats[:n] = moved / moved.sum((1, 2), keepdims=True)
            full = np.empty((len(owner), k, k))
            full[order[many]] = mats
            base = np.cumsum(pieces) - pieces
            by = np.argsort(-pieces, kind="stable")
            for j in range(1, int(pieces.max())):
                i = base[by[: np.searchsorted(-pieces[by], -j, "left")]] + j
                v = np.einsum("nk,nkl->nl", into[i - 1], full[i - 1])
                into[i] = v / v.sum(1, keepdims=True)
            for j in range(int(pieces.max()) - 1, 0, -1):
                i = base[by[: np.searchsorted(-pieces[by], -j, "left")]] + j
                v = np.einsum("nkl,nl->nk", full[i], out[i])
                out[i - 1] = v / v.sum(1, keepdims=True)

        forward, backward = np.empty((len(e), k)), np.empty((len(e), k))
        v = into[order]
        for t in range(SEGMENT):
            n = int(active[t])
            if not n:
                break
            w = v[:n] @ move
            if t == 0:
                w[head[:n]] = v[:n][head[:n]]
            i = at_[:n] + t
            w *= e[i]
            w /= w.sum(1, keepdims=True)
            v[:n] = forward[i] = w
        v = out[order]  # after the last word of a segment
        for t in range(SEGMENT - 1, -1, -1):
            n = int(active[t])
            if not n:
                continue
            i = at_[:n] + t
            backward[i] = v[:n]
            v[:n] = (e[i] * v[:n]) @ move.T
            v[:n] /= v[:n].sum(1, keepdims=True)
        return forward, backward, e


class Tagger:
    def __init__(self, languages: list[str], weights: np.ndarray, chain: Chain, lexicon: Lexicon):
        self.languages, self.weights, self.chain, self.lexicon = languages, weights, chain, lexicon

    def tag(self, column: pa.Array):
        """The words, and each word's distribution over the languages."""
        w = words(column, BREAK)
        data = folded(w.data)
        keys, at, back = np.unique(w.hashes(data), return_index=True, return_inverse=True)
        ids, counts = word_features(data, w.starts[at], w.ends[at], keys, self.lexicon)
        begin = np.concatenate([[0], np.cumsum(counts)])
        e = sums(self.weights[ids], begin)[back]
        return w, self.chain.marginals(e, w.first)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        w, p = self.tag(column)
        mean = sums(p, w.first) / np.maximum(w.counts, 1)[:, None]
        best = mean.argmax(1)
        letter = np.zeros(len(column), bool)
        plain = sums((~BREAK[w.data] & (w.data < 128)).astype(float), w.offsets) > 0
        letter[plain] = True
        for i in np.flatnonzero(~plain & (w.counts > 0)).tolist():
            letter[i] = any(c.isalpha() for c in w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().decode("utf-8", "replace"))
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist(), strict=True)], np.where(letter, np.round(mean.max(1), 9), 0.0)


def _runs(run: int):
    """Each text in consecutive runs of words, joined by blanks."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = words(b.column("text"), BREAK)
            text, row, piece = [], [], []
            for i, (a, z) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                for c in range(a, z, run):
                    text.append(" ".join(w.data[w.starts[j] : w.ends[j]].tobytes().decode("utf-8", "replace") for j in range(c, min(c + run, z))))
                    row.append(i)
                    piece.append((c - a) // run)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(text, pa.string()), b.column("lang").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())], ["doc_id", "text", "lang", "piece"])

    return f


def fit(runs: list[str], labels: list[str], of: list | None = None, epochs: int = 4, string: int = 5, batch: int = 40, rate: float = 0.3, ridge: float = 1e-6, seed: int = 3) -> Tagger:
    """Stochastic gradient of the conditional log-likelihood, with a step size for each weight. of: the text of each run."""
    languages = sorted(set(labels))
    k = len(languages)
    w = words(pa.array(runs, pa.string()), BREAK)
    data = folded(w.data)
    keys, at, back = np.unique(w.hashes(data), return_index=True, return_inverse=True)
    y = np.array([languages.index(x) for x in labels])
    texts = np.unique(np.array(range(len(runs)) if of is None else of), return_inverse=True)[1]
    lexicon = Lexicon.learned(keys[back], np.repeat(texts, w.counts), np.repeat(y, w.counts), k)
    ids, counts = word_features(data, w.starts[at], w.ends[at], keys, lexicon)
    begin = np.concatenate([[0], np.cumsum(counts)])
    rng = np.random.default_rng(seed)
    weights, chain = np.zeros((1 << BITS, k)), Chain(np.zeros(k), np.zeros((k, k)))
    g_w, g_s, g_m = np.full_like(weights, 1e-2), np.full(k, 1e-2), np.full((k, k), 1e-2)
    sizes = w.counts
    # half of the strings mix any runs, half keep to one language
    for _ in range(epochs):
        mixed = rng.permutation(len(runs))
        half = len(runs) // 2
        kept = mixed[half:]
        perm = np.concatenate([mixed[:half], kept[np.argsort(y[kept], kind="stable")]])
        strings = [perm[i : i + string] for i in range(0, len(perm), string)]
        rng.shuffle(strings)
        for i in range(0, len(strings), batch):
            part = strings[i : i + batch]
            chosen = np.concatenate(part)
            token = spread(w.first[:-1][chosen], sizes[chosen])
            label = np.repeat(y[chosen], sizes[chosen])
            first = np.concatenate([[0], np.cumsum([int(sizes[s].sum()) for s in part])])
            u, inverse = np.unique(back[token], return_inverse=True)
            f, n = ids[spread(begin[u], counts[u])], counts[u]
            e = sums(weights[f], np.concatenate([[0], np.cumsum(n)]))[inverse]
            delta, gs, gm = chain.gradient(e, first, label)
            du = np.zeros((len(u), k))
            for c in range(k):
                du[:, c] = np.bincount(inverse, weights=delta[:, c], minlength=len(u))
            du = np.repeat(du, n, axis=0)
            touched, slot = np.unique(f, return_inverse=True)
            g = np.stack([np.bincount(slot, weights=du[:, c], minlength=len(touched)) for c in range(k)], 1) / len(part) - ridge * weights[touched]
            g_w[touched] += g**2
            weights[touched] += rate * g / np.sqrt(g_w[touched])
            for value, grad, total in ((chain.move, gm / len(part), g_m), (chain.start, gs / len(part), g_s)):
                total += grad**2
                value += rate * grad / np.sqrt(total)
    return Tagger(languages, weights.astype(np.float32), chain, lexicon)


def drawn(docs: DataFrame, usable: Column, per_language: int, max_bytes: int) -> DataFrame:
    """(doc_id, text, lang) of about so many documents of each language, and so much text, by a hash of the id."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20))
    # the languages are what is to be learned, so there are few; without the hint both sides, texts and all, would be shuffled by them
    shares = known.groupBy(F.col("lang").alias("of_lang")).agg(F.least(F.lit(1.0), F.lit(per_language) / F.count("*")).alias("share"))
    sample = known.join(F.broadcast(shares), F.col("lang") == F.col("of_lang")).where(draw < F.col("share") * (1 << 20))
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    less = min(1.0, max_bytes / max(1, size))
    return (sample if less == 1 else sample.where(draw < F.col("share") * (1 << 20) * less)).select("doc_id", "text", "lang")


def languages(docs: DataFrame, usable=None, per_language: int = 500, max_bytes: int = 1 << 24, run: int = 40) -> DataFrame:
    """(doc_id, lang_pred, score) of every document; rows with a language where `usable` holds are learned from."""
    sample = drawn(docs, F.lit(True) if usable is None else usable, per_language, max_bytes)
    t = sample.mapInArrow(_runs(run), f"doc_id {dict(docs.dtypes)['doc_id']}, text string, lang string, piece int").toArrow()
    if not t.num_rows:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    t = t.sort_by([(c, "ascending") for c in ("doc_id", "lang", "piece", "text")])
    tagger = docs.sparkSession.sparkContext.broadcast(fit(t["text"].to_pylist(), t["lang"].to_pylist(), t["doc_id"].to_pylist()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = tagger.value.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages(docs, remainder("doc_id", 4) != 2)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
