"""Substring dedup: words in repeated runs of WIDTH words, found by FM-indexes of shards.

A window is WIDTH consecutive words of one text. It is repeated if its words also start
anywhere else. Each word that a repeated window covers is removed; windows are judged on the
input.

No index of the whole corpus could be held, and searching every shard for every text would
grow with the square of the corpus. So shards are cut by content: a window's minimizer is
the least hash among its GRAM-word runs (the leftmost of equals), and the consecutive windows
of a text that share it form a segment. Equal windows have equal minimizers, so both places
of a repeat are in segments of one minimizer, and these go to one shard.

1. One pass gives the segments' minimizers. Those that occur once are done: nothing in
   them is repeated.
2. The words of the others (40 bits of each word's hash) go to the shard of their minimizer.
   The shard builds an FM-index of its different segments, a unique separator after each, and
   streams the segments through it: backward search over the wavelet matrix gives how far each
   window's match reaches, and with it the windows that occur twice or more. A segment that
   is there twice as a whole is repeated in all its windows without a search.
3. A minimizer of more than HOT segments would fill a shard by itself. Its segments are cut once
   more, by minimizers of LONGER-word runs, and counted by their content, combined before the shuffle: one
   that is there twice is repeated in all its windows. Of each content, one goes to the shard of its
   longer minimizer and is searched like the others. Only where more than HOT different contents share even
   that are their windows dealt by their own hash and counted.
4. The intervals of repeated windows come back to their text, which is cut once.

Copies of a text are handled once: copies of WIDTH words or more are removed whole. Null
text: no words. Null ids and repeated rows keep a row of their own. Texts shorter than a
window lose nothing. An empty table gives no rows; there are no ties, as every place of a repeated window goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import kept, table
from loomwork.llm.fmindex import FmIndex
from loomwork.llm.text import gram_mask, grams, mix, slices, words

WIDTH, GRAM, LONGER, HOT, SHARD_WORDS = 35, 12, 24, 1000, 250_000
MOST_MASKS = 1_000_000
PLACE = 28  # bits for a place within a slice, in the order of minimizers


def segments(h: np.ndarray, first: np.ndarray, width: int, gram: int):
    """Of each segment: first window (a word's index), number of windows, minimizer, text."""
    none = np.zeros(0, np.int64)
    g = grams(h, gram)
    span = width - gram + 1
    if len(g) < span:
        return none, none, none.view(np.uint64), none
    low = np.uint64((1 << PLACE) - 1)
    key = (g & ~low) | (np.arange(len(g), dtype=np.uint64) & low)
    least, size = key, 1
    while 2 * size <= span:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < span:
        least = np.minimum(least[: len(key) - span + 1], least[span - size :])
    windows = np.flatnonzero(gram_mask(first, width))
    if not len(windows):
        return none, none, none.view(np.uint64), none
    place = (least[windows] & low).astype(np.int64)
    doc = np.searchsorted(first, windows, "right") - 1
    new = np.ones(len(windows), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return windows[at], np.diff(np.append(at, len(windows))), g[place[at]], doc[at]


def _places(width: int, gram: int):
    """(text_key, minimizer, at, again): at = word * 256 + windows; again: twice in this text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = words(b.column("text"))
            start, count, m, doc = segments(w.hashes(), w.first, width, gram)
            order = np.lexsort((m, doc))
            same = np.zeros(len(m), bool)
            if len(m) > 1:
                equal = (m[order][1:] == m[order][:-1]) & (doc[order][1:] == doc[order][:-1])
                same[order[1:][equal]] = same[order[:-1][equal]] = True
            yield pa.RecordBatch.from_arrays([b.column("text_key").take(pa.array(doc)), pa.array(m.view(np.int64)), pa.array((start - w.first[doc]) * 256 + count), pa.array(same)], ["text_key", "minimizer", "at", "again"])

    return run


def _flat(column: pa.Array, field: str) -> tuple[np.ndarray, np.ndarray]:
    """A field of list<struct> rows end to end, and the row of each value."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().field(field).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)


def _contents(width: int, longer: int):
    """Live segments: the words for their shard (hot = false), or their parts by longer minimizers, with a hash
    of the content as key and one of each window (hot = true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = words(b.column("text"))
            h = w.hashes()
            at, row = _flat(b.column("live"), "at")
            minimizer, hot = _flat(b.column("live"), "minimizer")[0], _flat(b.column("live"), "hot")[0].astype(bool)
            start, count = w.first[row] + at // 256, at % 256
            raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            words_of = lambda starts, counts: [raw[x : x + n + width - 1].tobytes() for x, n in zip(starts.tolist(), counts.tolist(), strict=True)]  # noqa: B023, E731
            cold = np.flatnonzero(~hot)
            hot = np.flatnonzero(hot)
            hot = hot[np.argsort(start[hot])]
            # the windows of hot segments, parted where they or the longer minimizers change
            n = count[hot]
            begin = np.repeat(start[hot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            first, _, second, _ = segments(h, w.first, width, longer)
            of, part = np.repeat(np.arange(len(hot)), n), np.searchsorted(first, begin, "right") - 1
            new = np.ones(len(begin), bool)
            new[1:] = (of[1:] != of[:-1]) | (part[1:] != part[:-1])
            new = np.flatnonzero(new)
            n, sub, home = np.diff(np.append(new, len(begin))), second[part[new]], row[hot[of[new]]]
            step = np.arange(len(begin)) - np.repeat(new, n)
            value = h[begin]
            for j in range(1, width if len(begin) else 1):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + h[begin + j])
            total = np.append(np.uint64(0), np.cumsum(mix(value + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64))
            ends = np.cumsum(n)
            whole = mix(total[ends] - total[ends - n] + n.astype(np.uint64))
            windows = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(len(cold) + 1), ends]).astype(np.int32)), pa.array(value.view(np.int64)))
            columns = {
                "text_key": b.column("text_key").take(pa.array(np.concatenate([row[cold], home]))),
                "key": np.concatenate([minimizer[cold], whole.view(np.int64)]),
                "at": np.concatenate([at[cold], (begin[new] - w.first[home]) * 256 + n]),
                "hot": np.arange(len(cold) + len(new)) >= len(cold),
                "sub": np.concatenate([minimizer[cold], sub.view(np.int64)]),
                "words": pa.array(words_of(start[cold], count[cold]) + words_of(begin[new], n), pa.binary()),
                "windows": windows,
            }
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns.values()], list(columns))

    return run


def _search(width: int):
    """One shard: (text_key, at, mask) of the segments with repeated windows, a bit for each window."""

    def run(t: pa.Table) -> pa.Table:
        at = t["at"].to_numpy()
        raw = t["words"].to_pylist()
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(x, len(number)) for x in raw), np.int64, len(raw))
        times = np.bincount(which, minlength=len(number))
        size = np.array([len(x) // 5 for x in number])
        five = np.frombuffer(b"".join(number), np.uint8).reshape(-1, 5).astype(np.int64)
        symbols, dense = np.unique(five @ (1 << 8 * np.arange(5)), return_inverse=True)
        # a separator of its own behind each segment
        begin = np.cumsum(size + 1) - (size + 1)
        text = np.empty(int((size + 1).sum()), np.int64)
        ends = begin + size
        body = np.ones(len(text), bool)
        body[ends] = False
        text[body], text[ends] = dense, len(symbols) + np.arange(len(size))
        windows = size - width + 1
        mask = np.where(times > 1, (np.int64(1) << windows) - 1, 0)
        alone = np.flatnonzero(times == 1)
        if len(alone) and len(size) > 1:
            index = FmIndex(text, len(symbols) + len(size))
            mask[alone] = index.repeated(text, begin[alone], windows[alone], width)
        mask = mask[which]
        some = np.flatnonzero(mask)
        return pa.table({"text_key": t["text_key"].take(pa.array(some)), "at": at[some], "mask": mask[some]})

    return run


def _of_hot(segments: DataFrame, width: int, hot: int) -> DataFrame:
    """(text_key, at, mask) of segments(text_key, key, at, sub, words, windows) with repeated windows."""
    bits = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    contents = segments.groupBy("key").agg(F.count("*").alias("n"), F.first(F.struct("sub", "words", "windows")).alias("c"))
    contents = kept(contents.select("key", "n", "c.*"), "contents")
    sizes = kept(contents.groupBy("sub").agg(F.count("*").alias("m"), F.sum(F.octet_length("words") / 5).alias("total")), "subs")
    total = sizes.where(f"m between 2 and {hot}").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    several = contents.join(sizes.where("m > 1").select("sub", "m"), "sub")
    least = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # so that few words are still spread over all tasks
    shard = F.pmod(F.xxhash64("sub"), F.lit(max(least, round(total / SHARD_WORDS)))).cast("int").alias("shard")
    searched = several.where(F.col("m") <= hot).select(shard, F.col("key").cast("string").cast("binary").alias("text_key"), F.lit(0).cast("long").alias("at"), "words")
    searched = searched.groupBy("shard").applyInArrow(_search(width), "text_key binary, at long, mask long").select(F.col("text_key").cast("string").cast("long").alias("key"), "mask")
    each = several.where(F.col("m") > hot).select("key", F.posexplode("windows").alias("place", "window"))
    twice = each.groupBy("window").agg(F.count("*").alias("times")).where("times > 1").select("window")
    counted = each.join(twice, "window").groupBy("key").agg(F.bit_or(bits(F.col("place"))).alias("mask"))
    copied = contents.where("n > 1").select("key", (bits(F.size("windows")) - 1).alias("mask"))
    masks = kept(copied.union(searched).union(counted).groupBy("key").agg(F.bit_or("mask").alias("mask")), "masks")
    # a content may have any number of segments, so these aren't dealt by it: masks are of a fixed size and counted
    few = masks.count() <= MOST_MASKS
    return segments.join(F.broadcast(masks) if few else masks, "key").select("text_key", "at", "mask")


def _cut(width: int):
    """(text_key, n_words, n_removed, kept_sha256) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = words(b.column("text"))
            n, copies = w.counts, b.column("copies").to_numpy()
            steps = np.zeros(len(w.starts) + 1, np.int64)
            at, row = _flat(b.column("found"), "at")
            mask = _flat(b.column("found"), "mask")[0]
            for bit in range(64):
                has = np.flatnonzero(mask >> bit & 1) if len(mask) else mask
                if len(has):
                    x = w.first[row[has]] + at[has] // 256 + bit
                    np.add.at(steps, x, 1)
                    np.add.at(steps, x + width, -1)
            gone = np.cumsum(steps)[:-1] > 0
            gone |= np.repeat((copies > 1) & (n >= width), n)
            stay = np.flatnonzero(~gone)
            size = w.ends[stay] - w.starts[stay]
            to = np.cumsum(size + 1) - (size + 1)
            out = np.full(int((size + 1).sum()), 32, np.uint8)
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(to, size) + step] = w.data[np.repeat(w.starts[stay], size) + step]
            ends = np.append(to, len(out))[np.searchsorted(stay, w.first)]
            sha = [hashlib.sha256(out[x : max(x, y - 1)]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
            yield pa.RecordBatch.from_arrays([b.column("text_key"), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(sha, pa.string())], ["text_key", "n_words", "n_removed", "kept_sha256"])

    return run


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, longer: int = LONGER, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of documents(doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.unhex(F.md5("text")))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(8, round(size / 6 / SHARD_WORDS))

    places = rows.select("text_key", "text").mapInArrow(_places(width, gram), "text_key binary, minimizer long, at long, again boolean")
    counts = places.groupBy("minimizer").agg(F.min("text_key").alias("a"), F.max("text_key").alias("z"), F.max("again").alias("again"), F.count("*").alias("n"))
    counts = counts.where((F.col("a") != F.col("z")) | F.col("again")).select("minimizer", (F.col("n") > hot).alias("hot"))
    # as a table of its own, so that both sides of the join are plain shuffles and a hot minimizer's can be split
    counts = kept(counts, "minimizers")
    live = places.join(counts, "minimizer").groupBy("text_key").agg(F.collect_set(F.struct("at", "minimizer", "hot")).alias("live"))
    live = kept(live, "live")

    # both uses of the texts share one shuffle
    texts = rows.groupBy("text_key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    contents = texts.join(live, "text_key").select("text_key", "text", "live").mapInArrow(_contents(width, longer), "text_key binary, key long, at long, hot boolean, sub long, words binary, windows array<long>")
    cold = contents.where("not hot").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    found = cold.select("shard", "text_key", "at", "words").groupBy("shard").applyInArrow(_search(width), "text_key binary, at long, mask long")
    if live.where(F.exists("live", lambda x: x["hot"])).limit(1).count():
        found = found.union(_of_hot(kept(contents.where("hot").select("text_key", "key", "at", "sub", "words", "windows"), "hot"), width, hot))
    found = found.groupBy("text_key").agg(F.collect_list(F.struct("at", "mask")).alias("found"))
    results = texts.join(found, "text_key", "left").select("text_key", "text", "copies", "found").mapInArrow(_cut(width), "text_key binary, n_words long, n_removed long, kept_sha256 string")
    results = kept(results, "cut")
    return rows.select("doc_id", "text_key").join(results, "text_key").select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
with texts as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select r, i, md5(array_to_string(w[i:i + {WIDTH - 1}], ' ')) as h
  from (select r, w, unnest(range(1, len(w) - {WIDTH - 2})) as i from texts where len(w) >= {WIDTH})),
twice as (select h from windows group by h having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + {WIDTH})) as p from windows join twice using (h)),
removed as (select r, count(*) as n from gone group by r),
places as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from texts),
left_over as (select r, string_agg(word, ' ' order by p) as t from places anti join gone using (r, p) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from texts left join removed using (r) left join left_over using (r)
"""
