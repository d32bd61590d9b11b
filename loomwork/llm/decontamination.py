"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations alone.

A document is contaminated by an item if some window with as many words as the item has a
weighted Jaccard similarity of five-word shingles with it of 0.8 or more. Words are runs
of letters and digits, lower-cased. A shingle weighs its count times its letters. At its end a
text has windows of fewer words.

1. Windows. A window of similarity 0.8 or more shares at least 0.8 of the item's weight, so the shingles of items of its size
   that it holds weigh at least 0.8 of the lightest such item. Every window that may is taken; what a benchmark's items have
   in common, such as their first words, makes none.
2. Fingerprints. The signs of 128 sums over shingle hashes, each times the square root of its
   weight, for items and windows. With these roots the cosine is at least 8/9 at similarity 0.8,
   whatever the weights.
3. Multi-index. Two fingerprints within RADIUS bits differ by NEAR bits at most in one of BLOCKS
   blocks at least, as RADIUS < BLOCKS * (NEAR + 1). Items are listed under all values so near to
   theirs in each block; joining on (words, block, value) finds every item within the radius.
   Signs follow the cosine only while no shingle dominates the sums: a window or item of which one
   has more than HEAVY of the weight is paired with all it shares a shingle with, without a radius.
4. Verification. Exact weighted Jaccard similarity, on the words themselves.

RADIUS is 2.5 standard deviations beyond the expected distance at a cosine of 8/9 (19.4 bits):
a window of exactly 0.8 is beyond it about once in 160, one of 0.85 once in 50,000.

Work grows with the words of all texts, and for each place of an item's shingle with the square of
the item's words; not with the square of a text. Copies of a text are handled once. What is made of
the items is broadcast only up to MOST_SHINGLES rows, counted first, and shuffled beyond. Items and texts
of fewer than five words have no shingles and match nothing; null texts likewise. A null
item_id or doc_id is kept as such; repeated items of one id give one row. Rows of equal texts all
get their text's rows. An empty table on either side gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import kept, table

WIDTH, THRESHOLD, HEAVY = 5, 0.8, 1 / 8
RADIUS, NEAR = 29, 2
#: (first bit, bits) of the blocks of each 64-bit half of a fingerprint.
HALF = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
BLOCKS = 2 * len(HALF)
MOST_SHINGLES, MOST_WINDOWS = 500_000, 500_000
STEP = 1 << 30


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def each_shingle(w: Column, of) -> Column:
    """of(words of the shingle) at each word that has four behind it; null if there is none."""
    return F.when(F.size(w) >= WIDTH, F.transform(F.sequence(F.lit(1), F.size(w) - WIDTH + 1), lambda i: of(F.slice(w, i, WIDTH))))


def shingle_hashes(w: Column) -> Column:
    return each_shingle(w, lambda x: F.xxhash64(x))


def shingle_places(w: Column) -> Column:
    """Hash and letters of each."""
    return each_shingle(w, lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(F.array_join(x, "")).cast("long").alias("letters")))


def shingle_names(w: Column) -> Column:
    return each_shingle(w, lambda x: F.array_join(x, " "))


def fingerprints(places: DataFrame, *by: str) -> DataFrame:
    """(*by, print_a, print_b, uneven) of the groups of places(*by, h, letters): each bit is the sign of its sum.

    The sums of bit b of both halves are the two halves of one number. A place of a shingle adds to its weight.
    """
    once = places.groupBy(*by, "h").agg(F.sum("letters").alias("weight"))
    once = once.select(*by, "h", "weight", F.round(F.sqrt("weight") * 64).cast("long").alias("root"), F.xxhash64("h").alias("other"))
    sums = [F.expr(f"sum(getbit(h, {b}) * root + getbit(other, {b}) * root * {1 << 32}) as s{b}") for b in range(64)]
    summed = once.groupBy(*by).agg(*sums, F.sum("root").alias("whole"), (F.max("weight") > HEAVY * F.sum("weight")).alias("uneven"))
    summed = summed.select(*by, "uneven", "whole", F.expr(f"array({', '.join(f's{b}' for b in range(64))})").alias("sums"))
    signs = lambda half: F.expr(f"aggregate(transform(sums, (s, b) -> if(2 * ({half}) > whole, shiftleft(1L, b), 0L)), 0L, (x, y) -> x | y)")
    return summed.select(*by, signs(f"s & {(1 << 32) - 1}").alias("print_a"), signs("shiftrightunsigned(s, 32)").alias("print_b"), "uneven")


def blocks(a: Column, b: Column) -> Column:
    """(block, bits) of a fingerprint."""
    cut = lambda x, at, n: F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << n) - 1).cast("long")).cast("int")
    parts = [(x, at, n) for x in (a, b) for at, n in HALF]
    return F.explode(F.array(*(F.struct(F.lit(i).alias("block"), cut(x, at, n).alias("bits"), F.lit(n).alias("size")) for i, (x, at, n) in enumerate(parts))))


def near_blocks(prints: DataFrame, *keep: str) -> DataFrame:
    """(*keep, block, bits): each block of print_a and print_b under all values that differ by NEAR bits at most."""
    change = F.explode(F.filter(F.sequence(F.lit(0), F.lit((1 << max(n for _, n in HALF)) - 1)), lambda x: F.bit_count(x) <= NEAR))
    changed = prints.select(*keep, blocks(F.col("print_a"), F.col("print_b")).alias("part")).select(*keep, "part.*", change.alias("change"))
    return changed.where(F.expr("change < shiftleft(1, size)")).select(*keep, "block", F.col("bits").bitwiseXOR(F.col("change")).alias("bits"))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))


class Items:
    """What is made of the benchmark."""

    def __init__(self, benchmark: DataFrame):
        items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= WIDTH)
        items = kept(items.select(F.xxhash64("item_id", "w").alias("item_key"), "item_id", F.size("w").alias("n_words"), shingle_places(F.col("w")).alias("p"), shingle_names(F.col("w")).alias("names")).dropDuplicates(["item_key"]), "items")
        places = items.select("item_key", "n_words", F.explode("p").alias("p")).select("item_key", "n_words", "p.*")
        weights = items.select("item_key", F.explode("names").alias("name")).groupBy("item_key", "name").agg((F.count("*") * (F.length("name") - (WIDTH - 1))).alias("item_weight"))
        #: (item_key, name, item_weight)
        self.weights = kept(weights, "weights")
        whole = self.weights.groupBy("item_key").agg(F.sum("item_weight").alias("item_whole"))
        #: (item_key, item_id, item_whole)
        self.whole = kept(items.select("item_key", "item_id").join(whole, "item_key"), "whole")
        #: (item_key, n_words, item_a, item_b, item_uneven)
        prints = kept(fingerprints(places, "item_key", "n_words"), "item-prints")
        self.prints = prints.select("item_key", "n_words", F.col("print_a").alias("item_a"), F.col("print_b").alias("item_b"), F.col("uneven").alias("item_uneven"))
        #: (item_key, n_words, item_a, item_b, block, bits)
        self.index = kept(near_blocks(prints.withColumns({"item_a": F.col("print_a"), "item_b": F.col("print_b")}), "item_key", "n_words", "item_a", "item_b"), "index")
        #: (item_key, n_words, h, letters, least): with the weight of the lightest item of the size
        least = self.whole.join(items.select("item_key", "n_words"), "item_key").groupBy("n_words").agg(F.min("item_whole").alias("least"))
        self.hashes = kept(places.select("item_key", "n_words", "h", "letters").distinct().join(least, "n_words"), "hashes")
        self.few = self.index.count() <= MOST_SHINGLES and self.hashes.count() <= MOST_SHINGLES

    def small(self, df: DataFrame) -> DataFrame:
        """Of a table of no more rows than those counted."""
        return F.broadcast(df) if self.few else df


def windowed(matched: DataFrame, wanted: str, column: str, *fields: str) -> DataFrame:
    """(text_key, *fields, column) of wanted(n_words, start, ...), an array of windows for each text: the values in them, a row each.

    A text's windows are cut before they become rows, so that none of these holds the whole text.
    """
    cut = lambda x: F.struct(*(x[f].alias(f) for f in fields), F.slice(column, x["start"] + 1, x["n_words"] - (WIDTH - 1)).alias("values"))
    each = matched.select("text_key", F.explode(F.transform(wanted, cut)).alias("window")).select("text_key", "window.*")
    return each.select("text_key", *fields, F.explode("values").alias("value"))


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key")


def matched_texts(docs: DataFrame, items: Items) -> DataFrame:
    """(text_key, windows(n_words, start), p, names) of each text with a shingle of an item, written."""
    rows = docs.select(text_key(), "text")
    shingled = rows.select("text_key", words(F.col("text")).alias("w")).select("text_key", F.posexplode(shingle_hashes(F.col("w"))).alias("place", "h"))
    found = shingled.join(items.small(items.hashes.select("h", "n_words", "letters", "least").distinct()), "h").select("text_key", "n_words", "place", "letters", "least").distinct()
    # the starts of the windows that hold this place but not the one before
    along = Window.partitionBy("text_key", "n_words").orderBy("place")
    first = F.greatest(F.lit(0), F.col("place") - F.col("n_words") + WIDTH, F.coalesce(F.lag("place").over(along) + 1, F.lit(0)))
    # of these the last one holds most: all such places of the item's length from here on, in steps of one length, or at most one place more
    steps = F.floor(F.col("place").cast("long") * STEP / F.greatest(F.col("n_words") - WIDTH, F.lit(1))).cast("long")
    found = found.withColumn("steps", steps).withColumn("first", first)
    held = F.sum("letters").over(Window.partitionBy("text_key", "n_words").orderBy("steps").rangeBetween(0, STEP + 1))
    found = found.withColumn("held", held).where(F.col("held") >= (THRESHOLD - 1e-6) * F.col("least"))
    ranges = found.select("text_key", F.struct("n_words", "first", F.col("place").alias("last")).alias("range"))
    ranges = kept(ranges.groupBy("text_key").agg(F.collect_list("range").alias("ranges")), "ranges")
    # each entry is of fixed size, so their number bounds what is broadcast
    light = (ranges.agg(F.sum(F.size("ranges"))).first()[0] or 0) <= MOST_WINDOWS
    texts = rows.join(F.broadcast(ranges) if light else ranges, "text_key").groupBy("text_key").agg(F.first("text").alias("text"), F.first("ranges").alias("ranges"))
    starts = lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda s: F.struct(r["n_words"].alias("n_words"), s.alias("start")))
    texts = texts.select("text_key", words(F.col("text")).alias("w"), F.flatten(F.transform("ranges", starts)).alias("windows"))
    return kept(texts.select("text_key", "windows", shingle_places(F.col("w")).alias("p"), shingle_names(F.col("w")).alias("names")), "matched")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(text_key, item_id, start, n_words, hamming, similarity): the best window of each text and item."""
    items = Items(benchmark)
    matched = matched_texts(docs, items)
    # a text's windows stay in its partition, so that no sums are shuffled
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = windowed(matched.select("text_key", "windows", "p").repartition(parts, "text_key"), "windows", "p", "n_words", "start")
    prints = kept(fingerprints(places.select("text_key", "n_words", "start", "value.*"), "text_key", "n_words", "start"), "prints")

    near = candidates(prints, items)
    # of those for which the radius may be too small: all pairs that share a shingle
    odd = items.small(items.prints.where("item_uneven").select("n_words").distinct().withColumn("odd", F.lit(True)))
    heavy = prints.join(odd, "n_words", "left").where(F.col("uneven") | F.col("odd"))
    heavy = heavy.groupBy("text_key").agg(F.collect_list(F.struct("n_words", "start", "uneven", "print_a", "print_b")).alias("heavy"))
    heavy = windowed(matched.select("text_key", "p").join(heavy, "text_key"), "heavy", "p", "n_words", "start", "uneven", "print_a", "print_b")
    heavy = heavy.withColumn("h", F.col("value.h")).join(items.small(items.hashes.join(items.prints, ["item_key", "n_words"])), ["h", "n_words"]).where(F.col("uneven") | F.col("item_uneven"))
    heavy = heavy.select("text_key", "n_words", "start", "item_key", distance(("print_a", "print_b"), ("item_a", "item_b")).alias("hamming"))

    pairs = near.union(heavy).distinct().groupBy("text_key").agg(F.collect_list(F.struct("n_words", "start", "item_key", "hamming")).alias("pairs"))
    by = ["text_key", "n_words", "start", "item_key", "hamming"]
    own = windowed(matched.select("text_key", "names").join(pairs, "text_key"), "pairs", "names", *by[1:]).groupBy(*by, F.col("value").alias("name")).agg(F.count("*").alias("n"))
    own = own.withColumn("weight", F.col("n") * (F.length("name") - (WIDTH - 1))).join(items.small(items.weights), ["item_key", "name"], "left")
    sums = own.groupBy(*by).agg(F.sum("weight").alias("own"), F.sum(F.least("weight", F.coalesce("item_weight", F.lit(0)))).alias("both")).join(items.small(items.whole), "item_key")
    sums = sums.withColumn("similarity", F.col("both") / (F.col("own") + F.col("item_whole") - F.col("both"))).where(F.col("similarity") >= THRESHOLD - 1e-9)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("hamming")).alias("h"), "n_words")).alias("b")
    return sums.groupBy("text_key", "item_id").agg(best).select("text_key", "item_id", (-F.col("b.s")).alias("start"), F.col("b.n_words").alias("n_words"), (-F.col("b.h")).alias("hamming"), F.col("b.similarity").alias("similarity"))


def candidates(prints: DataFrame, items: Items) -> DataFrame:
    """(text_key, n_words, start, item_key, hamming) of all windows and items of a size within the radius."""
    mine = prints.select("text_key", "n_words", "start", "print_a", "print_b", blocks(F.col("print_a"), F.col("print_b")).alias("part")).select("text_key", "n_words", "start", "print_a", "print_b", "part.block", "part.bits")
    near = mine.join(items.small(items.index), ["n_words", "block", "bits"]).withColumn("hamming", distance(("print_a", "print_b"), ("item_a", "item_b")))
    return near.where(F.col("hamming") <= RADIUS).select("text_key", "n_words", "start", "item_key", "hamming")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, hamming, similarity) of every contaminated row."""
    found = kept(leaks(docs, benchmark), "leaks")
    rows = docs.select("doc_id", text_key())
    return rows.join(found, "text_key").drop("text_key")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that no item contaminates, with all their columns."""
    found = kept(leaks(docs, benchmark).select("text_key").distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("row"), text_key())
    return rows.join(found, "text_key", "left_anti").select("row.*")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "start", "n_words", F.round("similarity", 9).alias("similarity"))


#: By brute force: every window that holds a shingle of the item. Fingerprints only speed the search up.
OP7_SQL = rf"""
with texts as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from documents),
items as (
  select row_number() over () as k, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from benchmark),
item_places as (select k, i, array_to_string(w[i:i + {WIDTH - 1}], ' ') as s from (select k, w, unnest(range(1, len(w) - {WIDTH - 2})) as i from items where len(w) >= {WIDTH})),
text_places as (select r, i, array_to_string(w[i:i + {WIDTH - 1}], ' ') as s from (select r, w, unnest(range(1, len(w) - {WIDTH - 2})) as i from texts where len(w) >= {WIDTH})),
item_weights as (select k, s, count(*) * (length(s) - {WIDTH - 1}) as w from item_places group by k, s),
wholes as (select k, sum(w) as whole from item_weights group by k),
starts as (
  select distinct r, k, unnest(range(greatest(1, t.i - len(i.w) + {WIDTH}), t.i + 1)) as a
  from (select distinct t.r, t.i, p.k from text_places t join item_places p using (s)) t join items i using (k)),
window_weights as (
  select st.r, st.k, st.a, t.s, count(*) * (length(t.s) - {WIDTH - 1}) as w
  from starts st join items i using (k) join text_places t on t.r = st.r and t.i between st.a and st.a + len(i.w) - {WIDTH}
  group by st.r, st.k, st.a, t.s),
scores as (
  select v.r, v.k, v.a, sum(v.w) as own, sum(least(v.w, coalesce(m.w, 0))) as shared
  from window_weights v left join item_weights m on m.k = v.k and m.s = v.s group by v.r, v.k, v.a),
hits as (select r, k, a, shared / (own + whole - shared) as similarity from scores join wholes using (k)),
best as (
  select r, i.item_id, a, len(i.w) as n, similarity from hits join items i using (k) where similarity >= {THRESHOLD} - 1e-9
  qualify row_number() over (partition by r, i.item_id order by similarity desc, a) = 1)
select doc_id, item_id, cast(a - 1 as integer) as start, cast(n as integer) as n_words, round(similarity, 9) as similarity
from best join texts using (r)
"""
