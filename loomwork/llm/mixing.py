"""Mixing sources to target weights, in DataFrame operations alone.

Temperature mixing: a source with the share p of all tokens gets a weight in proportion to
p ** alpha. alpha = 1 keeps the shares, alpha = 0 makes all sources equal. Lower values
raise the entropy of the weights, and repeat small sources more. `exponent` bisects alpha
(64 parts to a round, one small aggregation each) until the weights meet the target: the
least alpha whose largest repetition is within `repetition_limit`, or the largest alpha whose
entropy reaches `entropy` (nats).

With a budget of B tokens, a source of T tokens passes weight * B / T times. Without one, B
is the least budget for which no source passes less than once, so nothing is lost.

Realisation: each source is cut into blocks of about `block_docs` documents by a hash of the
id, so that no source, however large, is ordered in one task. Each pass permutes each block
by a hash of its own. Whole passes take every document. The broken pass takes a block's
documents in its permutation while the middle of the document lies within the block's part
of the budget; so a block is off its budget by half a document at most.

Nulls: a null source is the source of the empty name; a null text has no tokens; rows of a null
id are told apart by their place in the input, so they spread over the blocks. Documents without tokens
come with each whole pass. A source without any tokens passes once; one whose rate rounds to 0, or a budget
of 0, gives no row. Repeated rows are documents of their own; rows of one id have the same key, and
the one with fewer tokens, then the lesser hash of its text comes first. An empty table gives an
empty table. Only the counts of sources, never documents, are joined to all rows;
these are broadcast up to MOST_SOURCES sources and shuffled beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm.common import kept, table

MOST_SOURCES = 100_000
REPETITIONS, BLOCK_DOCS, SEED = 2.0, 1024, "mix-1"


def tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def exponent(stats: DataFrame, repetition_limit: float | None = REPETITIONS, entropy: float | None = None, budget: float | None = None, rounds: int = 5) -> float:
    """alpha of stats(source, total), to about 64 ** -rounds."""
    whole = stats.agg(F.sum("total").cast("double")).first()[0] or 0.0
    p = stats.where("total > 0").select((F.col("total") / F.lit(max(whole, 1.0))).alias("p"))
    low, high = 0.0, 1.0
    for _ in range(rounds):
        step = (high - low) / 64
        grid = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(64)))).withColumn("a", F.lit(low) + F.col("i") * step)
        w = F.pow("p", F.col("a"))
        one = grid.groupBy("i").agg(F.sum(w).alias("z"), F.sum(w * F.col("a") * F.log("p")).alias("u"), F.max(w / F.col("p")).alias("most"), F.min(w / F.col("p")).alias("least"))
        if entropy is None:
            times = F.col("most") / F.col("z") * F.lit(budget / max(whole, 1.0)) if budget is not None else F.col("most") / F.col("least")
            good = one.where(times <= F.lit(repetition_limit) * (1 + 1e-12)).agg(F.min("i")).first()[0]
            good = 64 if good is None else good  # the limit can't be met: the shares stay
            low, high = low + max(0, good - 1) * step, low + good * step
        else:
            good = one.where(F.log("z") - F.col("u") / F.col("z") >= entropy).agg(F.max("i")).first()[0]
            good = 0 if good is None else good  # can't be met: equal weights
            low, high = low + good * step, low + min(64, good + 1) * step
    return round(high if entropy is None else low, 8)


def rates(units: DataFrame, repetition_limit: float | None = REPETITIONS, entropy: float | None = None, budget: float | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(source, total, docs, weight, rate, blocks) of the sources of units(source, tokens)."""
    stats = kept(units.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("docs")), "sources")
    alpha = exponent(stats, repetition_limit, entropy, budget)
    whole = float(stats.agg(F.sum("total")).first()[0] or 1)
    power = F.when(F.col("total") > 0, F.pow(F.col("total") / F.lit(whole), F.lit(alpha))).otherwise(0.0)
    sums = stats.agg(F.sum(power).alias("z"), F.max(F.when(F.col("total") > 0, F.col("total") / power)).alias("need")).first()
    z, scale = float(sums["z"] or 1), float(sums["need"] or 0)
    if budget is not None:
        scale = budget / z
    rate = F.when(F.col("total") > 0, power * F.lit(scale) / F.col("total")).otherwise(1.0)
    return stats.select("source", "total", "docs", (power / F.lit(z)).alias("weight"), F.round(rate, 9).alias("rate"), F.greatest(F.lit(1), F.floor(F.col("docs") / F.lit(block_docs))).cast("long").alias("blocks"))


def number(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


def named(doc_id: str = "doc_id") -> Column:
    """A row's name for the hashes: its id, or where it has none its place in the input."""
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("/"), F.monotonically_increasing_id().cast("string")))


def order_key(seed: str, each: Column, name: Column) -> Column:
    return F.md5(F.concat_ws("/", F.lit(seed), each, name))


def in_mixed_order(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of a mixture with a column `mixed_order`: sorted by it, all sources and passes interleave.

    A keyed permutation of all rows, by the hash of a row's name and its place in the table, so that the
    copies of a document lie apart. It stays the same as long as the table is read from the same files.
    """
    return docs.withColumn("mixed_order", order_key(seed, F.monotonically_increasing_id().cast("string"), named()))


def drawn(units: DataFrame, sources: DataFrame, seed: str = SEED) -> DataFrame:
    """The units, one row for each pass that takes them: with weight, block, pass and position in the block's permutation."""
    small = sources.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    each = units.join(F.broadcast(sources) if small else sources, "source")
    each = each.where("rate > 0").withColumn("block", number(F.concat(F.lit(f"{seed}/"), F.col("name"))) % F.col("blocks"))
    each = each.withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil("rate").cast("int") - 1)))
    each = each.withColumn("key", order_key(seed, F.col("pass").cast("string"), F.col("name"))).repartition("source", "block")
    order = Window.partitionBy("source", "block", "pass").orderBy("key", "tokens", "tie")
    block = Window.partitionBy("source", "block", "pass")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.col("rate") - F.col("pass")
    each = each.withColumn("takes", (part >= 1) | ((F.col("tokens") > 0) & (before + F.col("tokens") / 2 <= part * F.sum("tokens").over(block))))
    return each.withColumn("position", F.row_number().over(order).cast("long")).where("takes").drop("takes", "key", "name", "tie")


def mixed(docs: DataFrame, repetition_limit: float | None = REPETITIONS, entropy: float | None = None, budget: float | None = None, block_docs: int = BLOCK_DOCS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, weight, block, pass, position, tokens): which document each pass takes, where."""
    units = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), tokens(F.col("text")).alias("tokens"), named().alias("name"), F.xxhash64("text").alias("tie"))
    units = kept(units, "units")
    sources = kept(rates(units, repetition_limit, entropy, budget, block_docs), "rates")
    return drawn(units, sources, seed).select("doc_id", "source", "weight", "block", "pass", "position", "tokens")


def mixture(docs: DataFrame, repetition_limit: float | None = REPETITIONS, entropy: float | None = None, budget: float | None = None, block_docs: int = BLOCK_DOCS, seed: str = SEED) -> DataFrame:
    """The mixed rows themselves, one for each pass that takes them, with all their columns."""
    units = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), tokens(F.col("text")).alias("tokens"), named().alias("name"), F.xxhash64("text").alias("tie"), F.struct("*").alias("row"))
    sources = kept(rates(units.drop("row"), repetition_limit, entropy, budget, block_docs), "rates")
    return drawn(units, sources, seed).select("row.*")


def op3_mixed_sources(spark, sf_dir: str) -> DataFrame:
    m = mixed(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "source", F.round("weight", 6).alias("weight"), F.col("block").cast("long").alias("block"), F.col("pass").cast("int").alias("pass"), "position", "tokens")


OP3_SQL = rf"""
with recursive units as (
  select doc_id, coalesce(source, '') as source,
         cast(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) as bigint) as tokens
  from documents),
stats as (select source, cast(sum(tokens) as double) as total, count(*) as docs from units group by source),
p as (select source, total, docs, total / (select sum(total) from stats) as p from stats),
bounds as (select max(p) as top, min(p) as bottom from p where p > 0),
bisect(n, lo, hi) as (
  select 0, cast(0 as double), cast(1 as double)
  union all
  select n + 1,
         case when pow(top / bottom, 1 - (lo + hi) / 2) <= {REPETITIONS} then lo else (lo + hi) / 2 end,
         case when pow(top / bottom, 1 - (lo + hi) / 2) <= {REPETITIONS} then (lo + hi) / 2 else hi end
  from bisect, bounds where n < 30),
alpha as (select case when (select top = bottom from bounds) then 0 else round(hi, 8) end as a from bisect where n = 30),
powers as (select source, total, docs, case when p > 0 then pow(p, (select a from alpha)) else 0 end as w from p),
rates as (
  select source, docs, w / (select sum(w) from powers) as weight,
         case when total > 0 then round(w * (select max(total / w) from powers where w > 0) / total, 9) else 1 end as rate,
         greatest(1, docs // {BLOCK_DOCS}) as blocks
  from powers),
each as (
  select doc_id, source, tokens, weight, rate,
         cast('0x' || substr(md5('{SEED}/' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) % blocks as block,
         unnest(range(0, cast(ceil(rate) as bigint))) as pass
  from units join rates using (source)),
ordered as (
  select *, md5('{SEED}/' || pass || '/' || coalesce(cast(doc_id as varchar), '')) as key from each),
placed as (
  select *, coalesce(sum(tokens) over (partition by source, block, pass order by key, tokens rows between unbounded preceding and 1 preceding), 0) as before,
         sum(tokens) over (partition by source, block, pass) as whole,
         row_number() over (partition by source, block, pass order by key, tokens) as position
  from ordered)
select doc_id, source, round(weight, 6) as weight, cast(block as bigint) as block, cast(pass as integer) as pass, position, tokens
from placed where rate - pass >= 1 or (tokens > 0 and before + tokens / 2 <= (rate - pass) * whole)
"""
