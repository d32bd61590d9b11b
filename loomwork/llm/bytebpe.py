"""Byte-level BPE in Spark's higher-order functions: encoding by ranked merges, decoding by concatenation.

A text is cut into pieces by the tokenizer's pattern. A piece's bytes are folded: as long as two neighbours stand
together in the rank map, the pair of the least rank, the leftmost of equals, becomes one. The rank map is a literal of
the plan, an array of small maps by hash so that a lookup doesn't walk the vocabulary; it has the vocabulary's size
whatever the input. Ids become bytes again by an array of the vocabulary's byte strings, put together in order.

Distinct pieces are counted over all texts, and those seen most often (`MOST` at most, the bound of what a plan carries)
are folded once. A piece outside of these is folded where it stands. Which pieces are kept changes the time only.

Pieces of up to `SHORT` bytes merge one pair at a time. In a longer one each step merges all places of the least rank
from left to right, which gives the same: if a merge brings up a still lower rank, the step is
taken back to its first place. So a run of one letter a million bytes long takes about twenty steps.

The tokenizer's library and Java know different versions of Unicode. The character classes of the pattern are taken from the
library, and written out where Java's own differ.

Nulls, repeats and the like: a null text is an empty one, which has no ids and decodes to no bytes; null and repeated
ids of documents are kept, row by row; there are no ties, as ranks are unique; an empty table gives no rows; other columns are left out of
the query and kept by encoded().
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import kept, table

BUCKETS, MOST, SHORT = 1 << 16, 1 << 19, 256
NONE = (1 << 31) - 1
FIELD = (1 << 9) - 1  # the most bytes that a piece folded one pair at a time may have

_EVERY = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)


# -- vocabulary and pattern --------------------------------------------------------------


@lru_cache
def ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks; each line of the file has a base64 string and a rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _known(kind: str) -> set[str]:
    """Characters of a class, as the tokenizer's library sees it: what it doesn't match it leaves out."""
    import tiktoken

    single = tiktoken.Encoding("single", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return set(single.decode_bytes(single.encode_ordinary(_EVERY)).decode())


def _listed(chars: set[str]) -> str:
    """As ranges, for a character class."""
    codes = sorted(map(ord, chars))
    runs = [[c for _, c in run] for _, run in groupby(enumerate(codes), lambda x: x[1] - x[0])]
    return "".join(f"\\x{{{run[0]:X}}}-\\x{{{run[-1]:X}}}" for run in runs)


def _class(spark: SparkSession, kind: str) -> str:
    """The inside of a Java character class that holds the characters that the library finds in `kind`."""
    known = _known(kind)
    if len(known) < 100:
        return _listed(known)
    java = set(spark.range(1).select(F.regexp_replace(F.lit(_EVERY), f"[^{kind}]", "")).first()[0])
    more, less = known - java, java - known
    # most characters lie below the least that differs, and are told by one comparison
    out = kind + (f"[\\x{{{ord(min(more)):X}}}-\\x{{10FFFF}}&&[{_listed(more)}]]" if more else "")
    return f"{out}&&[^{_listed(less)}]" if less else out


_patterns: dict[str, str] = {}


def java_pattern(spark: SparkSession, pattern: str) -> str:
    """A pattern of the library for Java: \\p{L}, \\p{N} and \\s, alone or in a negated class, stand for the library's characters."""
    if pattern not in _patterns:
        out = pattern
        classes = {kind: _class(spark, kind) for kind in (r"\p{L}", r"\p{N}", r"\s")}
        out = out.replace(r"[^\s\p{L}\p{N}]", "\0").replace(r"\S", "\1")
        for kind, inside in classes.items():
            out = out.replace(kind, f"[{inside}]")
        none = "".join(f"[{inside}]" for inside in classes.values())
        _patterns[pattern] = out.replace("\0", f"[^{none}]").replace("\1", f"[^{classes[chr(92) + 's']}]")
    return _patterns[pattern]


# -- literals of the plan ----------------------------------------------------------------


def with_literal(value: DataFrame, build: Callable[[Column], DataFrame]) -> DataFrame:
    """What `build` makes of the only value of a table of one row, which its plan holds as a literal. The value must have a bound."""
    spark = value.sparkSession
    name = f"loomwork_{uuid.uuid4().hex}"
    kind = value.schema[0].dataType.simpleString()
    value.createOrReplaceTempView(name)
    spark.sql(f"declare variable {name} {kind}")
    try:
        spark.sql(f"set var {name} = (select * from {name})")
        out = build(F.expr(f"system.session.{name}"))
        out.schema  # analysed: from here on the plan has the value itself
        return out
    finally:
        spark.sql(f"drop temporary variable {name}")
        spark.catalog.dropTempView(name)


def _place(key: Column) -> Column:
    return F.hash(key).bitwiseAND(F.lit(BUCKETS - 1))


def lookup_table(rows: DataFrame) -> DataFrame:
    """(key, value) of bounded size as one array of maps: a key is in the map at its hash modulo BUCKETS.

    A map is searched from its first key on. With a column `n`, keys come by falling n, so that what is seen most is found first.
    """
    spark = rows.sparkSession
    order = -F.col("n") if "n" in rows.columns else F.lit(0)
    entries = F.transform(F.sort_array(F.collect_list("entry")), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    parts = rows.select(_place(F.col("key")).alias("part"), F.struct(order.alias("order"), "key", "value").alias("entry")).groupBy("part").agg(entries.alias("entries"))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("part")).join(parts, "part", "left")
    none = F.array().cast(parts.schema["entries"].dataType)
    ordered = F.sort_array(F.collect_list(F.struct("part", F.coalesce("entries", none).alias("entries"))))
    return every.agg(F.transform(ordered, lambda x: F.map_from_entries(x["entries"])).alias("maps"))


def found(maps: Column, key: Column) -> Column:
    return F.element_at(F.get(maps, _place(key)), key)


def rank_table(spark: SparkSession, path: str) -> DataFrame:
    have = ranks(path)
    return lookup_table(spark.createDataFrame(pa.table({"key": pa.array(list(have), pa.binary()), "value": pa.array(list(have.values()), pa.int32())})))


# -- encoding ----------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once: the end of a fold over nothing, which is interpreted without asking for the body's type each time."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def _if(condition: Column, yes: Column, no: Column) -> Column:
    return F.call_function("if", condition, yes, no)


def _pair(rank: Callable[[Column], Column], a: Column, b: Column) -> Column:
    return F.coalesce(rank(F.concat(a, b)), F.lit(NONE))


def _pairs(rank: Callable[[Column], Column], p: Column) -> Column:
    """Ranks of neighbours, of two pieces at least."""
    return F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: _pair(rank, F.get(p, i - 1), F.get(p, i)))


def _one(rank: Callable[[Column], Column], acc: Column, j: Column) -> Column:
    """With the j-th pair (from 1) merged."""
    p, r = acc["p"], acc["r"]
    none = F.array().cast("array<int>")

    def merged(new: Column) -> Column:
        left = F.when(j > 1, F.array(_pair(rank, F.get(p, j - 2), new))).otherwise(none)
        right = F.when(j + 1 < F.size(p), F.array(_pair(rank, new, F.get(p, j + 1)))).otherwise(none)
        pieces = F.concat(F.slice(p, 1, j - 1), F.array(new), F.slice(p, j + 2, F.size(p)))
        return F.struct(pieces.alias("p"), F.concat(F.slice(r, 1, F.greatest(j - 2, F.lit(0))), left, right, F.slice(r, j + 2, F.size(r))).alias("r"))

    return let(F.concat(F.get(p, j - 1), F.get(p, j)), merged)


def _all(rank: Callable[[Column], Column], acc: Column, m: Column) -> Column:
    """With all pairs of rank m merged, from left to right; the first alone where merging brings up a rank below m."""
    p, r = acc["p"], acc["r"]

    def marked(flags: Column) -> Column:
        """2 for a piece that takes in the next, _ for one taken in."""
        return F.split(F.regexp_replace(F.concat(flags, F.lit("0")), "1.", "2_"), "")

    def merged(marks: Column) -> Column:
        stay = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(marks, i) != "_")
        pieces = F.transform(stay, lambda i: F.when(F.get(marks, i) == "2", F.concat(F.get(p, i), F.get(p, i + 1))).otherwise(F.get(p, i)))
        # a merged piece beside the piece that followed it, before that one is merged itself
        between = F.exists(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (F.get(marks, i) == "2") & (_pair(rank, F.concat(F.get(p, i), F.get(p, i + 1)), F.get(p, i + 2)) < m))
        new = let(pieces, lambda q: F.struct(q.alias("p"), F.when(F.size(q) > 1, _pairs(rank, q)).otherwise(F.array().cast("array<int>")).alias("r")))
        first = F.array_position(r, m).cast("int")
        return let(new, lambda n: F.when(between | F.coalesce(F.array_min(n["r"]) < m, F.lit(False)), _one(rank, acc, first)).otherwise(n))

    flags = F.array_join(F.transform(r, lambda x: F.when(x == m, "1").otherwise("0")), "")
    return let(marked(flags), merged)


def _short(rank: Callable[[Column], Column], data: Column) -> Column:
    """Merges one pair at a time, of FIELD bytes at most.

    A piece is one integer, from the top: the rank of the pair it begins, its place in the bytes, its end and the pair's end. So the least of all
    is the leftmost pair of the least rank, and a merge changes its neighbours only; the others are told by one comparison of a field.
    Each node of an expression is interpreted for each piece and step: fields are put together by OR, as the sum looks up its type at every call.
    """
    n = F.length(data)
    ats, ends, lasts = (F.lit(x).cast("long") for x in (FIELD << 18, FIELD << 9, FIELD))
    at = lambda x: F.shiftright(x, 18).bitwiseAND(lasts)
    end = lambda x: F.shiftright(x, 9).bitwiseAND(lasts)
    last = lambda x: x.bitwiseAND(lasts)
    cut = lambda begin, until: F.substring(data, begin.cast("int") + F.lit(1), (until - begin).cast("int"))
    none = F.lit(NONE << 27)
    high = lambda key: F.coalesce(F.shiftleft(rank(key).cast("long"), 27), none)
    pair = lambda begin, until: let(cut(begin, until), high)

    def single(i: Column) -> Column:
        places = F.lit((1 << 9) + 2) + i.cast("long") * F.lit((1 << 18) + (1 << 9) + 1)  # i, i + 1, i + 2
        return _if(i < n - F.lit(1), let(F.substring(data, i + F.lit(1), F.lit(2)), high).bitwiseOR(places), none.bitwiseOR(places - F.lit(1)))

    def step(pieces: Column, m: Column) -> Column:
        def around(left: Column, right: Column) -> Column:
            def changed(x: Column) -> Column:
                alone = last(x) == end(x)
                merged = _if(alone, none, pair(at(m), last(x))).bitwiseOR(m.bitwiseAND(ats)).bitwiseOR(x.bitwiseAND(F.lit(FIELD << 9 | FIELD).cast("long")))
                before = pair(at(x), last(m)).bitwiseOR(x.bitwiseAND(F.lit(FIELD << 18 | FIELD << 9).cast("long"))).bitwiseOR(last(m))
                near = _if(x.bitwiseAND(ends) == left, before, merged)
                return _if(x.bitwiseAND(ends) < left, x, _if(x.bitwiseAND(ats) > right, x, near))

            return F.transform(F.array_remove(pieces, m), changed)

        # m's beginning where others have their end, and its end where they have their beginning
        return let(F.shiftright(m.bitwiseAND(ats), 9), lambda left: let(F.shiftleft(m.bitwiseAND(ends), 9), lambda right: around(left, right)))

    merge = lambda acc, _: let(F.array_min(acc), lambda m: _if(m >= none, acc, step(acc, m)))
    start = F.transform(F.sequence(F.lit(0), n - F.lit(1)), single)
    return F.aggregate(F.sequence(F.lit(2), n), start, merge, lambda acc: F.transform(acc, lambda x: cut(at(x), end(x))))


def merged_pieces(rank: Callable[[Column], Column], data: Column, short: int = SHORT) -> Column:
    """The byte strings that a piece's bytes (two at least) are merged into."""
    single = F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.substring(data, i, F.lit(1)))
    start = let(single, lambda p: F.struct(p.alias("p"), _pairs(rank, p).alias("r")))
    least = lambda acc: F.coalesce(F.array_min(acc["r"]), F.lit(NONE))

    def many(acc: Column, _: Column) -> Column:
        """Once nothing is left to merge, the ranks go, so that the steps left over cost nothing."""
        done = F.struct(acc["p"].alias("p"), F.array().cast("array<int>").alias("r"))
        return F.when(F.size(acc["r"]) == 0, acc).otherwise(let(least(acc), lambda m: F.when(m == NONE, done).otherwise(_all(rank, acc, m))))

    long = F.aggregate(F.sequence(F.lit(2), F.length(data)), start, many, lambda acc: acc["p"])
    return F.when(F.length(data) <= min(short, FIELD), _short(rank, data)).otherwise(long)


def ids_of(maps: Column, piece: Column, short: int = SHORT) -> Column:
    """Ids of a piece (a string, not empty). A piece that is in the vocabulary is its own only id."""
    rank = lambda x: found(maps, x)

    def ids(data: Column) -> Column:
        whole = rank(data)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(merged_pieces(rank, data, short), rank))

    return let(F.encode(piece, "utf-8"), ids)


def frequent(pieces: DataFrame, most: int = MOST) -> DataFrame:
    """Distinct pieces, and how often they are seen (n), of those seen at least as often as lets at most `most` through, by steps of an eighth of an octave."""
    step = F.floor(8 * F.log2("n")).cast("int")
    counts = kept(pieces.groupBy("piece").agg(F.count("*").alias("n")).where("n > 1"), "pieces")
    held, bound = 0, None
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("pieces")).orderBy(F.desc("step")).collect():  # 500 rows at the very most
        held += row["pieces"]
        if held > most:
            break
        bound = row["step"]
    return counts.where(step >= bound if bound is not None else F.lit(False))


def encoded(docs: DataFrame, path: str, pattern: str | None = None, most: int = MOST, short: int = SHORT) -> DataFrame:
    """Documents with `ids`, array<int>, of their text; a column of that name is replaced."""
    import public_tokenizers

    spark = docs.sparkSession
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(java_pattern(spark, pattern or public_tokenizers.PATTERN)), F.lit(0))

    def whole(maps: Column) -> DataFrame:
        common = frequent(docs.select(F.explode(pieces).alias("piece")), most)
        known = kept(common.select(F.col("piece").alias("key"), ids_of(maps, F.col("piece"), short).alias("value"), "n"), "piece-ids")
        ids = lambda table: lambda piece: F.coalesce(found(table, piece), ids_of(maps, piece, short))
        return with_literal(lookup_table(known), lambda table: docs.withColumn("ids", F.flatten(F.transform(pieces, ids(table)))))

    return with_literal(rank_table(spark, path), whole)


def decoded(df: DataFrame, path: str) -> DataFrame:
    """With `data`, the bytes of the column `ids`; a column of that name is replaced. Nulls stay null, unknown ids give null, null ids no bytes."""
    spark = df.sparkSession
    have = ranks(path)
    hexes = [None] * (1 + max(have.values()))
    for piece, rank in have.items():
        hexes[rank] = piece.hex()
    vocabulary = spark.createDataFrame(pa.table({"hexes": pa.array([hexes], pa.list_(pa.string()))}))

    def build(table: Column) -> DataFrame:
        parts = F.transform("ids", lambda i: F.get(table, i))
        known = (F.size("ids") == 0) | ((F.array_min("ids") >= 0) & (F.array_max("ids") < len(hexes)))
        if None in hexes:  # then the ends don't tell
            known = known & ~F.exists("ids", lambda i: F.get(table, i).isNull())
        return df.withColumn("data", F.when(known, F.unhex(F.array_join(parts, ""))))

    return with_literal(vocabulary, build)


# -- the query ---------------------------------------------------------------------------


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decoded(encoded(docs, byte_bpe()).select("doc_id", "ids"), byte_bpe())
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
