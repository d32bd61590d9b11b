"""Trie of conversation prefixes, from polynomial rolling fingerprints.

A conversation's turns in order have the running fingerprint sum(h(turn i) * BASE**i), modulo 2**64: numpy adds it up in
ranges of (conv_id, turn), and a range goes on where the ranges before it ended, so a conversation of any length is spread
over tasks. As the sum rolls, fingerprints of a conversation rebuilt with another's first turns follow from those of the two.

Prefixes of a depth and fingerprint are candidates for one node. Each is verified turn by turn: the SHA-256 of role and text of the
turn at this depth is held against the group's representative, and prefixes one turn shorter have been held in the
same way. Where a group holds different turns, it is split: all prefixes that pass through it carry the id of their own turn's first
conversation from there on.

Rollup: a node belongs to its smallest member, so each conversation owns a chain of nodes, and hangs on a
conversation of smaller id. Totals of chains are added up by doubling the distance to their ancestors, then along each chain
from its end by the same scan as above. A node's ids are joined to blocks in tasks, and the blocks hashed in order.

Nulls, ties and the like: null roles and texts are empty, null turns come first, rows without conv_id are left out, and a
negative id's block is found by a remainder that is negative too, as in SQL; turns of an equal number go by
the SHA-256 of role and text, and repeated rows are turns of their own. An empty table has no nodes, not even a root. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import kept, table

BASE = 0x9E3779B97F4A7C15
#: A conversation takes fewer than HEADS first turns, from the one that opens its block of ids.
HEADS, SHARE = 4, 20
IDS = 1 << 15
_M = (1 << 64) - 1
_LOW = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full((1 << 16) - 1, BASE, np.uint64)]))


# -- fingerprints ------------------------------------------------------------------------


def powers(n: np.ndarray) -> np.ndarray:
    """BASE to the powers n, modulo 2**64; negative ones as well, as BASE is odd."""
    high, back = np.unique(n >> 16, return_inverse=True)
    return np.array([pow(BASE, int(h) << 16, 1 << 64) for h in high], np.uint64)[back] * _LOW[n & 0xFFFF]


def turn_hashes(column: pa.Array, bits: int) -> np.ndarray:
    """The first `bits` bits of each 32-byte digest."""
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    start = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[start[0] : start[-1]].reshape(-1, 32)
    return np.ascontiguousarray(raw[:, :8]).view("<u8")[:, 0] >> np.uint64(64 - bits)


def _running(values: np.ndarray, first: np.ndarray, carry: np.uint64) -> np.ndarray:
    """Sums up to and with each value since the last true `first`; those before any continue from carry."""
    total = np.cumsum(values, dtype=np.uint64)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(values)), -1))
    before = np.where(begin > 0, total[np.maximum(begin - 1, 0)], np.uint64(0))
    return np.where(begin < 0, total + carry, total - before)


def scan(df: DataFrame, key: str, order: list[Column], sums: list[str], digest: str | None = None, bits: int = 64) -> DataFrame:
    """df with `place` (from 0) of each row among its key's, running `sums`, and the running fingerprint `fp` of `digest`.

    Rows are sorted in ranges of (key, order). The driver sees the first and last key of each range, and what the keys
    that reach over a border have added up in it: two rows for each range.
    """
    spark = df.sparkSession
    adds = [*sums, *(["fp"] if digest else [])]
    schema = ", ".join([*(f"{n} {t}" for n, t in df.dtypes if n not in sums), "place long", *(f"{n} long" for n in adds)])
    names = [n for n in df.columns if n not in sums]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, carry = None, 0, dict.fromkeys(adds, np.uint64(0))
        part = TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key).to_numpy()
            first = np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]])
            at = np.arange(len(keys)) - np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
            at += np.where(np.cumsum(first) == 0, n, 0)
            values = {s: b.column(s).to_numpy(zero_copy_only=False).view(np.uint64) for s in sums}
            if digest:
                values["fp"] = turn_hashes(b.column(digest), bits) * powers(at)
            out = {s: _running(v, first, carry[s]) for s, v in values.items()}
            last, n, carry = keys[-1], int(at[-1]) + 1, {s: v[-1] for s, v in out.items()}
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(at), *(pa.array(out[s].view(np.int64)) for s in adds), pa.array(np.full(len(keys), part))], [*names, "place", *adds, "part"])

    rows = kept(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(add, f"{schema}, part long"), "scan")
    ends = rows.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")).orderBy("part").collect()  # one row a range
    over = {a["high"] for a, b in zip(ends, ends[1:], strict=False) if a["high"] == b["low"]}
    before: dict[tuple[int, int], tuple[int, list[int]]] = {}
    if over:
        crossing = rows.join(F.broadcast(spark.createDataFrame([(k,) for k in over], f"{key} long")), key, "left_semi")
        totals = crossing.groupBy(key, "part").agg(F.max(F.struct("place", *adds)).alias("end")).orderBy(key, "part").collect()
        last, n, carry = None, 0, []
        for r in totals:
            if r[key] != last:
                last, n, carry = r[key], 0, [0] * len(adds)
            before[r["part"], r[key]] = n, carry
            shift = {"fp": pow(BASE, n, 1 << 64)}
            carry = [(c + shift.get(s, 1) * r["end"][s]) & _M for s, c in zip(adds, carry, strict=True)]
            n += r["end"]["place"] + 1
    if not before:
        return rows.drop("part")

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, parts = b.column(key).to_numpy(), b.column("part").to_numpy()
            place, out = b.column("place").to_numpy().copy(), {s: b.column(s).to_numpy().view(np.uint64).copy() for s in adds}
            for part in np.unique(parts).tolist():
                here = parts == part
                for k in {int(keys[here].min()), int(keys[here].max())}:
                    if (part, k) in before:
                        n, carry = before[part, k]
                        mine = here & (keys == k)
                        place[mine] += n
                        for s, c in zip(adds, carry, strict=True):
                            out[s][mine] = out[s][mine] * np.uint64(pow(BASE, n, 1 << 64) if s == "fp" else 1) + np.uint64(c)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(place), *(pa.array(out[s].view(np.int64)) for s in adds)], [*names, "place", *adds])

    return rows.mapInArrow(go_on, schema)


# -- rebuilt conversations ---------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words), of a fixed size whatever the texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), words.alias("words"))


def rebuilt(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """(conv_id, depth, fp, parent_fp, digest, words, last) of every turn of the rebuilt conversations, and of their roots (depth 0)."""
    placed = scan(turns(conversations), "conv_id", [F.col("turn"), F.col("digest")], [], "digest", bits)
    donor, taken = F.col("conv_id") - F.col("conv_id") % SHARE, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    after = [F.max(F.when(F.col("place") == i, F.col("fp"))).alias(f"after{i + 1}") for i in range(HEADS - 1)]
    heads = kept(placed.groupBy("conv_id").agg((F.max("place") + 1).alias("n"), *after), "heads")

    def at(k: Column, prefix: str = "") -> Column:
        return F.coalesce(*(F.when(k == i + 1, F.col(f"{prefix}after{i + 1}")) for i in range(HEADS - 1)), F.lit(0).cast("long"))

    donors = heads.where(F.col("conv_id") % SHARE == 0).select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n"), *(F.col(f"after{i + 1}").alias(f"donor_after{i + 1}") for i in range(HEADS - 1)))
    joined = heads.withColumn("donor", donor).withColumn("h", taken).join(donors, "donor", "left").withColumn("g", F.least("h", F.coalesce("donor_n", F.lit(0).cast("long"))))
    length = F.col("g") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = kept(joined.select("conv_id", "donor", "h", "g", length.alias("length"), at(F.col("g"), "donor_").alias("given"), at(F.col("h")).alias("left_out")), "convs")

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda name: b.column(name).to_numpy(zero_copy_only=False)
            depth = get("place") + 1 + get("shift")
            fp = get("given").view(np.uint64) + powers(get("shift")) * (get("fp").view(np.uint64) - get("left_out").view(np.uint64))
            parent = fp - turn_hashes(b.column("digest"), bits) * powers(depth - 1)
            arrays = [b.column("conv_id"), pa.array(depth), pa.array(fp.view(np.int64)), pa.array(parent.view(np.int64)), b.column("digest"), b.column("words"), pa.array(depth == get("length"))]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "depth", "fp", "parent_fp", "digest", "words", "last"])

    schema = "conv_id long, depth long, fp long, parent_fp long, digest binary, words long, last boolean"
    own = placed.where(F.col("place") >= taken).join(convs, "conv_id").select("conv_id", "place", "fp", "digest", "words", "length", "given", "left_out", (F.col("g") - F.col("h")).alias("shift"))
    first = placed.where((F.col("place") < HEADS - 1) & (F.col("conv_id") % SHARE == 0)).withColumnRenamed("conv_id", "donor")
    none = F.lit(0).cast("long")
    lent = convs.join(first, "donor").where(F.col("place") < F.col("g")).select("conv_id", "place", "fp", "digest", "words", "length", none.alias("given"), none.alias("left_out"), none.alias("shift"))
    root = convs.select("conv_id", none.alias("depth"), none.alias("fp"), F.lit(None).cast("long").alias("parent_fp"), F.lit(None).cast("binary").alias("digest"), none.alias("words"), (F.col("length") == 0).alias("last"))
    return own.unionByName(lent).mapInArrow(roll, schema).unionByName(root)


# -- nodes -------------------------------------------------------------------------------


def verified(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by (depth, fp, split), and the prefixes with the `split` of their node; '' where fingerprints didn't collide."""
    plain = lambda df: df.withColumn("split", F.lit("")).withColumn("parent_split", F.lit(""))
    node = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("parent_fp").alias("parent_fp"), F.min("parent_split").alias("parent_split"), F.max("words").alias("words")]
    groups = kept(plain(prefixes).groupBy("depth", "fp", "split").agg(*node, F.min("digest").alias("least"), F.max("digest").alias("most")), "prefix-groups")
    mixed = groups.where("least != most").select("depth", "fp")
    if not mixed.limit(1).count():
        return groups.drop("least", "most"), plain(prefixes)
    hit = prefixes.join(mixed, ["depth", "fp"], "left_semi").select("conv_id", "depth", "fp", "digest")
    of = hit.groupBy("depth", "fp", "digest").agg(F.min("conv_id").alias("first"))
    marks = hit.join(of, ["depth", "fp", "digest"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "first"))).alias("marks"))

    def split(depth: Column) -> Column:
        seen = F.filter("marks", lambda m: m["depth"] <= depth)
        return F.coalesce(F.array_join(F.transform(seen, lambda m: F.concat(m["depth"].cast("string"), F.lit(":"), m["first"].cast("string"))), ","), F.lit(""))

    told = kept(prefixes.join(marks, "conv_id", "left").withColumn("split", split(F.col("depth"))).withColumn("parent_split", split(F.col("depth") - 1)).drop("marks"), "split-prefixes")
    return kept(told.groupBy("depth", "fp", "split").agg(*node), "prefix-nodes"), told


def end_hashes(prefixes: DataFrame) -> DataFrame:
    """(depth, fp, split, ends_sha256) of the nodes at which conversations end."""
    node = ["depth", "fp", "split"]

    def groups(b: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
        keys = list(zip(*(b.column(c).to_pylist() for c in node), strict=True))
        cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        yield from ((keys[a], a, z) for a, z in zip(cuts, [*cuts[1:], len(keys)], strict=True))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, IDS) for x in batches for at in range(0, x.num_rows, IDS)):
            ids = b.column("conv_id").to_pylist()
            out = [(*key, ids[a], ",".join(map(str, ids[a:z]))) for key, a, z in groups(b)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*node, "conv_id", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        done = lambda key, state: pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], [*node, "ends_sha256"])
        for b in batches:
            texts = b.column("ids").to_pylist()
            for key, a, z in groups(b):
                if key != last:
                    if last is not None:
                        yield done(last, state)
                    last, state = key, hashlib.sha256(texts[a].encode())
                    a += 1
                for t in texts[a:z]:
                    state.update(b"," + t.encode())
        if last is not None:
            yield done(last, state)

    rows = prefixes.where("last").select(*node, "conv_id")
    lists = rows.repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id").mapInArrow(blocks, "depth long, fp long, split string, conv_id long, ids string")
    return lists.repartition(*node).sortWithinPartitions(*node, "conv_id").mapInArrow(hashes, "depth long, fp long, split string, ends_sha256 string")


def chain_totals(chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved) summed over chains(conv_id, parent, leaves, saved) and all that hang on them."""
    now = kept(chains.select("conv_id", F.col("parent").alias("up"), "leaves", "saved"), "chains")
    while now.where("up is not null").limit(1).count():
        # `up` is the ancestor at 1, 2, 4, ... steps, and the sums are of all chains nearer than that
        hanging = now.where("up is not null")
        add = hanging.groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = hanging.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        sums = now.join(add, "conv_id", "left").select("conv_id", "up", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        now = kept(sums.join(further, "up", "left").select("conv_id", F.col("next").alias("up"), "leaves", "saved"), "chains")
    return now.select("conv_id", "leaves", "saved")


def prefix_trie(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """Nodes of conversations(conv_id, turn, role, text); fewer `bits` of fingerprints give the same nodes by more splits."""
    prefixes = kept(rebuilt(conversations, bits), "prefixes")
    nodes, told = verified(prefixes)
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("parent_fp"), F.col("split").alias("parent_split"), F.col("conv_id").alias("parent_conv_id"))
    linked = kept(nodes.join(up, ["depth", "parent_fp", "parent_split"], "left").select("conv_id", "depth", "fp", "split", "parent_conv_id", "n_convs", "words"), "linked")
    children = linked.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    counted = kept(linked.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children"]), "counted")
    own = counted.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    chains = kept(own.groupBy("conv_id").agg(F.min("depth").alias("top"), F.min_by("parent_conv_id", "depth").alias("parent"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "chain-tops")
    tops = chains.where("parent is not null").select("conv_id", "parent", (F.col("top") - 1).alias("depth"))
    hung = tops.join(chain_totals(chains), "conv_id").groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    gained = own.join(hung, ["conv_id", "depth"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0))).drop("more_leaves", "more_saved")
    summed = scan(gained.withColumn("from_end", -F.col("depth")), "conv_id", [F.col("from_end")], ["leaves", "saved"])
    out = summed.join(end_hashes(told), ["depth", "fp", "split"], "left")
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), ends.alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: Whole prefixes as lists; crc32 is written out, as DuckDB has none.
OP11_SQL = r"""
with t as (select conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as x, row_number() over (partition by conv_id order by turn nulls first) as place from conversations where conv_id is not null),
own as (select conv_id, list(x order by place) as xs from t group by conv_id),
h as (select conv_id, xs, xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end)))) % 4 as h from own),
r as (select h.conv_id, coalesce(d.xs[1:h.h], []) || h.xs[h.h + 1:] as xs from h left join own d on d.conv_id = h.conv_id - h.conv_id % 20),
p as (select conv_id, d, xs[1:d] as prefix, d = len(xs) as last from r, unnest(generate_series(0, len(xs))) as g(d)),
n as materialized (select d, prefix, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where last), '')) as ends_sha256,
        (count(*) - 1) * case when d = 0 then 0 else len(regexp_extract_all(prefix[-1].text, '[^\x20\x09-\x0D]+')) end as saved from p group by d, prefix),
c as (select d - 1 as d, prefix[1:d - 1] as prefix, count(*) as n_children from n where d > 0 group by all),
k as (select n.*, coalesce(n_children, 0) as n_children from n left join c using (d, prefix)),
s as (select a as d, prefix[1:a] as prefix, count(*) filter (where n_children = 0) as n_leaves, cast(sum(saved) as bigint) as saved_tokens from k, unnest(generate_series(0, d)) as g(a) group by all)
select k.conv_id, k.d as depth, u.conv_id as parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256
from k join s using (d, prefix) left join n u on u.d = k.d - 1 and u.prefix = k.prefix[1:k.d - 1]"""
