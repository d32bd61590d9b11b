"""The prefix trie against plain Python, with collisions of fingerprints, ranges that cut conversations, and odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwork.llm.prefixtrie import OP11_SQL, prefix_trie, scan

SCHEMA = "conv_id long, turn long, role string, text string, depth string, fp string, digest string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """By dictionaries of whole prefixes."""
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(xs)] for c, xs in own.items()}
    made = {}
    for c, xs in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + xs[h:]
    members = {}
    for c, xs in made.items():
        for d in range(len(xs) + 1):
            members.setdefault(tuple(xs[:d]), []).append(c)
    out = {}
    for prefix, cs in members.items():
        under = [p for p in members if p[: len(prefix)] == prefix]
        children = lambda p: sum(len(q) == len(p) + 1 and q[:-1] == p for q in members)
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in under if p)
        ends = ",".join(str(c) for c in sorted(cs) if len(made[c]) == len(prefix))
        out[min(cs), len(prefix)] = (min(members[prefix[:-1]]) if prefix else None, len(cs), children(prefix), sum(not children(p) for p in under), saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted((c, d, *x) for (c, d), x in out.items())


def ours(spark, rows, bits=64):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie(df, bits).collect())


def conversations(seed, n=50, texts=3, most=5):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), f"word {'a b ' * rng.randrange(texts)}") for c in range(n) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("bits", [64, 1])
def test_against_plain_python(spark, bits):
    rows = conversations(1)
    assert ours(spark, rows, bits) == plain(rows)


ODD = [
    (None, 0, "user", "no conversation"), (3, None, "user", "no turn"), (3, 1, None, "no role"), (3, 2, "user", None), (3, 0, "", ""), (3, 0, "user", "tie"), (3, 0, "assistant", "tie"), (3, 5, "user", "again"), (3, 5, "user", "again"),
    (40, 0, "user", "word " * 20_000), (41, 0, "user", "word " * 20_000), (41, 1, "user", "a\0b"), (59, 7, "user", "alone"), (60, 1, "user", "short"), (61, 1, "user", "t"), (61, 2, "user", "u"), (-5, 1, "user", "t"),
]


def test_odd_rows(spark):
    rows = [r for r in ODD if r[0] is None or r[0] >= 0]
    assert ours(spark, rows) == plain(rows)
    assert min(ours(spark, ODD), key=lambda r: r[1])[0] == -5  # the root


def test_empty_table(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(None, 1, "user", "x")]) == []


def test_one_conversation_over_many_ranges(spark):
    """Most rows are of one conversation, which reaches over several ranges."""
    rows = [(7, t, "user", f"turn {t % 11}") for t in range(900)] + [(c, t, "user", f"turn {t % 11}") for c in (0, 8, 20) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("one", F.lit(1).cast("long")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    placed = scan(df.select("conv_id", "turn", "one", "digest"), "conv_id", [F.col("turn")], ["one"], "digest")
    assert all(r["place"] == r["turn"] and r["one"] == r["turn"] + 1 for r in placed.collect())
    after = {}
    for r in placed.collect():  # equal prefixes, equal fingerprints
        assert after.setdefault(r["turn"], r["fp"]) == r["fp"]
    found = ours(spark, rows)
    assert len(found) > 900 and sum(r[3] for r in found) >= 912
    assert max(r[1] for r in found) == 900 and found[0][5] == sum(r[4] == 0 for r in found)


def test_sql(spark):
    rows = conversations(2, 70, 2, 6) + [(1, None, None, None)]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = con.execute(OP11_SQL)
    names = [d[0] for d in got.description]
    assert sorted(tuple(r[names.index(c)] for c in COLUMNS) for r in got.fetchall()) == plain(rows)
