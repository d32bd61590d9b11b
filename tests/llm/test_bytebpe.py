"""Byte-level BPE against the tokenizer's library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from conftest_llm import ODD
from pyspark.sql import functions as F

from loomwork.llm import bytebpe
from loomwork.llm.bytebpe import NONE, byte_bpe, decoded, encoded, found, java_pattern, lookup_table, merged_pieces, ranks, with_literal


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(byte_bpe()), special_tokens={})


def texts(prose):
    rng = random.Random(5)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    return [
        *ODD, prose(300, 1), prose(300, 1), "it's we'LL  don't 123456  !!!???\n\n\nx", " 　 \u0085a", "x" * 20_000, "ab" * 300 + "aba" * 100, "-" * 700, "中文字符测试" * 100, "<|endoftext|>",
        "".join(rng.choice("abcdefgh") for _ in range(600)), "".join(every[::29]),
    ]


def test_against_the_library(spark, frame, prose, library):
    given = texts(prose)
    df = frame(given)
    out = decoded(encoded(df, byte_bpe()), byte_bpe())
    assert set(out.columns) == {*df.columns, "ids", "data"}
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == len(given)
    for i, text in enumerate(given):
        assert rows[i]["ids"] == library.encode_ordinary(text or "")
        assert bytes(rows[i]["data"]) == (text or "").encode()


def test_pieces_outside_of_the_frequent_ones_and_bulk_merges(spark, frame, prose, library):
    given = [prose(60, 2), "abababababab ababa bababab", "the the the", None]
    for most, short in ((0, 256), (3, 4), (1000, 0)):
        got = {r["doc_id"]: r["ids"] for r in encoded(frame(given), byte_bpe(), most=most, short=short).collect()}
        assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(given)}


def test_empty_table_and_null_ids(spark, empty, frame):
    assert encoded(empty, byte_bpe()).collect() == []
    assert len(encoded(frame(["a", "a", None], [None, None, 1]), byte_bpe()).collect()) == 3


def test_unknown_ids_decode_to_null(spark):
    df = spark.createDataFrame([([0, 1],), ([],), ([60_000],), (None,)], "ids array<int>")
    assert [r["data"] is None for r in decoded(df, byte_bpe()).collect()] == [False, False, True, True]


def test_a_merge_that_brings_up_a_lower_rank(spark):
    """Ranks no training would give: ab 9, then abc 1, which the next ab must wait for; aba by two splits."""
    vocabulary = {bytes([c]): c for c in b"abcd"} | {b"ab": 1009, b"abc": 1001, b"abcd": 1005, b"ba": 1010, b"aba": 1002, b"cd": 1011, b"bc": 1012, b"abab": 1000}
    library = tiktoken.Encoding("odd", pat_str=r"[a-d]+", mergeable_ranks={**{bytes([i]): i for i in range(256)}, **vocabulary}, special_tokens={})
    rng = random.Random(9)
    given = ["ababcabab", "abcabcd", "aabab", *("".join(rng.choice("abcd") for _ in range(rng.randint(2, 40))) for _ in range(150))]
    df = spark.createDataFrame([(t,) for t in given], "text string")
    rows = [(bytearray(k), v) for k, v in vocabulary.items()]
    maps = lookup_table(spark.createDataFrame(rows, "key binary, value int"))
    for short in (256, 0):
        out = with_literal(maps, lambda m: df.select("text", merged_pieces(lambda x: found(m, x), F.encode("text", "utf-8"), short).alias("pieces")))
        for r in out.collect():
            whole = r["text"].encode()
            if whole not in vocabulary:
                assert [bytes(p) for p in r["pieces"]] == [library.decode_single_token_bytes(i) for i in library.encode_ordinary(r["text"])]
    assert NONE > 50_256


def test_plans_hold_no_python_and_short_literals(spark, frame):
    plan = encoded(frame(["a"]), byte_bpe())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEvalPython", "Arrow")
    assert len(plan) < 200_000


def test_pattern_keeps_what_java_cannot_know(spark):
    """Letters of later versions of Unicode than Java's."""
    pattern = java_pattern(spark, public_tokenizers.PATTERN)
    late = "".join(chr(c) for c in (0x870, 0x31350, 0x1C89))
    got = spark.createDataFrame([(f"a{late} b\u0085c",)], "t string").select(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).first()[0]
    assert got[0] == f"a{late}" and hashlib.sha256("".join(got).encode()).digest() == hashlib.sha256(f"a{late} b\u0085c".encode()).digest()


def test_what_is_seen_most_is_found_first(spark, monkeypatch):
    """A map is searched from its first key on; all keys are in one map here."""
    monkeypatch.setattr(bytebpe, "BUCKETS", 1)
    rows = spark.createDataFrame([("a", 1, 5), ("b", 2, 900), ("c", 3, 70), ("d", 4, 70)], "key string, value int, n long").repartition(4)
    table = lookup_table(rows)
    assert table.select(F.map_keys(F.get("maps", F.lit(0)))).first()[0] == ["b", "c", "d", "a"]
    got = with_literal(table, lambda m: spark.range(1).select(*(found(m, F.lit(k)).alias(k) for k in "abcdx"))).first()
    assert list(got) == [1, 2, 3, 4, None]
