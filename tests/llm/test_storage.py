"""Media archives, packed ids and pseudonyms: exact round trips."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import media, packing, pii
from loomwork.llm.common import new_dir

# -- packed ids ------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.lists(st.integers(0, 9000), max_size=5), st.randoms())
def test_any_width_and_range(bits, lengths, rnd):
    writer, all_ids = packing.ShardWriter(bits), []
    for n in lengths:
        ids = np.array([rnd.randrange(1 << bits) for _ in range(n)], np.uint32)
        writer.add(pa.array([n, None]), ids, np.array([n // 2, n - n // 2]))
        all_ids.append(ids)
    shard = packing.Shard(io.BytesIO(b"".join(writer.finish())))
    whole = np.concatenate([*all_ids, np.zeros(0, np.uint32)])
    assert shard.bits == bits and np.array_equal(shard.ids(0, shard.n), whole)
    for _ in range(5):
        a, b = sorted((rnd.randrange(len(whole) + 1), rnd.randrange(len(whole) + 1)))
        assert np.array_equal(shard.ids(a, b), whole[a:b])


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.word_bpe())


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(2)
    odd = [t or "" for t in ODD[:-1]] + ["a<|endoftext|>b", "A.<|ENDOFTEXT|>!x", "don't 'S it'll.'s é É́x ÀÇ×÷ß ﬁ İI 5.a a.5 ₂²½ Σας ΟΔΟΣ", "a!'s!'t'.s '!re", "\x1c\x1dab\x85c", "ẞ Ÿ. _a_b-c{d}~`e`^f"]
    odd += ["".join(rng.choice("aB.'!s é́<|>|'tÉ5 \nœ-_…") for _ in range(40)) for _ in range(800)]
    flat, lengths = packing.Encoder(packing.word_bpe()).encode(pa.array(odd), 2)
    tok, at = tokenizer(), 0
    for text, n in zip(odd, lengths, strict=True):
        assert flat[at : at + n].tolist() == tok.encode(text, add_special_tokens=False).ids + [2], text
        at += n


def test_packed_rows_against_the_library(spark, frame):
    texts = ODD + ["same text"] * 3 + [f"text number {i}" for i in range(60)]
    ids = [None, 5, *range(10, 8 + len(texts))]
    out = packing.packed_ids(frame(texts, ids), packing.word_bpe()).collect()
    tok, start, want = tokenizer(), 0, []
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, hashlib.md5((x[1] or "").encode()).hexdigest())):
        x = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_encode_whole_texts(spark, frame, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, texts = public_tokenizers.path(name), [*ODD[:7], "Two  words", "Ünïcode's <|endoftext|>"]
    tok = Tokenizer.from_file(path)
    encoder = packing.encoder(path)
    assert not encoder.pieces and packing.encoder(packing.word_bpe()).pieces
    flat, lengths = encoder.encode(pa.array(texts), 2)
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert flat.tolist() == sum(want, []) and lengths.tolist() == [len(x) for x in want]
    folder = new_dir(spark, "other-bits")
    shard = packing.write_shards(frame(texts), folder, path, 2).first()
    with packing.opened(shard.path) as f:
        assert packing.Shard(f).bits == packing.width(encoder.vocabulary)


def test_ids_that_do_not_fit_are_refused():
    with pytest.raises(ValueError, match="fit"):
        packing.pack(np.array([70_000], np.uint32), 16)


def test_packing_in_a_given_order(spark):
    df = spark.createDataFrame([(i, f"text {i}", f"{(i * 7) % 10}") for i in range(10)], "doc_id long, text string, place string")
    out = packing.packed_ids(df, packing.word_bpe(), order="place").orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted(range(10), key=lambda i: (i * 7) % 10)


def test_packing_nothing(empty):
    assert packing.packed_ids(empty, packing.word_bpe()).count() == 0


# -- media -----------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_image_round_trip(raw):
    samples, n = media.decode(media.encode(raw))
    assert n == len(raw) and samples.tobytes() == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def test_media_rows(spark, frame):
    texts = ODD + ["same"] * 3
    ids = [None, *range(len(texts) - 2), 0]
    folder = new_dir(spark, "media-test")
    media.write_media(frame(texts, ids), folder, archive_bytes=200)
    read = media.read_media(spark, folder, range_bytes=150)
    assert read.rdd.getNumPartitions() > 3
    out = media.media_features(read).collect()
    want = []
    for i, t in zip(ids, texts, strict=True):
        p = media.payload((t or "").encode())
        want.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(want, key=str)
    same = {tuple(r)[1:] for r in out if r.payload_sha256 == hashlib.sha256(media.payload(b"same")).hexdigest()}
    assert len(same) == 1


def test_members_are_retried_by_offset(tmp_path, monkeypatch):
    writer = media.ArchiveWriter(str(tmp_path), 1 << 20)
    for i in range(5):
        writer.add(i, media.encode(b"x" * i))
    writer.close()
    path, n = writer.done[0]
    reader, fetched, real = media.MediaReader({"path": str(tmp_path)}), [], media.MediaReader.fetch

    def flaky(self, path, offset, size):
        fetched.append(offset)
        return b"?" * size if fetched.count(offset) == 1 and offset else real(self, path, offset, size)

    monkeypatch.setattr(media.MediaReader, "fetch", flaky)
    rows = [r for b in reader.read(media.ByteRange(path, 0, 1 << 30)) for r in b.to_pylist()]
    assert [r["attempts"] for r in rows] == [1, 2, 2, 2, 2] and [r["doc_id"] for r in rows] == list(range(5))
    monkeypatch.setattr(media.MediaReader, "fetch", lambda *a: b"")
    with pytest.raises(OSError, match="after 4 attempts"):
        list(reader.read(media.ByteRange(path, 0, 1 << 30)))


@pytest.mark.parametrize("cut", [0, 4, 12, 29])
def test_a_short_header_is_tried_again(tmp_path, monkeypatch, cut):
    writer = media.ArchiveWriter(str(tmp_path), 1 << 20)
    writer.add(1, media.encode(b"x"))
    writer.close()
    path, _ = writer.done[0]
    reader, real, calls = media.MediaReader({"path": str(tmp_path)}), media.resolve, []

    class Short:
        def __init__(self, file):
            self.file = file

        def __getattr__(self, name):
            return getattr(self.file, name)

        def read(self, n):
            calls.append(n)
            return self.file.read(n)[:cut] if len(calls) == 1 else self.file.read(n)

    class Store:
        def open_input_file(self, at):
            return Short(real(path)[0].open_input_file(at))

    members = reader.directory(path)
    monkeypatch.setattr(media, "resolve", lambda uri: (Store(), real(uri)[1]))
    assert reader.member(path, members[0]) == (media.encode(b"x"), 2)


def test_the_directory_is_tried_again_and_aborted_archives_go(tmp_path, monkeypatch):
    writer = media.ArchiveWriter(str(tmp_path), 1 << 20)
    writer.add(1, media.encode(b"x"))
    writer.close()
    path, _ = writer.done[0]
    reader, real, calls = media.MediaReader({"path": str(tmp_path)}), media.opened, []

    def flaky(uri, mode="r"):
        calls.append(uri)
        if len(calls) < 3:
            raise OSError("not there yet")
        return real(uri, mode)

    monkeypatch.setattr(media, "opened", flaky)
    assert len(reader.directory(path)) == 1 and len(calls) == 3
    media.MediaWriter({"path": str(tmp_path)}).abort([None, media.Committed(writer.done)])
    assert not list(tmp_path.glob("*.zip"))


def test_features_and_stored_form_by_hand(spark, frame):
    """From the PNG's chunks and plain sums."""
    folder, texts = new_dir(spark, "media-hand"), ["", "abc" * 50, "é" * 40]
    media.write_media(frame(texts), folder)
    read = media.read_media(spark, folder)
    stored = {r.doc_id: bytes(r.media) for r in read.collect()}
    for r in media.media_features(read).collect():
        png, raw = stored[r.doc_id], texts[r.doc_id].encode()
        at, chunks = 8, {}
        while at < len(png):
            n = int.from_bytes(png[at : at + 4], "big")
            chunks[png[at + 4 : at + 8]] = png[at + 8 : at + 8 + n]
            at += 12 + n
        lines = zlib.decompress(chunks[b"IDAT"])
        rows = [list(lines[i + 1 : i + 65]) for i in range(0, len(lines), 65)]
        flat = sum(rows, [])
        assert bytes(flat[: len(raw)]) == raw and not any(flat[len(raw) :])
        mean = sum(flat) / len(flat)
        sd = (sum((x - mean) ** 2 for x in flat) / len(flat)) ** 0.5
        step = sum(abs(a - b) for row in rows for a, b in zip(row, row[1:], strict=False)) / (63 * len(rows))
        entropy = -sum(p * np.log2(p) for p in (flat.count(x) / len(flat) for x in set(flat)))
        got = dict(x.split("=") for x in r.feature.split(";"))
        want = {"h": len(rows), "mean": mean, "sd": sd, "entropy": entropy, "zero": flat.count(0) / len(flat), "step": step}
        assert got.keys() == want.keys() and all(abs(float(got[k]) - want[k]) < 1e-4 for k in want)
        assert r.media_bytes == len(png) and r.media_sha256 == hashlib.sha256(png).hexdigest()


def test_no_media(spark, empty):
    folder = new_dir(spark, "media-none")
    media.write_media(empty, folder)
    assert media.media_features(media.read_media(spark, folder)).count() == 0


# -- pseudonyms ------------------------------------------------------------------------


@pytest.mark.parametrize("n", [2, 7, 100, 257, 10_000])
def test_feistel_is_a_permutation(n):
    f = pii.Feistel(b"k")
    out = [f.forward(x, n, b"t") for x in range(n)]
    assert sorted(out) == list(range(n)) and [f.back(x, n, b"t") for x in out] == list(range(n))


CARD = "4539 1488 0343 6467"
VALUES = {
    "card": [CARD, "4539148803436467", "3782 822463 10005", "4539-1488-0343-6467"],
    "iban": ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "FR1420041010050500013M02606"],
    "phone": ["+1 (017) 555-7713", "(212) 555-0199", "212-555-0199", "+49 30 1234567", "06 12 34 56 78", "0171 5557713"],
    "ip": ["97.51.17.173", "2001:db8::8a2e:370:7334", "FE80:0:0:0:202:B3FF:FE1E:8329"],
    "ssn": ["078-05-1120"],
    "date": ["2024-02-29", "2024-02-29T10:00:00", "3.11.1987", "13.11.1987", "11/3/2001", "03/25/2001", "3/25/2001", "03.04.1999"],
    "email": ["die.55@mail4.example.com"],
    "hex": ["04dbebab91ab85687d33eeaaf9ac699e1188f962"],
}


@pytest.mark.parametrize("kind,v", [(k, v) for k, values in VALUES.items() for v in values])
def test_formats_stay_and_inverse_returns(kind, v):
    p, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", inverse=True)
    new, found = p.text(f"see {v}, then {v}.")
    assert [k for k, _ in found] == [kind] * 2 and len({x for _, x in found}) == 1
    name = found[0][1]
    assert name != v and p.text(name)[1][0][0] == kind  # a pseudonym passes the same validation
    assert back.text(new)[0] == f"see {v}, then {v}."
    if kind != "ip" or ":" in v:  # same marks, same number of digits between them
        assert re.sub("[0-9A-Za-z]", "0", new) == re.sub("[0-9A-Za-z]", "0", f"see {v}, then {v}.")


def test_pseudonyms_pass_checks_made_anew():
    p, rng = pii.Pseudonyms(b"other key"), random.Random(3)
    for _ in range(200):
        d = "".join(rng.choice("0123456789") for _ in range(rng.randint(12, 18)))
        right = next(c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d + c))) % 10 == 0)
        for c in "0123456789":
            new, found = p.text(f"no {d}{c} here")
            if c != right:
                assert not found or found[0][0] != "card"
            else:
                digits = found[0][1]
                assert len(digits) == len(d) + 1 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(digits))) % 10 == 0
    iban = p.text("DE89 3704 0044 0532 0130 00")[1][0][1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[:2] == "DE"


@pytest.mark.parametrize("order,widths,shape", [("dm", (1, 2), "{0.day}.{0.month}.{0.year}"), ("dm", (2, 2), "{0.day:02d}/{0.month:02d}/{0.year}"), ("md", (1, 2), "{0.month}/{0.day}/{0.year}")])
def test_dates_of_a_width_are_permuted(order, widths, shape):
    from datetime import date

    p, days = pii.Pseudonyms(b"k"), [date.fromordinal(n) for n in pii.days_of(order, widths)]
    given = [shape.format(d) for d in days[:: max(1, len(days) // 3000)]]
    new = [p.date(s) for s in given]
    assert len(set(new)) == len(new) and all(len(x) == len(y) for x, y in zip(new, given, strict=True))
    assert [pii.Pseudonyms(b"k", inverse=True).date(s) for s in new] == given


def test_spellings_of_a_number_are_linked():
    p = pii.Pseudonyms(b"key")
    digits = lambda s: re.sub(r"\D", "", p.text(s)[0])
    assert digits("+1 (212) 555-0199") == "1" + digits("(212) 555-0199") == "1" + digits("212.555.0199")
    assert digits(CARD) == digits(CARD.replace(" ", "")) == digits(CARD.replace(" ", "-"))
    assert p.text("DE89370400440532013000")[0] == p.text("DE89 3704 0044 0532 0130 00")[0].replace(" ", "")


def test_invalid_values_stay():
    p = pii.Pseudonyms(b"key")
    for v in ("999.1.1.1", "2023-02-30", "000-12-1234", "version 3.1", "12345", "a@b", "10.0.0.1.2", "4539148803436468", "1700000000000", "DE88 3704 0044 0532 0130 00", "03.7.2001", "13/25/2001", "12:30:45", "a::b::c", "std::vector"):
        assert p.text(v) == (v, []), v


def test_pseudonym_rows(frame):
    texts = ODD + ["call +1 (017) 555-7713"] * 2
    df = frame(texts, [None, *range(1, len(texts) - 1), 1])
    out = pii.pseudonymised(df, b"key").collect()
    assert len(out) == len(texts) and out[0].text is None and [r.text for r in out[1:8]] == texts[1:8]
    assert out[-1].text == out[-2].text != texts[-1] and out[-1].n_phone == 1
    assert pii.pseudonymised(df.limit(0), b"key").count() == 0


def test_shards_roll_at_a_fixed_size(spark, frame, prose, monkeypatch):
    """A task that has more than a shard holds goes on with the next; starts count on over all of them."""
    given = [prose(40 + i % 7, i) for i in range(60)]
    whole = sorted(map(tuple, packing.packed_ids(frame(given), packing.word_bpe()).collect()))
    monkeypatch.setattr(packing, "MANY", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        shards = packing.write_shards(frame(given), new_dir(spark, "rolled"), packing.word_bpe(), 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert shards.where("place > 0").count() and shards.agg({"n_docs": "sum"}).first()[0] == 60
    assert sorted(map(tuple, packing.read_shards(shards).collect())) == whole


PHONES = [
    "+49 171 5557713", "+491715557713", "0171 5557713", "06 12 34 56 78", "212-555-0199", "+33 6 12 34 56 78", "0612345678", "(030) 1234567", "1-212-555-0199", "2125550199",
    "212 555 0199", "(212) 555-0199", "+1 212 555 0199", "+44 20 7946 0958", "+39 06 698 12345", "030/1234567", "123-456-7890",
]
OTHERS = ["jürgen.müller@web.de", "Ана@primer.example.com", "ΑΒΓ-1@example.org", "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "078-05-1120", "2001-02-28", "03.07.2001", "192.168.0.1", "d41d8cd98f00b204e9800998ecf8427e"]


def test_every_format_inverts_under_any_key():
    for k in range(300):
        there, back = pii.Pseudonyms(b"key %d" % k), pii.Pseudonyms(b"key %d" % k, inverse=True)
        for value in PHONES + OTHERS:
            text, found = there.text(f"of {value} now")
            again, same = back.text(text)
            assert again == f"of {value} now" and len(found) == len(same) == 1, (k, value, text)
            assert found[0][0] == same[0][0] and (found[0][0] == "ip" or len(text) == len(again))


def test_numbers_are_linked_in_every_spelling():
    flat = lambda s: re.sub(r"\D", "", pii.Pseudonyms(b"k").text(s)[0])
    assert len({flat(s)[-10:] for s in ("212-555-0199", "1-212-555-0199", "2125550199", "212 555 0199", "(212) 555-0199", "+1 212 555 0199", "+12125550199")}) == 1
    assert flat("+49 171 5557713") == flat("+491715557713") and flat("06 12 34 56 78") == flat("0612345678")


def test_long_tokens_and_numbers_that_are_none(spark, frame):
    given = ["a" * 10_000 + "@web.de", "ü" * 300 + "@" + "b" * 300 + ".de", "in 1999 2004 300 4000", "order 1234567890", "555 555 55555", "1 212 555 0199 7", "0" * 5000]
    rows = {r["doc_id"]: r for r in pii.pseudonymised(frame(given), b"k").collect()}
    assert [rows[i]["n_values"] for i in range(len(given))] == [1, 1, 0, 0, 0, 0, 0]
    assert all(len(rows[i]["text"]) == len(t) for i, t in enumerate(given)) and rows[0]["text"] != given[0]


def test_permutation_against_a_second_version():
    """A network of ten rounds over pairs of digits of base m, written down again."""
    import hashlib

    def plain(key, x, n, tweak):
        m = next(m for m in range(1, n + 1) if m * m >= n) if n < 1 << 30 else 1 << (n.bit_length() + 1) // 2
        size = (m.bit_length() + 71) // 8
        mark = hashlib.sha256(len(tweak).to_bytes(8, "big") + tweak + n.to_bytes((n.bit_length() + 7) // 8, "big")).digest()
        while True:
            left, right = x // m, x % m
            for i in range(10):
                word = hashlib.shake_256(key + bytes([i]) + mark + right.to_bytes(size, "big")).digest(size)
                left, right = right, (left + int.from_bytes(word, "big")) % m
            x = left * m + right
            if x < n:
                return x

    for n in (2, 7, 1000, 12_345, 1 << 64, 10**17):
        for x in (0, 1, n // 2, n - 1):
            assert pii.Feistel(b"key").forward(x, n, b"t" * 400) == plain(b"key", x, n, b"t" * 400)
    number = plain(b"key", 1715557713, 10**10, b"phone49")
    while number < 10**9 or pii.north_american(str(number)):
        number = plain(b"key", number, 10**10, b"phone49")
    assert pii.Pseudonyms(b"key").phone("+49 171 5557713") == f"+49 {str(number)[:3]} {str(number)[3:]}"
