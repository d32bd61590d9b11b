"""Token ids in fixed-width bit packing.

A shard file holds the ids of consecutive documents, up to a fixed size, so a task of any size holds one shard in memory. Each id takes the least number
of bits that the vocabulary needs, lowest bit first; ids go in blocks of `BLOCK`, each
starting on a byte, so a block's offset gives random access and numpy unpacks it whole.

    magic 8 bytes | bits u32 | block u32 | documents u64 | ids u64 | blocks u64
    doc_id i64 x documents | doc_id is not null u8 x documents
    end of each document in ids u64 x documents
    offset of each block in the payload u64 x blocks
    payload

Documents are dealt to shards by ranges of doc_id, so shards hold ascending ids (or by
another column, which gives their order), and a shard's first id position is the sum of the shards before it. The only thing gathered
across shards is one count for each shard.

Nulls and ties: a null text is an empty one, so its ids are the end id alone; null ids
come first; equal ids follow each other in the order of their texts' hashes, all kept.
An empty table gives no rows, and shards without documents.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm.common import kept, new_dir, table, until_end
from loomwork.llm.files import opened
from loomwork.llm.text import slices, words

MAGIC, HEAD, BLOCK = b"LWBITS01", struct.Struct("<8sIIQQQ"), 4096
#: A shard closes once its packed ids take so many bytes, or it has so many documents; a task then goes on with the next.
FULL, MANY = 1 << 25, 1 << 20


# -- packing ---------------------------------------------------------------------------


def width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Lowest bit first, filled up to a whole byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} doesn't fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if bits in (8, 16, 32):
        return raw[: n * bits // 8].view(f"<u{bits // 8}").astype(np.uint32)
    flags = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
    return flags.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class ShardWriter:
    """Collects packed blocks; the head needs the counts, so finish() returns the parts in order."""

    def __init__(self, bits: int):
        self.bits, self.parts, self.rest, self.n, self.held = bits, [], np.zeros(0, np.uint32), 0, 0
        self.ids, self.known, self.ends = [], [], []

    def add(self, doc_id: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids.append(doc_id.fill_null(0).to_numpy(zero_copy_only=False))
        self.known.append(doc_id.is_valid().to_numpy(zero_copy_only=False))
        self.ends.append(self.n + np.cumsum(lengths))
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        if whole:  # a block is a whole number of bytes: 4096 ids
            self.parts.append(pack(ids[:whole], self.bits))
            self.held += len(self.parts[-1])
        self.rest = ids[whole:]

    @property
    def docs(self) -> int:
        return sum(map(len, self.ids))

    def finish(self) -> Iterator[bytes]:
        join = lambda parts, kind: np.concatenate([*parts, np.zeros(0)]).astype(kind).tobytes()
        blocks = -(-self.n // BLOCK)
        yield HEAD.pack(MAGIC, self.bits, BLOCK, sum(map(len, self.ids)), self.n, blocks)
        yield from (np.concatenate([*self.ids, np.zeros(0, np.int64)]).astype("<i8").tobytes(), join(self.known, "u1"), np.concatenate([*self.ends, np.zeros(0, np.int64)]).astype("<u8").tobytes())
        yield (np.arange(blocks, dtype="<u8") * np.uint64(BLOCK * self.bits // 8)).tobytes()
        yield from self.parts
        yield pack(self.rest, self.bits)


class Shard:
    """A shard file: ids(a, b) reads only the blocks that hold these positions."""

    def __init__(self, file):
        self.file = file
        magic, self.bits, self.block, docs, self.n, blocks = HEAD.unpack(file.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")
        take = lambda kind, n: np.frombuffer(file.read(n * np.dtype(kind).itemsize), kind)
        self.doc_id, self.known, self.ends = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
        self.offsets = take("<u8", blocks)
        self.base = HEAD.size + docs * 17 + blocks * 8

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        self.file.seek(self.base + int(self.offsets[first]))
        n = min(self.n, (last + 1) * self.block) - first * self.block
        return unpack(self.file.read(-(-n * self.bits // 8)), n, self.bits)[a - first * self.block : b - first * self.block]


# -- encoding --------------------------------------------------------------------------

#: Marks at which the tokenizer always parts a word, whatever stands around them.
_CUT = np.zeros(256, bool)
_CUT[list(b'!"#$%&()*+,-./:;=?@[]^_{}~')] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


#: How a tokenizer must part and fold texts for pieces to stand for themselves.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_piece(tokenizer: dict) -> bool:
    """Of the tokenizer's own JSON: whether it folds and parts texts in the way that Encoder relies on."""
    parts = (tokenizer["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    level = parts[-1].get("type") == "ByteLevel" and not parts[-1]["add_prefix_space"] and not parts[-1]["use_regex"]
    split = len(parts) == 2 and parts[0].get("pattern") == {"Regex": _PARTS} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
    plain = all(t["special"] and t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in tokenizer["added_tokens"])
    return tokenizer["normalizer"] == _NORMAL and split and level and plain and tokenizer["model"]["type"] == "BPE" and not tokenizer["truncation"]


class Encoder:
    """Ids of texts under a word-by-word tokenizer: each distinct piece is encoded once and remembered.

    White space and the border between a plain letter and a mark part pieces in such a
    tokenizer wherever they stand, so a text's ids are those of its pieces in order.
    A piece of Latin letters goes straight to the vocabulary's BPE model, which gives
    what the full path gives; any other takes the full path. Any other tokenizer encodes whole texts.
    """

    MOST = 1_500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.pieces = by_piece(json.loads(self.whole.to_str()))
        self.vocabulary = 1 + max(self.whole.get_vocab(with_added_tokens=True).values())
        self.model = self.whole.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # letters of the byte-level alphabet, as the library maps them
        self.letters = {c: level.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(97, 123), *range(0xDF, 0x100)])}
        self.table = str.maketrans(self.letters)
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.length, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def piece(self, raw: bytes) -> list[int]:
        text = raw.decode("utf-8", "replace")
        low = text.lower()
        if len(low) == len(text) and _PLAIN.fullmatch(low):
            return [t.id for t in self.model.tokenize(low.translate(self.table))]
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, `end` after each text, and the number of ids of each text."""
        if not self.pieces:
            found = [[*e.ids, end] for e in self.whole.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        w = words(column)
        data, starts, ends, doc = w.data, w.starts, w.ends, w.docs()
        letter, mark = _LETTER[data], _CUT[data]
        border = np.zeros(len(data), bool)
        border[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        border[starts] = False
        extra = np.flatnonzero(border)  # only inside words: white space is neither
        owner = np.searchsorted(starts, extra, "right") - 1
        starts, ends = np.sort(np.concatenate([starts, extra])), np.sort(np.concatenate([ends, extra]))
        doc = np.sort(np.concatenate([doc, doc[owner]]))
        fold = data.copy()
        fold[(data >= 65) & (data <= 90)] += 32
        # special tokens are found before lower-casing, so pieces that could hold one keep their case
        bars = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) else starts
        for i in np.unique(np.searchsorted(starts, bars, "right") - 1).tolist():
            fold[starts[i] : ends[i]] = data[starts[i] : ends[i]]
        keys, at, back = np.unique(w.hashes(fold, starts, ends), return_index=True, return_inverse=True)
        self._learn(keys, at, fold, starts, ends)
        i = np.searchsorted(self.keys, keys)
        n = self.length[i][back]
        lengths = np.bincount(doc, weights=n, minlength=len(column)).astype(np.int64) + 1
        # where each piece's ids go: after those before it, and one end id for each text before it
        to = np.cumsum(n) - n + doc
        total = int(lengths.sum())
        out = np.full(total, end, np.uint32)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + step] = self.flat[np.repeat(self.begin[i][back], n) + step]
        return out, lengths

    def _learn(self, keys, at, data, starts, ends) -> None:
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            new = self.keys[i] != keys
        else:
            new = np.ones(len(keys), bool)
        if not new.any():
            return
        if len(self.keys) + int(new.sum()) > self.MOST:  # memory stays bounded; what is dropped is encoded again
            self.clear()
            new[:] = True
        ids = [self.piece(data[a:b].tobytes()) for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, np.fromiter((x for y in ids for x in y), np.uint32, int(n.sum()))])
        merged = np.concatenate([self.keys, keys[new]])
        order = np.argsort(merged, kind="stable")
        self.keys, self.begin, self.length = merged[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.length, n])[order]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, so that tasks share what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# -- the operator ----------------------------------------------------------------------


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end: int, order: str | None = None) -> DataFrame:
    """Encode and write; returns (shard, place, path, n_docs, n_ids) of the shards: the task's number, and the shard's within it. A task that runs again writes new files.

    An id takes as many bits as the largest of the tokenizer, or `end`, needs. Documents go in the order of the
    column `order`, or of their ids.
    """
    bits = width(max(encoder(tokenizer).vocabulary, end + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        place, out = 0, ShardWriter(bits)

        def closed() -> pa.RecordBatch:
            path = f"{folder}/shard-{shard:06d}-{place:06d}-{uuid.uuid4().hex[:12]}.bits"
            with opened(path, "w") as f:
                for part in out.finish():
                    f.write(part)
            row = [pa.array([shard], pa.int32()), pa.array([place], pa.int32()), pa.array([path]), pa.array([out.docs], pa.int64()), pa.array([out.n], pa.int64())]
            return pa.RecordBatch.from_arrays(row, ["shard", "place", "path", "n_docs", "n_ids"])

        for b in slices(batches):
            if out.held >= FULL or out.docs >= MANY:
                yield closed()
                place, out = place + 1, ShardWriter(bits)
            ids, lengths = encoder(tokenizer).encode(b.column("text"), end)
            out.add(b.column("doc_id").cast(pa.int64()), ids, lengths)
        yield closed()

    # rows that tie go by their texts' hashes, of a fixed size as ranges are drawn on the driver, and so are split
    by = [*([order] if order else []), "doc_id", "tie"]
    dealt = docs.select(*by[:-1], "text", F.md5("text").alias("tie")).repartitionByRange(*by).sortWithinPartitions(*by)
    return kept(dealt.select("doc_id", "text").mapInArrow(run, "shard int, place int, path string, n_docs long, n_ids long"), "shards")


def read_shards(shards: DataFrame, doc_id: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                with opened(path) as f:
                    s = Shard(f)
                    begins = np.concatenate([[0], s.ends[:-1]]) if len(s.ends) else s.ends
                    at = 0
                    while at < len(s.ends):  # about a million ids at a time
                        to = max(at + 1, int(np.searchsorted(s.ends, begins[at] + (1 << 20), "right")))
                        ids = s.ids(int(begins[at]), int(s.ends[to - 1])).astype("<u4")
                        cuts = s.ends[at:to] - begins[at]
                        crc = [zlib.crc32(ids[x:y]) for x, y in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
                        known = s.known[at:to] == 0
                        yield pa.RecordBatch.from_arrays([pa.array(s.doc_id[at:to], mask=known), pa.array(base + begins[at:to]), pa.array(s.ends[at:to] - begins[at:to]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        at = to

    # one row a shard: the window's single task sees counts only
    based = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard", "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return based.select("path", "base").repartition("path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast(doc_id))


def packed_ids(docs: DataFrame, tokenizer: str, end: int = 2, order: str | None = None) -> DataFrame:
    """Writes the shards of documents(doc_id, text) and returns what they hold."""
    spark = docs.sparkSession
    folder = new_dir(spark, "bits")
    shards = write_shards(docs, folder, tokenizer, end, order)
    until_end(spark, folder)
    return read_shards(shards, dict(docs.dtypes)["doc_id"])


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packed_ids(spark, sf_dir: str) -> DataFrame:
    return packed_ids(table(spark, sf_dir, "documents"), word_bpe())
