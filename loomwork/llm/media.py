"""Media columns: a data source over directories of archives.

An archive is a plain zip file of stored (not compressed) members. A member is a
lossless image: a payload of bytes as 8-bit grey samples, 64 to a row. Members lie one
behind the other; the archive's directory is at its end.

Reading: partitions are byte ranges of archives, planned from file sizes alone, like the
splits of any file format. A task reads the directory of its archive and takes the members
that begin in its range, so each member is read once whatever the range. Payloads go to
Spark as Arrow batches of bounded size. A member that fails to read, or whose checksum is
wrong, is read again at its own offset, up to `retries` times, without its neighbours; if
it still fails, so does the task.

Writing: each task writes its own archives, a new one beyond `archive_bytes`. Only what
tasks report in the end is listed in the manifest, so files of failed attempts don't count.

Nulls: a null text is an empty one, whose payload is 64 bytes of 0. Equal texts give
equal bytes and features. A null id is kept. Repeated rows are members of their own. A
directory without members reads as an empty table.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from loomwork.llm.common import new_dir, table, until_end
from loomwork.llm.files import opened, resolve
from loomwork.llm.text import slices

ROW = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLUMNS = "doc_id long, archive string, offset long, attempts int, media binary"


# -- the image form --------------------------------------------------------------------


def payload(raw: bytes) -> bytes:
    """Filled with 0 up to a positive multiple of 64."""
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(raw: bytes, level: int = 4) -> bytes:
    """The payload of these bytes as PNG: 8-bit grey, 64 wide, no row filter; a text chunk keeps their number."""
    data = payload(raw)
    rows = np.zeros((len(data) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(rows, level)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """The grey samples, one row of 64 for each line of the image, and the number of bytes before the filling."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, body, given = 8, None, [], None
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"tEXt" and data.startswith(b"Bytes\0"):
            given = int(data[6:])
        at += 12 + n
    if size is None or size[0] != ROW or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not of this form")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], ROW + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter is set")
    samples = np.ascontiguousarray(rows[:, 1:])
    return samples, samples.size if given is None else given


def feature(samples: np.ndarray) -> str:
    """Height, mean and deviation of the samples, entropy of their histogram, share of 0, and mean step along rows."""
    n = samples.size
    counts = np.bincount(samples.ravel(), minlength=256)
    p = counts[counts > 0] / n
    total = int(counts @ np.arange(256))
    spread = int(counts @ np.arange(256) ** 2) / n - (total / n) ** 2
    step = int(np.abs(np.diff(samples.astype(np.int16), axis=1)).sum()) / (len(samples) * (ROW - 1))
    return f"h={len(samples)};mean={total / n:.4f};sd={max(spread, 0) ** 0.5:.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};zero={counts[0] / n:.4f};step={step:.4f}"


# -- archives --------------------------------------------------------------------------


class ArchiveWriter:
    """Members one by one into zip files of about `most` bytes."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.done, self.zip = folder, most, [], None

    def add(self, doc_id: int | None, media: bytes) -> None:
        if self.zip is None:
            self.path = f"{self.folder}/media-{uuid.uuid4().hex}.zip"
            self.context = opened(self.path, "w")
            self.file = self.context.__enter__()
            self.zip, self.size, self.n = zipfile.ZipFile(_Stream(self.file), "w", zipfile.ZIP_STORED), 0, 0
        info = zipfile.ZipInfo(f"{self.n:08d}-{'' if doc_id is None else doc_id}.png")
        self.zip.writestr(info, media)
        self.n, self.size = self.n + 1, self.size + len(media)
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if self.zip is not None:
            self.zip.close()
            self.context.__exit__(None, None, None)
            self.done.append((self.path, self.n))
            self.zip = None


class _Stream(io.RawIOBase):
    """Only write(), so that zipfile writes from front to back."""

    def __init__(self, file):
        self.file = file

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.file.write(data)
        return len(data)

    def flush(self) -> None:
        pass


@dataclass
class Committed(WriterCommitMessage):
    archives: list


@dataclass
class ByteRange(InputPartition):
    path: str
    begin: int
    end: int


class MediaArchives(DataSource):
    """format("media_archives"): options path, range_bytes, archive_bytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema):
        return MediaReader(self.options)

    def writer(self, schema, overwrite):
        return MediaWriter(self.options)


class MediaWriter(DataSourceArrowWriter):
    """Takes rows (doc_id, text)."""

    def __init__(self, options: dict):
        self.folder, self.most = options["path"], int(options.get("archive_bytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        out = ArchiveWriter(self.folder, self.most)
        for b in slices(iterator):
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                out.add(doc_id.as_py(), encode((text.as_py() or "").encode("utf-8")))
        out.close()
        return Committed(out.done)

    def commit(self, messages) -> None:
        with opened(f"{self.folder}/manifest-{uuid.uuid4().hex}.json", "w") as f:
            f.write(json.dumps([path for m in messages if m is not None for path, _ in m.archives]).encode())

    def abort(self, messages) -> None:
        """Archives without a manifest are never read; those of tasks that had finished go, as far as they can be reached."""
        for m in messages:
            for path, _ in m.archives if m is not None else ():
                with contextlib.suppress(OSError):
                    fs, at = resolve(path)
                    fs.delete_file(at)


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.range, self.retries = options["path"], int(options.get("range_bytes", 16 << 20)), int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        """Ranges of the archives that manifests list. The driver sees names and sizes only."""
        import pyarrow.fs as pafs

        fs, base = resolve(self.folder)
        listed = []
        for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if info.base_name.startswith("manifest-") and info.base_name.endswith(".json"):
                with fs.open_input_file(info.path) as f:
                    listed += json.loads(f.read())
        sizes = {path: resolve(path)[0].get_file_info(resolve(path)[1]).size for path in listed}
        found = [ByteRange(path, a, min(a + self.range, n)) for path, n in sorted(sizes.items()) for a in range(0, n, self.range)]
        return found or [ByteRange("", 0, 0)]  # Spark asks for one at least

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        members = [m for m in self.directory(partition.path) if partition.begin <= m.header_offset < partition.end]
        rows, size = [], 0
        try:
            for m in members:
                media, attempts = self.member(partition.path, m)
                name = m.filename[9:-4]
                rows.append((int(name) if name else None, partition.path, m.header_offset, attempts, media))
                size += len(media)
                if size >= 2 << 20:
                    yield self.batch(rows)
                    rows, size = [], 0
        finally:
            self.leave()
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list) -> pa.RecordBatch:
        kinds = (("doc_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("attempts", pa.int32()), ("media", pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    _open = None

    def leave(self) -> None:
        if self._open is not None:
            self._open.close()
            self._open = None

    def fetch(self, path: str, offset: int, size: int) -> bytes:
        """A member's bytes, behind its local header."""
        if self._open is None:
            fs, at = resolve(path)
            self._open = fs.open_input_file(at)
        self._open.seek(offset)
        head = self._open.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise OSError("no member begins here")
        names, extra = struct.unpack("<HH", head[26:30])
        self._open.seek(offset + 30 + names + extra)
        return self._open.read(size)

    def again(self, what: str, attempt_once):
        """The result of the first attempt that doesn't fail, and its number."""
        for attempt in range(1, self.retries + 2):
            try:
                return attempt_once(), attempt
            except (OSError, zipfile.BadZipFile) as e:
                last = e
            self.leave()  # the next attempt opens the archive anew
        raise OSError(f"{what} can't be read after {self.retries + 1} attempts: {last}")

    def directory(self, path: str) -> list[zipfile.ZipInfo]:
        def once() -> list[zipfile.ZipInfo]:
            with opened(path) as f, zipfile.ZipFile(f) as z:
                return z.infolist()

        return self.again(f"{path}: the directory", once)[0]

    def member(self, path: str, m: zipfile.ZipInfo) -> tuple[bytes, int]:
        def once() -> bytes:
            data = self.fetch(path, m.header_offset, m.compress_size)
            if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
                raise OSError("its checksum is wrong")
            return data

        return self.again(f"{path}: the member at {m.header_offset}", once)


# -- the operator ----------------------------------------------------------------------


def write_media(docs: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> None:
    """documents(doc_id, text) into archives."""
    docs.sparkSession.dataSource.register(MediaArchives)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.write.format("media_archives").option("path", folder).option("archive_bytes", archive_bytes).mode("append").save()


def read_media(spark, folder: str, range_bytes: int = 16 << 20, retries: int = 3) -> DataFrame:
    """(doc_id, archive, offset, attempts, media)."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("range_bytes", range_bytes).option("retries", retries).load(folder)


def media_features(media: DataFrame) -> DataFrame:
    """Decode each image; digests of its payload and its stored form, and its feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column("media"):
                m = m.as_py()
                samples, n = decode(m)
                raw = samples.tobytes()
                rows.append((n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-ROW:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x) for x in zip(*rows, strict=True))], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_media(spark, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "media")
    write_media(table(spark, sf_dir, "documents"), folder)
    until_end(spark, folder)
    return media_features(read_media(spark, folder))
