"""What several operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without one, a temporary folder, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomwork-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_open: list[list[str]] = []


def new_dir(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(folder)
    return folder


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders of the shared folder that are made inside go at the end: whatever is to stay must have been written by then."""
    folders: list[str] = []
    _open.append(folders)
    try:
        yield
    finally:
        _open.pop()
        for folder in folders:
            removed(spark, folder)


def until_end(spark: SparkSession, folder: str) -> None:
    """The folder goes when the application ends: what reads it may still be asked for until then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = new_dir(spark, name)
    df.write.parquet(folder)
    until_end(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(-1))


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, most_bytes: int = 1 << 26) -> DataFrame:
    """(doc_id, text, label) of at most about `most` labelled documents and `most_bytes` of text, drawn by a hash of the id.

    The first bound is what makes the broadcast of the drawn ids safe. A document with
    several labels takes the largest; null labels and ids are left out.
    """
    share = lambda bound, found: int(min(1.0, bound / max(1, found)) * (1 << 20))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20))
    rows = labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    drawn = share(most, rows.count())
    rows = rows.where(draw < drawn)
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    size = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return found if size <= most_bytes else found.where(draw < drawn * most_bytes // size)
