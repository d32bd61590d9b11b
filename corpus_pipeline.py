"""From raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns the columns of documents; the last returns what its files hold. run() writes the
result of each stage to the shared folder and reads it again for the next.

Nulls, repeats, ties and empty tables are as each stage's operator defines them: a null text is an empty one, which is not toxic, is a copy of
other empty texts, leaks nothing, and has the end id alone; null ids stay, and are left as a class's only if it has no other; of a class of near duplicates the row of the
least id stays; a source of null is one of its own; an empty table of documents goes through to no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm.common import new_dir, remainder, removed, scratch, table, until_end
from loomwork.llm.decontamination import without_leaks
from loomwork.llm.mixing import in_mixed_order, mixture
from loomwork.llm.neardup import without_duplicates
from loomwork.llm.packing import packed_ids, word_bpe
from loomwork.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return without_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources come again, up to twice; every document comes once at least."""
    return mixture(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids to packed files, in a permutation of all rows of the mixture, and what these hold."""
    return packed_ids(in_mixed_order(docs), word_bpe(), order="mixed_order")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]

#: SQL can't express the models of the first stage; the tests hold the others, one by one, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that a stage makes on its way go once its result is written, and this once the next stage's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = new_dir(spark, f"stage-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
        if before:
            removed(spark, before)
        before = folder
    until_end(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
