"""Writing a table in another format and reading it again, with a declared schema and no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.shared import new_folder, until_end
from loomwork.tables import load


def through(df: DataFrame, form: str, partition_by: str | None = None, **options) -> DataFrame:
    """The table, written as `form` under the shared folder and read back."""
    spark = df.sparkSession
    path = new_folder(spark, form)
    writer = df.write.format(form).options(**options)
    (writer.partitionBy(partition_by) if partition_by else writer).save(path)
    until_end(spark, path)
    return spark.read.format(form).schema(df.schema).options(**options).load(path).select(df.columns)


def part_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(load(spark, sf_dir, "part"), "json")


def customer_as_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(load(spark, sf_dir, "customer"), "csv", header="true", escape='"')


def supplier_as_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(load(spark, sf_dir, "supplier"), "orc")


def orders_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status of a table partitioned by it: only that folder is read."""
    return through(load(spark, sf_dir, "orders"), "parquet", "o_orderstatus").where("o_orderstatus = 'F'")


QUERIES = {"part_as_json": part_as_json, "customer_as_csv": customer_as_csv, "supplier_as_orc": supplier_as_orc, "orders_by_status": orders_by_status}
ORACLES = {"part_as_json": "select * from part", "customer_as_csv": "select * from customer", "supplier_as_orc": "select * from supplier", "orders_by_status": "select * from orders where o_orderstatus = 'F'"}
