"""Semi-structured values as variants: JSON text that is parsed once, and typed access by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.tables import load

#: Variant types by the first word of their schema, with the whole numbers under one name.
NAMES = {"BIGINT": "integer", "DECIMAL": "decimal", "DOUBLE": "decimal", "STRING": "string", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array", "VOID": "null"}


def kind(v: Column) -> Column:
    """The name of a variant's type; null if there is none."""
    first = F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)
    return F.coalesce(*(F.when(first == k, name) for k, name in NAMES.items()), F.lower(first))


def typed(v: Column, path: str) -> dict[str, Column]:
    """What is at a path: its type, and its value as text, as a whole number and as a double where it is of that kind or can be read as one."""
    at = F.try_variant_get(v, path, "variant")
    return {"kind": kind(at), "text": F.try_variant_get(v, path, "string"), "whole": F.try_variant_get(v, path, "bigint"), "real": F.try_variant_get(v, path, "double")}


def props_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind and by the type of `$.k` in their properties: how many, their least and greatest value, and those whose JSON is broken or missing.

    Broken JSON is no error and counts as `bad`, no text at all as `missing`; both are without a type, as is JSON without the path.
    """
    e = load(spark, sf_dir, "events").select("event_type", "props", F.try_parse_json("props").alias("v"))
    k = typed(F.col("v"), "$.k")
    rows = e.select("event_type", k["kind"].alias("kind"), k["whole"].alias("whole"), F.col("props").isNull().alias("missing"), (F.col("props").isNotNull() & F.col("v").isNull()).alias("bad"))
    number = F.when(F.col("kind") == "integer", F.col("whole"))
    return rows.groupBy("event_type", "kind").agg(F.count("*").alias("n"), F.count_if("missing").alias("missing"), F.count_if("bad").alias("bad"), F.min(number).alias("least"), F.max(number).alias("greatest"), F.sum(number).cast("long").alias("total"))


def nested_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's properties put into a nested object with its value and kind, as a variant, and read back by path: fields, elements and what isn't there."""
    e = load(spark, sf_dir, "events")
    made = F.to_json(F.struct(F.struct(F.col("event_type").alias("type"), F.array("event_id", F.col("user_id")).alias("ids")).alias("event"), F.col("props").alias("raw")), {"ignoreNullFields": "false"})
    v = F.parse_json(made)
    inner = F.try_parse_json(F.try_variant_get(v, "$.raw", "string"))
    return e.select(v.alias("v"), inner.alias("inner")).select(
        F.try_variant_get("v", "$.event.ids[0]", "bigint").alias("event_id"), F.try_variant_get("v", "$.event.ids[1]", "bigint").alias("user_id"), F.try_variant_get("v", "$.event.type", "string").alias("event_type"),
        F.try_variant_get("inner", "$.k", "bigint").alias("k"), F.try_variant_get("v", "$.event.ids[2]", "bigint").alias("nothing"),
    )


QUERIES = {"props_by_type": props_by_type, "nested_props": nested_props}
ORACLES = {
    "props_by_type": """
with e as (select event_type, props, case when json_valid(props) then json_extract(props, '$.k') end as k from events),
t as (select event_type, props, k, case json_type(k) when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'decimal' when 'VARCHAR' then 'string'
             when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then 'null' end as kind from e)
select event_type, kind, count(*) as n, count(*) filter (where props is null) as missing, count(*) filter (where props is not null and not json_valid(props)) as bad,
       min(try_cast(k as bigint)) filter (where kind = 'integer') as least, max(try_cast(k as bigint)) filter (where kind = 'integer') as greatest, cast(sum(try_cast(k as bigint)) filter (where kind = 'integer') as bigint) as total
from t group by event_type, kind""",
    "nested_props": """
select event_id, user_id, event_type, case when json_valid(props) then try_cast(json_extract_string(props, '$.k') as bigint) end as k, cast(null as bigint) as nothing from events""",
}
