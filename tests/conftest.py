import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the Python workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(rows):
    clean = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else str(x)
    return sorted(tuple(map(clean, r)) for r in rows)


@pytest.fixture
def held(spark, tmp_path):
    """Runs a query of a module and its SQL over tables given as (schema, rows), and gives the rows."""
    import duckdb

    from loomwork import relational

    def run(name, module=relational, **tables):
        con = duckdb.connect()
        for table, (schema, rows) in tables.items():
            path = f"{tmp_path}/{table}.parquet"
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
            con.execute(f"create or replace view {table} as select * from '{path}/*.parquet'")
        df = module.QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        got = con.execute(module.ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        ours = plain(tuple(r[c] for c in columns) for r in df.collect())
        assert ours == plain(tuple(r[names.index(c)] for c in columns) for r in got.fetchall())
        return ours

    return run
