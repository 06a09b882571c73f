"""One local session for all tests, and a comparison with DuckDB."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Python workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    s = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows_of(frame):
    """Rows in an order of their own, columns by name, floats rounded."""
    import pandas as pd

    def cell(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return None
        if isinstance(v, float):
            return int(v) if v == int(v) else round(v, 6)
        if hasattr(v, "item"):
            return cell(v.item())
        return str(v) if not isinstance(v, (int, bool)) else v

    columns = sorted(frame.columns)
    return columns, sorted((tuple(cell(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.fixture
def same_as_sql(spark, duck):
    def check(run, sql):
        assert rows_of(run(spark, SF).toPandas()) == rows_of(duck.execute(sql).df())

    return check
