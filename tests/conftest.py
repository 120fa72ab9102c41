import numbers
import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    """Values of either engine in one form."""
    if value is None or value is pd.NA or value != value:
        return "NULL"
    if isinstance(value, (bool, np.bool_)):
        return str(value)
    if isinstance(value, numbers.Number):
        return f"{float(value):.6f}"
    return str(value).replace(" 00:00:00", "")


def same(ours, theirs):
    """Whether two pandas tables have the same columns and rows, in any order."""
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (sorted(tuple(plain(v) for v in row) for row in x[columns].itertuples(index=False)) for x in (ours, theirs))
    assert a == b
