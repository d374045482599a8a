import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def rows(columns, found):
    """Rows as sorted texts, floats to nine digits."""

    def text(v):
        if v is None or v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(text(r[k]) for k in order) for r in found)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Checks a query against its SQL on the small tables."""

    def check(query, sql):
        df = query(spark, SMALL)
        got = rows(df.columns, [tuple(r) for r in df.collect()])
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        want = rows(names, result.fetchall())
        assert sorted(df.columns) == sorted(names)
        assert got == want

    return check
