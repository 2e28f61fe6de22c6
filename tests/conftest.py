import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canonical, v)) + "]"
    return repr(float(v)) if isinstance(v, float) else str(v)


def same_rows(df, con, sql):
    cols = sorted(df.columns)
    got = sorted(tuple(canonical(r[c]) for c in cols) for r in df.collect())
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    want = sorted(tuple(canonical(dict(zip(names, r, strict=True))[c]) for c in cols) for r in res.fetchall())
    assert sorted(names) == cols
    assert got == want


@pytest.fixture(scope="session")
def compare(duck):
    return lambda df, sql: same_rows(df, duck, sql)
