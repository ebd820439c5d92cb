import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the Python workers

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if value != value else f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="session")
def same_rows(spark, folder, duck):
    """Asserts that a query and its SQL give the same rows, whatever their order."""

    def check(query, sql):
        df = query(spark, folder)
        names = sorted(df.columns)
        got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
        res = duck.execute(sql)
        heads = [d[0] for d in res.description]
        assert sorted(heads) == names
        want = [tuple(plain(dict(zip(heads, r))[c]) for c in names) for r in res.fetchall()]
        key = lambda t: tuple("" if x is None else x for x in t)
        assert sorted(got, key=key) == sorted(want, key=key)

    return check
