import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path


def normal(value):
    """A value as both engines agree to write it."""
    import decimal

    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if value != value else round(value, 6) + 0.0
    return None if value is None else value if isinstance(value, bool) else str(value)


def compare(spark, sf_dir, query, sql):
    """Rows of a query and of its SQL as two multisets, columns in order of their names."""
    from collections import Counter

    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{name}')")
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    mine = Counter(tuple(normal(r[n]) for n in names) for r in frame.collect())
    cursor = con.execute(sql)
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == names
    other = Counter(tuple(normal(r[theirs.index(n)]) for n in names) for r in cursor.fetchall())
    return mine, other
