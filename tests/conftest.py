import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Compares rows regardless of order, columns by name, floats to 6 places."""

    def norm(rows, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        value = lambda v: round(v, 6) if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v
        return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)

    def check(df, relation):
        assert sorted(df.columns) == sorted(relation.columns)
        assert norm(df.collect(), df.columns) == norm(relation.fetchall(), relation.columns)

    return check
