import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("OMP_NUM_THREADS", "1")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A DuckDB connection with the small tables as views."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return con


@pytest.fixture
def same(spark, duck, tmp_path):
    """Whether a query and its SQL give the same rows."""

    def check(query, sql: str) -> None:
        query(spark, SMALL).write.parquet(str(tmp_path / "out"))
        ours = duck.sql(f"select * from '{tmp_path}/out/*.parquet'")
        theirs = duck.sql(sql)
        names = sorted(theirs.columns)
        assert sorted(ours.columns) == names
        quoted = ", ".join(f'"{n}"' for n in names)
        assert sorted(map(repr, ours.project(quoted).fetchall())) == sorted(map(repr, theirs.project(quoted).fetchall()))

    return check
