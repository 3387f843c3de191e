import os
import sys
from pathlib import Path

import pytest

TOP = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, TOP)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (TOP, os.environ.get("PYTHONPATH", "")) if x)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def same(spark, data):
    """Compare a query with its oracle, order aside."""
    import duckdb

    def rows(frame, cols):
        def cell(v):
            if v is None or v != v:
                return "NULL"
            return format(v, ".9g") if isinstance(v, float) else str(v)

        return sorted(tuple(map(cell, r)) for r in frame[cols].itertuples(index=False))

    def check(name):
        import __spark_entry__ as entry

        got = entry.queries()[name](spark, data).toPandas()
        db = duckdb.connect()
        for p in Path(data).glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = db.sql(entry.oracle_sql()[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert rows(got, cols) == rows(want, cols)

    return check
