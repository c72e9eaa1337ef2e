import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def normal(v):
    """Values as Spark and DuckDB both give them."""
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def same(spark):
    """Compare a query with its SQL over the tables of a folder."""
    from collections import Counter
    from pathlib import Path

    import duckdb

    def run(query, sql, folder):
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
        found = query(spark, str(folder))
        cols = sorted(found.columns)
        want = con.execute(sql)
        names = [x[0] for x in want.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = Counter(tuple(normal(r[i]) for i in at) for r in want.fetchall())
        got = Counter(tuple(normal(r[c]) for c in cols) for r in found.collect())
        assert got == want, (list((got - want).items())[:2], list((want - got).items())[:2])

    return run
