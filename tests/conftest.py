import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a query's rows equal its SQL's, columns by name, in any order."""

    def check(query, sql):
        df = query(spark, SF)
        names = sorted(df.columns)
        got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
        found = duck.execute(sql)
        at = [d[0] for d in found.description]
        assert sorted(at) == names
        want = sorted((tuple(r[at.index(c)] for c in names) for r in found.fetchall()), key=str)
        assert got == want
        return len(got)

    return check
