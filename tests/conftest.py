import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_sql(spark, small):
    """Holds a registered query against its SQL on the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")

    def plain(x):
        if x is None or x != x:
            return None
        return repr(float(x) + 0.0) if isinstance(x, float) else x

    def check(query, sql):
        df = query(spark, small)
        cols = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        cur = con.execute(sql)
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
        assert got == want

    return check
