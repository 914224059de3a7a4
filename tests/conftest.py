import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    found = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return found


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    def plain(rows):
        return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)

    def check(query, sql):
        got = query(spark, DATA)
        names = sorted(got.columns)
        quoted = ", ".join(f'"{c}"' for c in names)
        want = duck.sql(f"SELECT {quoted} FROM ({sql}) q").fetchall()
        assert plain(tuple(r) for r in got.select(*names).collect()) == plain(want)

    return check
