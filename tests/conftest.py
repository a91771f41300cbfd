from __future__ import annotations

import math
import sys
import tempfile
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    own = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    """Values that both engines write alike."""
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value if value is None or isinstance(value, (int, str, bool)) else str(value) if not hasattr(value, "__float__") else round(float(value), 6) + 0.0


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Compare a query's rows with its SQL's, as multisets."""

    def check(query, sql: str) -> None:
        df = query(spark, SMALL)
        columns = sorted(df.columns)
        got = Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        want = Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])

    return check
