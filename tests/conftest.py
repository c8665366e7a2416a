import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tables import DATA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def canonical(rows):
    """Rows (dicts) as comparable, sorted tuples."""
    import datetime
    import decimal
    import math

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9)
        if isinstance(v, decimal.Decimal):
            return round(float(v), 9)
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None).isoformat()
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return v

    return sorted((tuple(plain(r[k]) for k in sorted(r)) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    """A DuckDB connection with the tables of sf0.001 as views."""
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for path in (DATA / "sf0.001").glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="session")
def compare(spark, duck):
    """Does a query give what its SQL gives, with the same column names?"""

    def check(query, sql):
        got = query(spark, str(DATA / "sf0.001"))
        want = duck.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(names)
        assert canonical(r.asDict() for r in got.collect()) == canonical(dict(zip(names, r, strict=True)) for r in want.fetchall())

    return check
