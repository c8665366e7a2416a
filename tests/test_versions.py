"""Bucketed tables: what merges exchange, and jobs that die."""

import re

import pytest

from pricelode.operators import merge
from pricelode.sources import versions


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, price double, note string")


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_exchanges_only_what_comes_in(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.create(table(spark, [(i, float(i), "old") for i in range(100)]), path, ["k"], 6)
    incoming = spark.createDataFrame([(i, 50.0, None) for i in range(90, 110)], "k int, price double, note string")
    policies = {"price": merge.LEAST, "note": merge.KEEP}
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for partitions in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            plan = versions.merged(spark, path, incoming, policies)._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Bucketed: true" in plan, plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    versions.merge(spark, path, incoming, policies)
    want = [(i, min(float(i), 50.0) if i >= 90 else float(i), "old") for i in range(100)] + [(i, 50.0, None) for i in range(100, 110)]
    assert content(versions.read(spark, path)) == sorted(want, key=str)
    files = [f for f in versions.read(spark, path).inputFiles()]
    assert len(files) == 6  # a file for each bucket, after a merge too
    assert versions.drop_old(spark, path) == 1 and content(versions.read(spark, path)) == sorted(want, key=str)


def test_a_job_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.create(table(spark, [(1, 1.0, "a"), (2, None, None)]), path, ["k"], 2)
    old = content(versions.read(spark, path))

    def die(*_):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(versions, "_name_current", die)
        with pytest.raises(OSError, match="lost"):
            versions.merge(spark, path, table(spark, [(1, 9.0, "b")]), {"price": merge.NEW, "note": merge.NEW})
    assert content(versions.read(spark, path)) == old
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        versions.merge(spark, path, table(spark, [(1, 9.0, "b")]).selectExpr("k", "1 div (k - 1) as price", "note"), {"price": merge.NEW, "note": merge.NEW})
    assert content(versions.read(spark, path)) == old
    versions.merge(spark, path, table(spark, [(1, 9.0, None), (None, 3.0, "n")]), {"price": merge.NEW, "note": merge.NEW})
    assert content(versions.read(spark, path)) == sorted([(1, 9.0, None), (2, None, None), (None, 3.0, "n")], key=str)
    assert versions.drop_old(spark, path) == 2  # the first, and the one that was written in full; a write that fails leaves no folder


def test_read_in_a_session_that_knows_no_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.create(table(spark, [(i, 1.0, "x") for i in range(10)]), path, ["k", "note"], 3)
    name = versions._described(spark, path)["version"]
    spark.sql(f"DROP TABLE {name}")
    assert versions.read(spark, path).count() == 10
    plan = versions.read(spark, path).groupBy("k", "note").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
