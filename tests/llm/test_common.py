import pytest

from pricelode.llm import common


@pytest.mark.parametrize("least", [1, 64, 10**6])
def test_spread_join_is_a_left_join(spark, monkeypatch, least):
    """Hot keys, keys without a partner, null keys and repeated rows; whatever counts as hot."""
    monkeypatch.setattr(common, "HOT_ROWS", least)
    key = "case when id % 3 = 0 then 7 when id % 3 = 1 then null when id % 5 = 0 then 9 else id end as k"
    left = spark.range(3000).selectExpr(key, "id % 10 as v")
    right = spark.createDataFrame([(7, "seven"), (11, "eleven"), (None, "none")], "k long, name string")
    left, right = common.written(left, "left"), common.written(right, "right")
    want = sorted(map(str, left.join(right, "k", "left").collect()))
    found = common.spread_join(left, right, "k")
    assert found.columns == ["k", "v", "name"] and sorted(map(str, found.collect())) == want and len(want) == 3000


def test_hot_keys_are_few():
    for rows in (0, 100, 10**5, 10**9):
        assert common.hot_limit(rows) * common.HOT_SHARE >= rows - common.HOT_SHARE


def test_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://elsewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}  # noqa: RUF012

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session(), "x")
