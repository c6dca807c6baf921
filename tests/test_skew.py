"""Split joins against plain ones."""

import pytest
from quillspark.plans.skew import hot_keys, join_one


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_is_a_join(spark, how):
    many = spark.createDataFrame([(i % 7 if i % 3 else 1, i, None if i % 5 else "x") for i in range(900)] + [(None, -1, "n")], "k long, v long, w string")
    one = spark.createDataFrame([(k, f"r{k}") for k in range(6)], "k long, r string")
    got = sorted(map(str, join_one(many, one, ["k"], how, parts=10, least=20).collect()))
    assert got == sorted(map(str, many.join(one, "k", how).collect()))
    hot = hot_keys(many.where("k is not null"), ["k"], parts=10, least=20).collect()
    assert {r.k for r in hot} >= {1} and len(hot) < 10
    assert join_one(many.where("false"), one, ["k"], how).count() == 0
