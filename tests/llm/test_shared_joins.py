"""Tables that were counted as too large aren't broadcast, whatever Spark takes their size to be."""

from meridex.llm.shared import large, salted, small, stored


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_sides_are_shuffled(spark):
    left = stored(spark.range(2000).selectExpr("id % 100 as k", "id as x"), "left")
    right = stored(spark.range(100).selectExpr("id as k", "array_repeat(id, 50) as many"), "right")  # a few kB of Parquet
    wide = right.selectExpr("k", "explode(many) as m")
    assert "Broadcast" in plan(left.join(right, "k"))  # what Spark itself would do
    for joined, rows in ((salted(left, right, "k", "x", rows=10), 2000), (left.join(small(right, 10), "k"), 2000), (left.join(large(wide), "k"), 100_000)):
        assert "Broadcast" not in plan(joined) and joined.count() == rows
    for joined in (salted(left, right, "k", "x", rows=100), left.join(small(right, 100), "k")):
        assert "Broadcast" in plan(joined) and joined.count() == 2000
