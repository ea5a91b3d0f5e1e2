"""One key with all rows runs in all tasks and gives the rows of a plain window; exact quantiles against sorting."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meridex.operators import history as H
from meridex.operators import segments as S


def frames():
    n = F.col("n")
    named = F.struct("hour", "n")
    point = F.when(n.isNotNull(), named)
    return {
        "all_before": S.Frame("sum", n, None, -1), "all_until": S.Frame("sum", n, None, 0), "last3": S.Frame("sum", n, -3, -1), "around": S.Frame("max", n, -40, 40), "ahead": S.Frame("min", n, 1, 25),
        "low_before": S.Frame("min", n, None, -1), "high_after": S.Frame("max", n, 1, None), "last": S.Frame("last", point, None, -1), "last_of_rest": S.Frame("last", point, 0, None), "next": S.Frame("first", point, 0, None), "first": S.Frame("first", point, None, -1), "sum_after": S.Frame("sum", n, 1, None),
    }


def rows(seed, keys, n=400, wide=120):
    rnd = random.Random(seed)
    return [(rnd.choice(keys), rnd.randint(0, 3), h, rnd.choice([None, *range(9)])) for h in rnd.sample(range(-wide * 4, wide * 4), n)]


@pytest.mark.parametrize("keys", [[1], [1, 1, 1, 2, None], list(range(30))])
def test_hot_keys_give_the_same_rows(spark, monkeypatch, keys):
    df = spark.createDataFrame(rows(len(keys), keys), "k long, g long, hour long, n long")
    by = lambda names: {n: f.over(names, "hour") for n, f in frames().items()}
    want = sorted(map(repr, df.withColumns(by(["k"])).collect()))
    assert sorted(map(repr, S.with_frames(df, "hour", (["k"], frames())).collect())) == want
    monkeypatch.setattr(S, "HOT_ROWS", 20)
    assert sorted(map(repr, S.with_frames(df, "hour", (["k"], frames())).collect())) == want
    assert sorted(map(repr, S.by_ranges(df, ["k"], "hour", frames()).collect())) == want


def test_several_key_sets_and_whole_tables(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_ROWS", 10)
    df = spark.createDataFrame(rows(5, [1, 1, 1, 1, 2]), "k long, g long, hour long, n long")
    one = {"s": S.Frame("sum", F.col("n"), None, -1)}
    got = S.with_frames(df, "hour", (["k", "g"], one), (["k"], {"t": S.Frame("sum", F.col("n"), -9, -1)}), ([], {"u": S.Frame("sum", F.col("n"), None, -1)}))
    window = lambda *k: Window.partitionBy(*k).orderBy("hour")
    want = df.withColumns({"s": F.sum("n").over(window("k", "g").rangeBetween(H.UNBOUNDED, -1)), "t": F.sum("n").over(window("k").rangeBetween(-9, -1)), "u": F.sum("n").over(window().rangeBetween(H.UNBOUNDED, -1))})
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_hot_key_runs_in_all_tasks(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("hour"), F.lit(1).alias("n"))
    got = S.by_ranges(df, ["k"], "hour", {"s": S.Frame("sum", F.col("n"), None, -1), "w": S.Frame("sum", F.col("n"), -24, -1)})
    assert got.where("s <> hour or w <> least(hour, 24)").where("hour > 0").count() == 0
    per = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) == 4 and max(per) < 2000


def test_frames_that_ranges_cannot_give(spark):
    df = spark.range(3).select(F.lit(1).alias("k"), F.col("id").alias("hour"))
    for low, high in ((None, None), (None, 1), (-1, None)):
        with pytest.raises(ValueError):
            S.with_frames(df, "hour", (["k"], {"s": S.Frame("sum", F.col("hour"), low, high)}))


def test_operators_with_hot_keys(spark, monkeypatch):
    """Every operator on history gives the same by ranges, ties of hours and hours without events included."""
    rnd = random.Random(2)
    counts = spark.createDataFrame([(e, h, rnd.randint(1, 4)) for e in (1, 2) for h in sorted(rnd.sample(range(900), 150 if e == 1 else 9))], "entity long, hour long, n long")
    obs = spark.createDataFrame([(e, h) for e in (1, 2, 3) for h in range(0, 900, 7)], "entity long, hour long")
    values = counts.select("entity", (F.col("hour") * 3 % 500).alias("t"), F.col("n").alias("v"), F.col("n").cast("string").alias("c"))
    left = obs.select("entity", (F.col("hour") % 450).alias("t"))
    made = {
        "prior": lambda: H.prior_counts(obs, counts, {"all": None, "day": 24}), "own": lambda: H.own_prior_counts(counts, {"all": None, "week": 168}), "city": lambda: H.city_prior(H.city_counts(counts), {"all": None, "day": 24}),
        "label": lambda: H.forward_label(obs, counts, 24), "asof": lambda: H.asof_strict(left, values, "entity", "v", "t"), "bracket": lambda: H.asof_bracket(values, left.distinct(), ["entity"], "t", "v", "c", 9),
        "season": lambda: H.seasonal_prior(counts.withColumn("hod", F.col("hour") % 24), {"same": ["hod"]}, {"early": F.col("hod") < 6}),
    }
    plain = {name: sorted(map(repr, f().collect())) for name, f in made.items()}
    monkeypatch.setattr(S, "HOT_ROWS", 5)
    for name, f in made.items():
        assert sorted(map(repr, f().collect())) == plain[name], name


def quantile(values, share):
    v = sorted(values)
    at = (len(v) - 1) * share
    lo, hi = v[math.floor(at)], v[math.ceil(at)]
    return lo + (at - math.floor(at)) * (hi - lo)


def test_quantiles(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([None, rnd.randint(-5, 5), rnd.random()]), float(rnd.randint(0, 3))) for _ in range(500)] + [("only null", None, 1.0)]
    df = spark.createDataFrame([(g, None if x is None else float(x), y) for g, x, y in data], "g string, x double, y double")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    groups = defaultdict(lambda: ([], []))
    for g, x, y in data:
        for at in (g, "*"):
            if x is not None:
                groups[at][0].append(x)
            groups[at][1].append(y)
    got = {r.g: r for r in S.quantiles(df, ["x", "y"], shares, ["g"], "_q").collect()}
    assert set(got) == {"a", "b", None, "only null"} and got["only null"].x_q is None and got["only null"].y_q == [1.0] * 5
    whole = S.quantiles(df, ["x", "y"], shares).collect()
    assert len(whole) == 1
    for r, (x, y) in [(whole[0], groups["*"]), *(((got[g].x_q, got[g].y_q), groups[g]) for g in ("a", "b", None))]:
        assert all(math.isclose(a, quantile(x, s), abs_tol=1e-12) for a, s in zip(r[0], shares)) and all(math.isclose(a, quantile(y, s), abs_tol=1e-12) for a, s in zip(r[1], shares))
    empty = S.quantiles(df.where("false"), ["x"], [0.5]).collect()
    assert len(empty) == 1 and empty[0].x is None and S.quantiles(df.where("false"), ["x"], [0.5], ["g"]).count() == 0
