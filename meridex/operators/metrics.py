"""Ranking, threshold and calibration metrics on scored rows, all through aggregates per distinct score.

Rows are reduced to (group, score, positives, rows) by a partial aggregate before anything is ordered. Continuous scores
are nearly as many as rows, so running counts go over ranges of scores (`records.prefix_sums`), never over all of them
in one task. Ties are in the formulas, not in the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import global_rank, prefix_sums


def per_score(df: DataFrame, score: str, target: str, groups: list[str]) -> DataFrame:
    """(groups, score, pos, n) and the groups' totals all_pos, all_n, with running counts from the highest score."""
    one = df.groupBy(*groups, F.col(score).alias("score")).agg(F.sum(F.col(target).cast("long")).alias("pos"), F.count("*").alias("n"))
    sums = prefix_sums(one, groups, [F.desc("score")], {"tp": F.col("pos"), "seen": F.col("n")})
    return sums.withColumnsRenamed({"all_tp": "all_pos", "all_seen": "all_n"})


def roc_auc(df: DataFrame, score: str, target: str, groups: list[str] | None = None) -> DataFrame:
    """Area by average ranks of ties; null if a class is missing."""
    s = per_score(df, score, target, groups or [])
    rank = F.col("all_n") - F.col("seen") + (F.col("n") + 1) / 2
    sums = s.groupBy(*(groups or [])).agg(F.sum(F.col("pos") * rank).alias("r"), F.max("all_pos").alias("p"), F.max("all_n").alias("n"))
    area = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0))
    return sums.select(*(groups or []), area.alias("roc_auc"))


def pr_auc(df: DataFrame, score: str, target: str, groups: list[str] | None = None) -> DataFrame:
    """Average precision: precision at each distinct score, weighted by the recall gained there."""
    s = per_score(df, score, target, groups or [])
    return s.groupBy(*(groups or [])).agg((F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.nullif(F.max("all_pos"), F.lit(0))).alias("pr_auc"))


def best_f1(df: DataFrame, score: str, target: str, groups: list[str] | None = None) -> DataFrame:
    """The score with the best F1, the highest of equals, with its precision and recall."""
    s = per_score(df, score, target, groups or []).withColumn("f1", F.round(2 * F.col("tp") / (F.col("seen") + F.col("all_pos")), 9))
    top = s.groupBy(*(groups or [])).agg(F.max(F.struct("f1", "score", "tp", "seen", "all_pos")).alias("t"))
    return top.select(*(groups or []), F.col("t.score").alias("threshold"), F.round("t.f1", 6).alias("f1"), F.round(F.col("t.tp") / F.col("t.seen"), 6).alias("precision"), F.round(F.col("t.tp") / F.nullif(F.col("t.all_pos"), F.lit(0)), 6).alias("recall"))


def confusion(df: DataFrame, score: str, target: str, threshold: float) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and F1 at a threshold; a zero denominator gives 0."""
    hit, pos = F.col(score) >= threshold, F.col(target) == 1
    n = lambda c: F.sum(c.cast("long"))
    one = df.agg(n(hit & pos).alias("tp"), n(hit & ~pos).alias("fp"), n(~hit & pos).alias("fn"), n(~hit & ~pos).alias("tn"))
    safe = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return one.withColumns({"precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn)})


def calibration_bins(df: DataFrame, score: str, target: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, observed): right-closed bins of equal width; 0 is in the first."""
    d = F.col(score).cast("decimal(18,9)")
    at = F.greatest(F.least(F.ceil(d * bins) - 1, F.lit(bins - 1)), F.lit(0)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(target).cast("double")).alias("observed"))


def ece_brier(df: DataFrame, score: str, target: str, bins: int = 10) -> DataFrame:
    b = calibration_bins(df, score, target, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("observed"))) / F.sum("n")).alias("ece"))
    return b.crossJoin(df.agg(F.avg(F.pow(F.col(score) - F.col(target), 2)).alias("brier")))


def rank_first(score: str, ids: list[str], groups: list[str] | None = None) -> Column:
    """Unique ranks 1..n: score descending, then ids."""
    return F.row_number().over(Window.partitionBy(*(groups or [])).orderBy(F.desc(score), *ids))


def rank_pct_average(score: str, groups: list[str]) -> Column:
    """Ascending percentile with average ranks of ties."""
    by = Window.partitionBy(*groups)
    return (F.rank().over(by.orderBy(score)) + (F.count("*").over(Window.partitionBy(*groups, score)) - 1) / 2) / F.count("*").over(by)


def add_pct_average(df: DataFrame, score: str, name: str) -> DataFrame:
    """Adds the ascending percentile among all rows, with average ranks of ties: ranks of distinct scores, joined back."""
    one = df.groupBy(F.col(score).alias("__at")).agg(F.count("*").alias("__n"))
    ranks = prefix_sums(one, [], [F.col("__at")], {"__upto": F.col("__n")})
    pct = (F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2) / F.col("all___upto")
    return df.join(ranks.select("__at", pct.alias(name)), F.col(score).eqNullSafe(F.col("__at"))).drop("__at")


def rank_pct_max(score: str, groups: list[str]) -> Column:
    """Descending rank with the maximum method, as a share."""
    by = Window.partitionBy(*groups)
    return (F.rank().over(by.orderBy(F.desc(score))) + F.count("*").over(Window.partitionBy(*groups, score)) - 1) / F.count("*").over(by)


def top_fraction(df: DataFrame, score: str, target: str, ids: list[str], share: float) -> DataFrame:
    """Recall and lift of the ceil(share * n) best rows; ties by ids.

    Whole scores above the cut are counted by aggregates, only the rows of the score at the cut are ranked.
    """
    s = per_score(df, score, target, [])
    k = F.ceil(F.col("all_n") * F.lit(share).cast("decimal(9,4)")).cast("long")
    s = s.withColumn("k", k)
    cut = s.where("seen >= k").agg(F.max("score").alias("cut"), F.max("k").alias("k"), F.max("all_n").alias("n"), F.max("all_pos").alias("p"))
    above = s.crossJoin(F.broadcast(cut.select("cut"))).where("score > cut").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n0"), F.coalesce(F.sum("pos"), F.lit(0)).alias("p0"))
    both = cut.crossJoin(above)
    at = global_rank(df.join(F.broadcast(both), F.col(score) == F.col("cut")), [F.col(c) for c in ids], "r").where("r <= k - n0")  # one row
    got = both.join(at.agg(F.coalesce(F.sum(F.col(target).cast("long")), F.lit(0)).alias("p1")))
    hits = F.col("p0") + F.col("p1")
    return got.select(F.col("k").alias("selected"), hits.alias("positives"), F.round(hits / F.nullif(F.col("p"), F.lit(0)), 6).alias("recall"), F.round((hits / F.col("k")) / F.nullif(F.col("p") / F.col("n"), F.lit(0)), 6).alias("lift"))


def hourly_ranking(df: DataFrame, group: str, score: str, target: str, ids: list[str], ks: list[int]) -> DataFrame:
    """(group, k, precision, recall, lift) of each group's k best rows; recall and lift are null without positives."""
    ranked = df.withColumn("_r", rank_first(score, ids, [group]))
    per = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(target).cast("long")).alias("p"), *[F.sum(F.when(F.col("_r") <= k, F.col(target)).otherwise(0).cast("long")).alias(f"h{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])
    out = per.select(group, "n", "p", F.inline(rows))
    precision = F.col("hits") / F.least(F.col("k"), F.col("n"))
    return out.select(group, "k", precision.alias("precision"), (F.col("hits") / F.nullif("p", F.lit(0))).alias("recall"), (precision / F.nullif(F.col("p") / F.col("n"), F.lit(0.0))).alias("lift"))


def cutoff_ties(df: DataFrame, group: str, score: str, target: str, ids: list[str], k: int) -> DataFrame:
    """For each group: the score at rank k, how many rows have it, and precision with all of them taken in."""
    cut = df.withColumn("_r", rank_first(score, ids, [group])).where(F.col("_r") == k).select(group, F.col(score).alias("cut"))
    per = df.join(cut, group).where(F.col(score) >= F.col("cut")).groupBy(group, "cut")
    return per.agg(F.sum((F.col(score) == F.col("cut")).cast("long")).alias("tied"), F.count("*").alias("taken"), F.round(F.avg(F.col(target).cast("double")), 6).alias("precision_with_ties"))


def topk_stability(df: DataFrame, group: str, score: str, ids: list[str], member: str, k: int) -> DataFrame:
    """(member, times, share, permanent): how many groups have the member among their k best."""
    groups = df.select(group).distinct().count()
    best = df.withColumn("_r", rank_first(score, ids, [group])).where(F.col("_r") <= k).select(group, member).distinct()
    per = best.groupBy(member).agg(F.count("*").alias("times"))
    return per.withColumns({"share": F.round(F.col("times") / max(groups, 1), 6), "permanent": F.col("times") == groups})


def robustness(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, median, std, lo, hi, cv) of metric columns over the rows of a small table of windows."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    got = long.groupBy("metric").agg(F.avg("v").alias("mean"), F.expr("percentile(v, 0.5)").alias("median"), F.stddev_pop("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return got.withColumn("cv", F.col("std") / F.nullif("mean", F.lit(0.0)))


def compare_models(df: DataFrame, model: str, a: str, b: str, metrics: list[str]) -> DataFrame:
    """(metric, a, b, difference, relative_pct, winner) of two rows of a table of models."""
    one = df.where(F.col(model).isin(a, b)).agg(*[F.max(F.when(F.col(model) == m, F.col(c))).cast("double").alias(f"{c}_{i}") for c in metrics for i, m in enumerate((a, b))])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}_0").alias("a"), F.col(f"{c}_1").alias("b")) for c in metrics])))
    gap = F.col("b") - F.col("a")
    return rows.withColumns({"difference": F.round(gap, 6), "relative_pct": F.round(100 * gap / F.nullif(F.abs("a"), F.lit(0.0)), 6), "winner": F.when(gap > 0, b).when(gap < 0, a).otherwise("tie")})


def percentile_blend(df: DataFrame, group: str, weights: dict[str, float], ids: list[str]) -> DataFrame:
    """Adds `blend`, the weighted mean of within-group percentiles, and its unique rank."""
    total = sum(weights.values())
    pct = {f"_{s}": rank_pct_average(s, [group]) for s in weights}
    blend = reduce(lambda x, y: x + y, [F.col(f"_{s}") * (w / total) for s, w in weights.items()])
    out = df.withColumns(pct).withColumn("blend", F.round(blend, 9)).drop(*pct)
    return out.withColumn("blend_rank", rank_first("blend", ids, [group]))


def blend_search(df: DataFrame, scores: list[str], target: str, fold: str, step: int = 5) -> DataFrame:
    """(weight, fold, pr_auc, roc_auc) of two-score blends on a grid of weights in steps of 1 / step; `all` is every row."""
    pct = df
    for c in scores:
        pct = add_pct_average(pct, c, f"_{c}")
    grid = F.array(*[F.lit(i) for i in range(step + 1)])
    long = pct.withColumn("weight", F.explode(grid)).withColumn("blend", F.round((F.col(f"_{scores[0]}") * F.col("weight") + F.col(f"_{scores[1]}") * (step - F.col("weight"))) / step, 6))
    both = long.withColumn("part", F.explode(F.array(F.lit("all"), F.col(fold).cast("string"))))
    return pr_auc(both, "blend", target, ["weight", "part"]).join(roc_auc(both, "blend", target, ["weight", "part"]), ["weight", "part"])


def smoothed_rate(train: DataFrame, apply: DataFrame, key: str, target: str, alpha: float = 20.0) -> DataFrame:
    """Adds (positives + alpha * global) / (rows + alpha) of the key in `train`; unseen keys get the global rate."""
    g = train.agg(F.avg(F.col(target).cast("double")).alias("_g"))
    per = train.groupBy(key).agg(F.sum(F.col(target).cast("double")).alias("_p"), F.count("*").alias("_n"))
    got = apply.join(per, key, "left").crossJoin(F.broadcast(g))  # one row
    rate = (F.coalesce("_p", F.lit(0.0)) + alpha * F.col("_g")) / (F.coalesce("_n", F.lit(0)) + alpha)
    return got.withColumn("rate", rate).drop("_p", "_n", "_g")
