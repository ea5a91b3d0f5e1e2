"""Queries on ranking and calibration metrics. Scored rows are line items; ties are common in their scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from .registry import query, table

S = """s AS (SELECT l_orderkey AS okey, l_linenumber AS line, l_suppkey AS seg, year(l_shipdate) * 100 + month(l_shipdate) AS grp, l_discount * 10 AS score, l_tax * 10 AS score2, (l_returnflag = 'R')::INT AS y FROM lineitem)"""


def scored(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("seg"), (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("grp"),
        (F.col("l_discount") * 10).alias("score"), (F.col("l_tax") * 10).alias("score2"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


P = S + ", p AS (SELECT score, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1)"


@query(f"WITH {P}, r AS (SELECT a.score, any_value(a.pos) AS pos, any_value(a.n) AS n, coalesce(sum(b.n), 0) AS below FROM p a LEFT JOIN p b ON b.score < a.score GROUP BY 1) SELECT round((sum(pos * (below + (n + 1) / 2)) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))), 6)::DOUBLE AS roc_auc FROM r")
def roc_auc(spark, sf):
    return M.roc_auc(scored(spark, sf), "score", "y").select(F.round("roc_auc", 6).alias("roc_auc"))


@query(f"WITH {P}, r AS (SELECT a.score, any_value(a.pos) AS pos, sum(b.pos) AS tp, sum(b.n) AS seen FROM p a JOIN p b ON b.score >= a.score GROUP BY 1) SELECT round(sum(pos * tp / seen) / sum(pos), 6)::DOUBLE AS pr_auc FROM r")
def pr_auc(spark, sf):
    return M.pr_auc(scored(spark, sf), "score", "y").select(F.round("pr_auc", 6).alias("pr_auc"))


@query(f"WITH {P}, r AS (SELECT a.score, sum(b.pos) AS tp, sum(b.n) AS seen FROM p a JOIN p b ON b.score >= a.score GROUP BY 1), f AS (SELECT *, round(2 * tp / (seen + (SELECT sum(pos) FROM p)), 9) AS f1 FROM r) SELECT score AS threshold, round(f1, 6)::DOUBLE AS f1, round(tp / seen, 6)::DOUBLE AS precision, round(tp / (SELECT sum(pos) FROM p), 6)::DOUBLE AS recall FROM f ORDER BY f1 DESC, score DESC LIMIT 1")
def best_f1(spark, sf):
    return M.best_f1(scored(spark, sf), "score", "y")


@query(f"WITH {S}, c AS (SELECT count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn, count(*) FILTER (score < 0.5 AND y = 0) AS tn FROM s) SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")
def confusion(spark, sf):
    return M.confusion(scored(spark, sf), "score", "y", 0.5)


BINS = f"WITH {S}, b AS (SELECT greatest(least(ceil(score::DECIMAL(18,9) * 10) - 1, 9), 0)::INT AS bin, count(*) AS n, avg(score) AS mean_score, avg(y) AS observed FROM s GROUP BY 1)"


@query(BINS + " SELECT bin, n, round(mean_score, 6) AS mean_score, round(observed, 6) AS observed FROM b")
def calibration_bins(spark, sf):
    return M.calibration_bins(scored(spark, sf), "score", "y").select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("observed", 6).alias("observed"))


@query(BINS + " SELECT round((SELECT sum(n * abs(mean_score - observed)) / sum(n) FROM b), 5) AS ece, round((SELECT avg((score - y) ** 2) FROM s), 5) AS brier")
def ece_brier(spark, sf):
    return M.ece_brier(scored(spark, sf), "score", "y").select(F.round("ece", 5).alias("ece"), F.round("brier", 5).alias("brier"))


@query(f"WITH {S}, r AS (SELECT y, row_number() OVER (ORDER BY score DESC, okey, line) AS r, ceil(count(*) OVER () * 0.1)::BIGINT AS k, count(*) OVER () AS n, sum(y) OVER () AS p FROM s) SELECT any_value(k) AS selected, sum(y) FILTER (r <= k)::BIGINT AS positives, round(sum(y) FILTER (r <= k) / any_value(p), 6)::DOUBLE AS recall, round((sum(y) FILTER (r <= k) / any_value(k)) / (any_value(p) / any_value(n)), 6)::DOUBLE AS lift FROM r")
def top_decile_lift(spark, sf):
    return M.top_fraction(scored(spark, sf), "score", "y", ["okey", "line"], 0.1)


R = S + ", r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, okey, line) AS r FROM s)"
HK = R + ", g AS (SELECT grp, count(*) AS n, sum(y) AS p FROM s GROUP BY 1), k AS (SELECT unnest([10, 20, 50]) AS k), h AS (SELECT g.grp, k.k, n, p, (SELECT sum(y) FROM r WHERE r.grp = g.grp AND r.r <= k.k) AS hits FROM g, k), m AS (SELECT grp, k, hits / least(k, n) AS precision, hits / nullif(p, 0) AS recall, (hits / least(k, n)) / nullif(p / n, 0) AS lift FROM h)"


@query(f"WITH {HK} SELECT grp, k, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(lift, 6)::DOUBLE AS lift FROM m")
def hourly_ranking(spark, sf):
    return M.hourly_ranking(scored(spark, sf), "grp", "score", "y", ["okey", "line"], [10, 20, 50]).select("grp", "k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "lift")])


@query(f"WITH {HK} SELECT k, round(avg(precision), 6)::DOUBLE AS precision, round(avg(recall), 6)::DOUBLE AS recall, round(avg(lift), 6)::DOUBLE AS lift, count(recall) AS with_positives FROM m GROUP BY 1")
def mean_ranking(spark, sf):
    m = M.hourly_ranking(scored(spark, sf), "grp", "score", "y", ["okey", "line"], [10, 20, 50])
    return m.groupBy("k").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "lift")], F.count("recall").alias("with_positives"))


@query(f"WITH {R}, c AS (SELECT grp, score AS cut FROM r WHERE r = 20) SELECT s.grp, cut, count(*) FILTER (s.score = cut) AS tied, count(*) AS taken, round(avg(y), 6) AS precision_with_ties FROM s JOIN c USING (grp) WHERE s.score >= cut GROUP BY 1, 2")
def cutoff_ties(spark, sf):
    return M.cutoff_ties(scored(spark, sf), "grp", "score", "y", ["okey", "line"], 20)


@query(f"WITH {R}, b AS (SELECT DISTINCT grp, seg FROM r WHERE r <= 10) SELECT seg, count(*) AS times, round(count(*) / (SELECT count(DISTINCT grp) FROM s), 6) AS share, count(*) = (SELECT count(DISTINCT grp) FROM s) AS permanent FROM b GROUP BY 1")
def topk_stability(spark, sf):
    return M.topk_stability(scored(spark, sf), "grp", "score", ["okey", "line"], "seg", 10)


@query(f"WITH {R} SELECT seg, count(*) FILTER (r <= 10) AS top10, count(*) FILTER (r <= 20) AS top20, count(*) FILTER (r <= 50) AS top50, round(avg(score), 6) AS mean_score, round(max(score2), 6) AS max_baseline FROM r GROUP BY 1 ORDER BY top50 DESC, top10 DESC, seg LIMIT 30")
def leaderboard(spark, sf):
    r = scored(spark, sf).withColumn("r", M.rank_first("score", ["okey", "line"], ["grp"]))
    n = lambda k: F.sum((F.col("r") <= k).cast("long")).alias(f"top{k}")
    return r.groupBy("seg").agg(n(10), n(20), n(50), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("score2"), 6).alias("max_baseline")).orderBy(F.desc("top50"), F.desc("top10"), "seg").limit(30)


@query(f"WITH {HK}, w AS (SELECT precision::DOUBLE AS precision, recall::DOUBLE AS recall, lift::DOUBLE AS lift FROM m WHERE k = 20), u AS (UNPIVOT w ON precision, recall, lift INTO NAME metric VALUE v) SELECT metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(stddev_pop(v) / nullif(avg(v), 0), 6) AS cv FROM u GROUP BY 1")
def robustness(spark, sf):
    w = M.hourly_ranking(scored(spark, sf), "grp", "score", "y", ["okey", "line"], [20])
    return M.robustness(w, ["precision", "recall", "lift"]).select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "lo", "hi", "cv")])


@query(f"""WITH {S}, t AS (SELECT avg(score) AS a_mean, avg(score2) AS b_mean, avg(abs(score - y)) AS a_err, avg(abs(score2 - y)) AS b_err FROM s), r AS (SELECT 'mean' AS metric, a_mean AS a, b_mean AS b FROM t UNION ALL SELECT 'error', a_err, b_err FROM t)
 SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS difference, round(100 * (b - a) / nullif(abs(a), 0), 6) AS relative_pct, CASE WHEN b > a THEN 'tax' WHEN b < a THEN 'discount' ELSE 'tie' END AS winner FROM r""")
def compare_models(spark, sf):
    s = scored(spark, sf)
    long = s.select("y", F.inline(F.array(F.struct(F.lit("discount").alias("model"), F.col("score").alias("v")), F.struct(F.lit("tax").alias("model"), F.col("score2").alias("v")))))
    per = long.groupBy("model").agg(F.avg("v").alias("mean"), F.avg(F.abs(F.col("v") - F.col("y"))).alias("error"))
    return M.compare_models(per, "model", "discount", "tax", ["mean", "error"]).withColumns({"a": F.round("a", 6), "b": F.round("b", 6)})


@query(f"WITH {R} SELECT okey, line, grp, r AS rank FROM r")
def rank_first(spark, sf):
    return scored(spark, sf).select("okey", "line", "grp", M.rank_first("score", ["okey", "line"], ["grp"]).alias("rank"))


@query(f"WITH {S} SELECT okey, line, round((rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2) / count(*) OVER (PARTITION BY grp), 6) AS pct FROM s")
def rank_pct_avg(spark, sf):
    return scored(spark, sf).select("okey", "line", F.round(M.rank_pct_average("score", ["grp"]), 6).alias("pct"))


@query(f"WITH {S} SELECT okey, line, round((sum(1) OVER (PARTITION BY grp ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / count(*) OVER (PARTITION BY grp), 6)::DOUBLE AS pct FROM s")
def rank_pct_max(spark, sf):
    return scored(spark, sf).select("okey", "line", F.round(M.rank_pct_max("score", ["grp"]), 6).alias("pct"))


PCT = S + ", q AS (SELECT *, (rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2) / count(*) OVER (PARTITION BY grp) AS p1, (rank() OVER (PARTITION BY grp ORDER BY score2) + (count(*) OVER (PARTITION BY grp, score2) - 1) / 2) / count(*) OVER (PARTITION BY grp) AS p2 FROM s), b AS (SELECT *, round(p1 * 0.8 + p2 * 0.2, 9) AS blend FROM q)"


@query(f"WITH {PCT} SELECT okey, line, round(blend, 6) AS blend, row_number() OVER (PARTITION BY grp ORDER BY blend DESC, okey, line) AS blend_rank FROM b")
def percentile_blend(spark, sf):
    return M.percentile_blend(scored(spark, sf), "grp", {"score": 0.8, "score2": 0.2}, ["okey", "line"]).select("okey", "line", F.round("blend", 6).alias("blend"), "blend_rank")


@query(f"""WITH {S}, m AS (SELECT *, (grp % 3)::VARCHAR AS fold, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER () AS p1, (rank() OVER (ORDER BY score2) + (count(*) OVER (PARTITION BY score2) - 1) / 2) / count(*) OVER () AS p2 FROM s),
 l AS (SELECT y, w AS weight, round((p1 * w + p2 * (5 - w)) / 5, 6) AS blend, part FROM m, generate_series(0, 5) t(w), (SELECT unnest(['all', '0', '1', '2']) AS part) WHERE part = 'all' OR part = fold),
 p AS (SELECT weight, part, blend, sum(y) AS pos, count(*) AS n FROM l GROUP BY 1, 2, 3),
 c AS (SELECT *, sum(pos) OVER d AS tp, sum(n) OVER d AS seen, sum(n) OVER (PARTITION BY weight, part) AS all_n, sum(pos) OVER (PARTITION BY weight, part) AS all_pos FROM p WINDOW d AS (PARTITION BY weight, part ORDER BY blend DESC))
 SELECT weight::INT AS weight, part, round(sum(pos * tp / seen) / max(all_pos), 6)::DOUBLE AS pr_auc, round((sum(pos * (all_n - seen + (n + 1) / 2)) - max(all_pos) * (max(all_pos) + 1) / 2) / (max(all_pos) * (max(all_n) - max(all_pos))), 6)::DOUBLE AS roc_auc FROM c GROUP BY 1, 2""")
def blend_search(spark, sf):
    s = scored(spark, sf).withColumn("fold", F.col("grp") % 3)
    return M.blend_search(s, ["score", "score2"], "y", "fold").select("weight", "part", F.round("pr_auc", 6).alias("pr_auc"), F.round("roc_auc", 6).alias("roc_auc"))


@query(f"WITH {S}, t AS (SELECT * FROM s WHERE grp < 199901), g AS (SELECT avg(y) AS g FROM t), k AS (SELECT seg, sum(y) AS p, count(*) AS n FROM t GROUP BY 1) SELECT s.seg, count(*) AS rows, round(avg((coalesce(p, 0) + 20 * g) / (coalesce(n, 0) + 20)), 6) AS rate FROM s CROSS JOIN g LEFT JOIN k USING (seg) WHERE grp >= 199901 GROUP BY 1")
def smoothed_rate(spark, sf):
    s = scored(spark, sf)
    got = M.smoothed_rate(s.where("grp < 199901"), s.where("grp >= 199901"), "seg", "y")
    return got.groupBy("seg").agg(F.count("*").alias("rows"), F.round(F.avg("rate"), 6).alias("rate"))


@query(f"WITH {S}, h AS (SELECT DISTINCT grp FROM s) SELECT grp, ntile(5) OVER (ORDER BY grp) AS fold FROM h")
def time_folds(spark, sf):
    return scored(spark, sf).select("grp").distinct().withColumn("fold", F.ntile(5).over(Window.orderBy("grp")).cast("long"))


@query(f"WITH {S}, u AS (SELECT 'score' AS name, score - 0.5 AS v FROM s UNION ALL SELECT 'score2', score2 - 0.4 FROM s), g AS (SELECT name, avg(abs(v)) AS mean_abs, avg(v) AS mean FROM u GROUP BY 1) SELECT name, round(mean_abs, 6) AS mean_abs, round(mean, 6) AS mean, rank() OVER (ORDER BY mean_abs DESC) AS place, round(100 * mean_abs / sum(mean_abs) OVER (), 6) AS share_pct FROM g")
def importance_share(spark, sf):
    from ..operators.models import importance

    c = scored(spark, sf).select((F.col("score") - 0.5).alias("score"), (F.col("score2") - 0.4).alias("score2"))
    return importance(c, ["score", "score2"])


@query(f"WITH {R} SELECT grp, okey, line, r AS place FROM r WHERE r <= 20")
def top_per_class(spark, sf):
    return scored(spark, sf).withColumn("place", M.rank_first("score", ["okey", "line"], ["grp"])).where("place <= 20").select("grp", "okey", "line", "place")


@query(f"WITH {S} SELECT okey, line, score FROM s ORDER BY score DESC, okey, line LIMIT 500")
def top_n(spark, sf):
    return scored(spark, sf).orderBy(F.desc("score"), "okey", "line").limit(500).select("okey", "line", "score")


@query(f"WITH {S}, n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY okey, line) AS r FROM s) SELECT grp, okey, line FROM n ORDER BY r, grp LIMIT 200")
def round_robin(spark, sf):
    r = scored(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("okey", "line")))
    return r.orderBy("r", "grp").limit(200).select("grp", "okey", "line")


@query(f"WITH {S}, n AS (SELECT *, row_number() OVER (ORDER BY okey, line) - 1 AS i, count(*) OVER () AS n FROM s), w AS (SELECT DISTINCT k * (n - 1) // 99 AS i FROM (SELECT any_value(n) AS n FROM n), generate_series(0, 99) t(k)) SELECT okey, line FROM n JOIN w USING (i)")
def even_sample(spark, sf):
    from ..operators.records import even_sample as even

    return even(scored(spark, sf), ["okey", "line"], 100).select("okey", "line")


@query(f"WITH {R}, x AS (SELECT *, row_number() OVER (ORDER BY score DESC, okey, line) AS rank FROM s) SELECT count(DISTINCT (okey, line)) = count(*) AS unique_keys, bool_and(isfinite(score)) AS finite_scores, min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*) AS ranks_exact, count(*) AS rows FROM x")
def rank_contract(spark, sf):
    from ..operators.audit import rank_contract as contract
    from ..operators.records import global_rank

    return contract(global_rank(scored(spark, sf), [F.desc("score"), F.col("okey"), F.col("line")], "rank"), ["okey", "line"], "score", "rank")
