"""Queries on event history, labels, sampling and calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hours import calendar_flags, calendar_parts, hour_index, hour_start
from ..operators import history as H
from ..operators import labels as L
from .registry import query, table

C = "counts AS (SELECT user_id AS entity, epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events GROUP BY 1, 2)"
WINDOWS = {"prior_24h": 24, "prior_7d": 168, "prior_30d": 720}


def counts(spark, sf):
    return H.event_counts(table(spark, sf, "events"), "user_id", "ts")


def observations(spark, sf):
    """Every sixth hour of the customers that events have, from the events' first hour on: rows with and without events."""
    ev = table(spark, sf, "events")
    span = ev.agg(F.min(hour_index("ts")).alias("lo"), F.max(hour_index("ts")).alias("hi"))
    hours = span.select(F.explode(F.sequence("lo", "hi", F.lit(6).cast("long"))).alias("hour"))
    return ev.select(F.col("user_id").alias("entity")).distinct().crossJoin(F.broadcast(hours))  # hours of the period


OBS = "span AS (SELECT min(epoch_us(ts) // 3600000000) AS lo, max(epoch_us(ts) // 3600000000) AS hi FROM events), obs AS (SELECT e.entity, h.hour FROM (SELECT DISTINCT user_id AS entity FROM events) e CROSS JOIN (SELECT unnest(generate_series(lo, hi, 6)) AS hour FROM span) h)"


@query(f"WITH {C} SELECT entity, hour, n FROM counts")
def event_counts(spark, sf):
    return counts(spark, sf)


@query(f"WITH {C} SELECT hour, sum(n)::BIGINT AS n FROM counts GROUP BY hour")
def city_counts(spark, sf):
    return H.city_counts(counts(spark, sf))


@query(f"WITH {C} SELECT a.entity, a.hour, coalesce(sum(b.n), 0)::BIGINT AS prior_total FROM counts a LEFT JOIN counts b ON a.entity = b.entity AND b.hour < a.hour GROUP BY 1, 2")
def prior_total(spark, sf):
    return H.own_prior_counts(counts(spark, sf), {"prior_total": None}).select("entity", "hour", "prior_total")


@query(f"""WITH {C} SELECT a.entity, a.hour, any_value(a.n) AS n, coalesce(sum(b.n), 0)::BIGINT AS prior_total,
 coalesce(sum(b.n) FILTER (b.hour >= a.hour - 24), 0)::BIGINT AS prior_24h, coalesce(sum(b.n) FILTER (b.hour >= a.hour - 168), 0)::BIGINT AS prior_7d,
 coalesce(sum(b.n) FILTER (b.hour >= a.hour - 720), 0)::BIGINT AS prior_30d, coalesce((a.hour - max(b.hour))::DOUBLE, -1.0) AS hours_since_prev, max(b.hour) IS NOT NULL AS has_history
 FROM counts a LEFT JOIN counts b ON a.entity = b.entity AND b.hour < a.hour GROUP BY 1, 2""")
def prior_windows(spark, sf):
    return H.own_prior_counts(counts(spark, sf), {"prior_total": None, **WINDOWS})


@query(f"""WITH {C}, {OBS} SELECT a.entity, a.hour, coalesce((a.hour - max(b.hour))::DOUBLE, -1.0) AS hours_since_prev, max(b.hour) IS NOT NULL AS has_history,
 coalesce(sum(b.n) FILTER (b.hour >= a.hour - 24), 0)::BIGINT AS prior_24h FROM obs a LEFT JOIN counts b ON a.entity = b.entity AND b.hour < a.hour GROUP BY 1, 2""")
def hours_since_prev(spark, sf):
    return H.prior_counts(observations(spark, sf), counts(spark, sf), {"prior_24h": 24})


@query(f"""WITH {C}, c AS (SELECT hour, sum(n)::BIGINT AS n FROM counts GROUP BY 1) SELECT a.hour, any_value(a.n) AS n, coalesce(sum(b.n), 0)::BIGINT AS city_total,
 coalesce(sum(b.n) FILTER (b.hour >= a.hour - 24), 0)::BIGINT AS city_24h, coalesce(sum(b.n) FILTER (b.hour >= a.hour - 168), 0)::BIGINT AS city_7d
 FROM c a LEFT JOIN c b ON b.hour < a.hour GROUP BY 1""")
def city_prior(spark, sf):
    got = H.city_prior(H.city_counts(counts(spark, sf)), {"city_total": None, "city_24h": 24, "city_7d": 168})
    return got.select("hour", "n", "city_total", "city_24h", "city_7d")


@query(f"""WITH {C}, k AS (SELECT *, (hour % 24) AS hod, ((hour // 24 + 3) % 7) AS wd FROM counts)
 SELECT a.entity, a.hour, coalesce(sum(b.n) FILTER (b.hod = a.hod), 0)::BIGINT AS same_hour, coalesce(sum(b.n) FILTER (b.wd = a.wd), 0)::BIGINT AS same_weekday,
 coalesce(sum(b.n) FILTER (b.hod = a.hod AND b.wd = a.wd), 0)::BIGINT AS same_both, coalesce(sum(b.n) FILTER (b.wd >= 5), 0)::BIGINT AS on_weekends
 FROM k a LEFT JOIN k b ON a.entity = b.entity AND b.hour < a.hour GROUP BY 1, 2""")
def seasonal_prior(spark, sf):
    k = counts(spark, sf).withColumn("hod", F.col("hour") % 24).withColumn("wd", (F.floor(F.col("hour") / 24) + 3) % 7)
    got = H.seasonal_prior(k, {"same_hour": ["hod"], "same_weekday": ["wd"], "same_both": ["hod", "wd"]}, {"on_weekends": F.col("wd") >= 5})
    return got.select("entity", "hour", "same_hour", "same_weekday", "same_both", "on_weekends")


@query(f"""WITH {C}, {OBS} SELECT a.entity, a.hour, coalesce(sum(b.n), 0)::BIGINT AS future_count, min(b.hour) AS first_hour, max(b.hour) AS last_hour, (count(b.n) > 0)::INT AS target
 FROM obs a LEFT JOIN counts b ON a.entity = b.entity AND b.hour > a.hour AND b.hour <= a.hour + 24 GROUP BY 1, 2""")
def forward_label(spark, sf):
    return H.forward_label(observations(spark, sf), counts(spark, sf), 24)


@query("""SELECT a.o_orderkey, a.o_custkey, epoch_us(a.o_orderdate) // 86400000000 AS day,
 (SELECT max(b.o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate = (SELECT max(c.o_orderdate) FROM orders c WHERE c.o_custkey = a.o_custkey AND c.o_orderdate < a.o_orderdate)) AS o_totalprice_asof
 FROM orders a WHERE a.o_custkey % 10 = a.o_custkey % 10""")
def asof_strict(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", (hour_index("o_orderdate") / 24).cast("long"))
    got = H.asof_strict(o.select("o_orderkey", "o_custkey", "day"), o.select("o_custkey", "day", "o_totalprice"), "o_custkey", "o_totalprice", "day")
    return got.select("o_orderkey", "o_custkey", "day", "o_totalprice_asof")


@query(f"""WITH h AS (SELECT event_type, epoch_us(ts) // 3600000000 AS hour, max(value) AS v, max(props) AS c FROM events WHERE epoch_us(ts) // 3600000000 % 3 = 0 GROUP BY 1, 2),
 w AS (SELECT DISTINCT event_type, epoch_us(ts) // 3600000000 AS hour FROM events),
 j AS (SELECT w.event_type, w.hour, (SELECT max(hour) FROM h WHERE h.event_type = w.event_type AND h.hour <= w.hour) AS b, (SELECT min(hour) FROM h WHERE h.event_type = w.event_type AND h.hour >= w.hour) AS a FROM w)
 SELECT j.event_type, j.hour, CASE WHEN j.a - j.b <= 6 THEN round(hb.v + CASE WHEN j.a > j.b THEN (j.hour - j.b)::DOUBLE / (j.a - j.b) ELSE 0 END * (ha.v - hb.v), 6) END AS interpolated,
 CASE WHEN j.a - j.b <= 6 THEN CASE WHEN (j.hour - j.b) * 2 <= j.a - j.b THEN hb.c ELSE ha.c END END AS category
 FROM j LEFT JOIN h hb ON hb.event_type = j.event_type AND hb.hour = j.b LEFT JOIN h ha ON ha.event_type = j.event_type AND ha.hour = j.a""")
def asof_interpolate(spark, sf):
    e = table(spark, sf, "events").withColumn("hour", hour_index("ts"))
    got = H.asof_bracket(e.where("hour % 3 = 0").select("event_type", "hour", "value", "props"), e.select("event_type", "hour").distinct(), ["event_type"], "hour", "value", "props", 6)
    return got.select("event_type", "hour", F.round("interpolated", 6).alias("interpolated"), "category")


SPINE = f"WITH {C}, s AS (SELECT unnest(generate_series(min(hour), max(hour))) AS hour FROM counts), g AS (SELECT s.hour, coalesce(sum(n), 0)::BIGINT AS n FROM s LEFT JOIN counts USING (hour) GROUP BY 1)"


def gapless(spark, sf):
    c = H.city_counts(counts(spark, sf))
    spine = H.hour_spine(c.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")), "lo", "hi")
    return spine.join(c, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


@query(SPINE + """, i AS (SELECT *, row_number() OVER (ORDER BY hour) AS r FROM g)
 SELECT a.hour, a.n, sum(b.n) FILTER (a.r - b.r <= 3)::BIGINT AS n_sum_3, round(avg(b.n) FILTER (a.r - b.r <= 3), 6) AS n_mean_3, sum(b.n)::BIGINT AS n_sum_24, round(avg(b.n), 6) AS n_mean_24
 FROM i a LEFT JOIN i b ON b.r < a.r AND b.r >= a.r - 24 GROUP BY 1, 2""")
def lagged_rolling(spark, sf):
    got = H.lagged_rolling(gapless(spark, sf), "n", [3, 24])
    return got.select("hour", "n", "n_sum_3", F.round("n_mean_3", 6).alias("n_mean_3"), "n_sum_24", F.round("n_mean_24", 6).alias("n_mean_24"))


@query(SPINE + " SELECT a.hour, a.n, a.n - b.n AS n_diff_1, a.n - c.n AS n_diff_3 FROM g a LEFT JOIN g b ON b.hour = a.hour - 1 LEFT JOIN g c ON c.hour = a.hour - 3")
def lag_diff(spark, sf):
    return H.lag_diff(gapless(spark, sf), "n", [1, 3])


@query(SPINE + " SELECT a.hour, coalesce((a.hour - max(b.hour))::DOUBLE, 9999.0) AS since_busy FROM g a LEFT JOIN g b ON b.hour <= a.hour AND b.n >= 20 GROUP BY 1")
def hours_since_condition(spark, sf):
    return H.hours_since_condition(gapless(spark, sf), F.col("n") >= 20, "since_busy").select("hour", "since_busy")


@query(SPINE + " SELECT count(*) AS hours, count(DISTINCT hour) AS distinct_hours, (max(hour) - min(hour) + 1 - count(*))::BIGINT AS missing FROM g")
def gapless_check(spark, sf):
    g = gapless(spark, sf)
    step = g.withColumn("step", F.col("hour") - F.lag("hour").over(Window.orderBy("hour")))
    return step.agg(F.count("*").alias("hours"), F.count_distinct("hour").alias("distinct_hours"), F.coalesce(F.sum(F.greatest(F.col("step") - 1, F.lit(0))), F.lit(0)).alias("missing"))


@query(f"WITH {C}, i AS (SELECT entity, hour, hour - row_number() OVER (PARTITION BY entity ORDER BY hour) AS k FROM counts), r AS (SELECT entity, k, count(*) AS len FROM i GROUP BY 1, 2) SELECT entity, count(*) AS runs, round(avg(len), 6) AS mean_length, max(len) AS max_length FROM r GROUP BY 1")
def run_lengths(spark, sf):
    return H.run_lengths(counts(spark, sf)).groupBy("entity").agg(F.count("*").alias("runs"), F.round(F.avg("length"), 6).alias("mean_length"), F.max("length").alias("max_length"))


@query(f"WITH {C} SELECT DISTINCT entity, hour - 1 AS hour FROM counts")
def positives_1h(spark, sf):
    return L.positives_next(counts(spark, sf))


@query(f"WITH {C}, s AS (SELECT min(hour) AS lo, max(hour) AS hi FROM counts) SELECT DISTINCT entity, hour - k AS hour FROM counts, s, generate_series(1, 24) t(k) WHERE hour - k BETWEEN lo AND hi")
def positive_windows(spark, sf):
    return L.positives_window(counts(spark, sf), 24)


NEG = f"""WITH {C}, pos AS (SELECT entity, hour - 1 AS hour FROM counts), mem AS (SELECT c_custkey AS entity, c_mktsegment AS stratum FROM customer),
 known AS (SELECT pos.*, stratum FROM pos LEFT JOIN mem USING (entity)),
 ring AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY ('0x' || substr(md5(concat_ws('|', 42, entity)), 1, 8))::BIGINT, entity) - 1 AS place, count(*) OVER (PARTITION BY stratum) AS size FROM (SELECT * FROM mem UNION ALL SELECT entity, 'all' FROM mem)),
 asked AS (SELECT hour, stratum, count(*) * 3 AS need FROM known WHERE stratum IS NOT NULL GROUP BY 1, 2),
 free AS (SELECT a.*, r.entity, ((place - ('0x' || substr(md5(concat_ws('|', 42, hour, stratum)), 1, 8))::BIGINT) % size + size) % size AS k FROM asked a JOIN ring r USING (stratum) WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.entity = r.entity AND pos.hour = a.hour)),
 first AS (SELECT hour, entity FROM (SELECT *, row_number() OVER (PARTITION BY hour, stratum ORDER BY k) AS nth FROM free) WHERE nth <= need),
 short AS (SELECT w.hour, wanted - coalesce(got, 0) AS need FROM (SELECT hour, count(*) * 3 AS wanted FROM known GROUP BY 1) w LEFT JOIN (SELECT hour, count(*) AS got FROM first GROUP BY 1) g USING (hour) WHERE wanted > coalesce(got, 0)),
 rest AS (SELECT s.*, r.entity, ((place - ('0x' || substr(md5(concat_ws('|', 42, hour, 'all')), 1, 8))::BIGINT) % size + size) % size AS k FROM short s JOIN ring r ON stratum = 'all' WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.entity = r.entity AND pos.hour = s.hour) AND NOT EXISTS (SELECT 1 FROM first f WHERE f.entity = r.entity AND f.hour = s.hour)),
 more AS (SELECT hour, entity FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY k) AS nth FROM rest) WHERE nth <= need)"""


@query(NEG + " SELECT hour, entity FROM first UNION ALL SELECT hour, entity FROM more")
def negative_sample(spark, sf):
    members = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("stratum"))
    return L.sample_negatives(L.positives_next(counts(spark, sf)), members, ratio=3)


@query(f"""WITH {C}, d AS (SELECT DISTINCT hour FROM counts), i AS (SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS i, count(*) OVER () AS n FROM d),
 c AS (SELECT max(hour) FILTER (i = n * 70 // 100) AS a, max(hour) FILTER (i = n * 85 // 100) AS b FROM i)
 SELECT entity, hour, CASE WHEN hour < a - 24 THEN 'train' WHEN hour < a THEN 'purged' WHEN hour < b - 24 THEN 'validation' WHEN hour < b THEN 'purged' ELSE 'test' END AS split FROM counts, c""")
def chrono_split(spark, sf):
    return L.chronological_split(counts(spark, sf).select("entity", "hour"), "hour", purge=24)


SPLIT = f"""WITH {C}, d AS (SELECT DISTINCT hour FROM counts), i AS (SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS i, count(*) OVER () AS n FROM d),
 c AS (SELECT max(hour) FILTER (i = n * 70 // 100) AS a, max(hour) FILTER (i = n * 85 // 100) AS b FROM i),
 s AS (SELECT entity, hour, n, CASE WHEN hour < a - 24 THEN 'train' WHEN hour < a THEN 'purged' WHEN hour < b - 24 THEN 'validation' WHEN hour < b THEN 'purged' ELSE 'test' END AS split FROM counts, c)"""


@query(SPLIT + ", h AS (SELECT split, hour, count(*) AS r, count(*) FILTER (n > 1) AS p FROM s GROUP BY 1, 2) SELECT split, sum(r)::BIGINT AS rows, sum(p)::BIGINT AS positives, round(sum(p) / sum(r), 6) AS prevalence, count(*) AS hours, min(r) AS min_rows, max(r) AS max_rows, (SELECT count(DISTINCT entity) FROM s WHERE s.split = h.split) AS entities FROM h GROUP BY 1")
def split_distribution(spark, sf):
    s = L.chronological_split(counts(spark, sf), "hour", purge=24)
    per = s.groupBy("split", "hour").agg(F.count("*").alias("r"), F.sum((F.col("n") > 1).cast("long")).alias("p"))
    return per.groupBy("split").agg(F.sum("r").alias("rows"), F.sum("p").alias("positives"), F.round(F.sum("p") / F.sum("r"), 6).alias("prevalence"), F.count("*").alias("hours"), F.min("r").alias("min_rows"), F.max("r").alias("max_rows")).join(s.groupBy("split").agg(F.count_distinct("entity").alias("entities")), "split")


@query(SPLIT + ", b AS (SELECT max(hour) FILTER (split = 'train') AS t, max(hour) FILTER (split = 'validation') AS v, min(hour) FILTER (split = 'validation') AS v0, min(hour) FILTER (split = 'test') AS e0 FROM s) SELECT t + 24 < v0 AS train_clean, v + 24 < e0 AS validation_clean FROM b")
def purge_audit(spark, sf):
    s = L.chronological_split(counts(spark, sf), "hour", purge=24)
    at = lambda f, k: f(F.when(F.col("split") == k, F.col("hour")))
    return s.agg((at(F.max, "train") + 24 < at(F.min, "validation")).alias("train_clean"), (at(F.max, "validation") + 24 < at(F.min, "test")).alias("validation_clean"))


@query("""WITH e AS (SELECT event_id, event_type, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT AS h FROM events), q AS (SELECT event_type, round(count(*) * 1000.0 / (SELECT count(*) FROM events))::BIGINT AS q FROM events GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) AS r FROM e) SELECT r.event_id, r.event_type FROM r JOIN q USING (event_type) WHERE r.r <= q.q""")
def stratified_sample(spark, sf):
    return L.stratified_sample(table(spark, sf, "events").select("event_id", "event_type"), "event_type", ["event_id"], 1000)


@query("""WITH d AS (SELECT epoch_us(o_orderdate) // 86400000000 AS day, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), s AS (SELECT unnest(generate_series(min(day), max(day))) AS day FROM d),
 g AS (SELECT s.day, month(to_timestamp(s.day * 86400)::TIMESTAMP) AS month, coalesce(n, 0) AS n FROM s LEFT JOIN d USING (day))
 SELECT a.month, min(a.day) AS day FROM g a WHERE a.month IN (1, 4, 7, 10) AND EXISTS (SELECT 1 FROM g b WHERE b.day > a.day AND b.day <= a.day + 1 AND b.n > 0) GROUP BY 1""")
def first_active_window(spark, sf):
    d = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy((hour_index("o_orderdate") / 24).cast("long").alias("day")).agg(F.count("*").alias("n"))
    spine = d.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    days = spine.join(d, "day", "left").select("day", F.month(hour_start(F.col("day") * 24)).alias("month"), F.coalesce("n", F.lit(0)).alias("n"))
    return L.first_active_window(days, [1, 4, 7, 10], 1)


@query("SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday, day(ts)::INT AS day, month(ts)::INT AS month, quarter(ts)::INT AS quarter, year(ts)::INT AS year, CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) <= 5 THEN 'spring' WHEN month(ts) <= 8 THEN 'summer' ELSE 'autumn' END AS season, isodow(ts) >= 6 AS is_weekend FROM events")
def time_features(spark, sf):
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in calendar_parts("ts").items()])


HOL = "(101, 102, 107, 308, 321, 322, 323, 501, 507, 509, 706, 830, 1025, 1216)"


@query(f"""WITH s AS (SELECT unnest(generate_series(date_trunc('day', min(o_orderdate)), date_trunc('day', max(o_orderdate)), INTERVAL 7 HOUR)) AS ts FROM orders), m AS (SELECT ts, month(ts) * 100 + day(ts) AS md,
 month(ts + INTERVAL 1 DAY) * 100 + day(ts + INTERVAL 1 DAY) AS nx, month(ts - INTERVAL 1 DAY) * 100 + day(ts - INTERVAL 1 DAY) AS pv, isodow(ts) <= 5 AS work, hour(ts) AS h FROM s)
 SELECT ts, md IN {HOL} AS is_holiday, nx IN {HOL} AS is_day_before_holiday, pv IN {HOL} AS is_day_after_holiday, work AND h BETWEEN 7 AND 9 AS is_morning_rush, work AND h BETWEEN 17 AND 19 AS is_evening_rush,
 md BETWEEN 601 AND 831 OR md BETWEEN 1226 AND 1231 OR md BETWEEN 101 AND 110 OR md BETWEEN 321 AND 331 AS is_school_break, md >= 1225 OR md <= 110 AS is_new_year_period, h >= 22 OR h < 6 AS is_night FROM m""")
def calendar_features(spark, sf):
    span = table(spark, sf, "orders").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    hours = span.select(F.explode(F.expr("sequence(unix_seconds(cast(date_trunc('day', lo) as timestamp)) div 3600, unix_seconds(cast(date_trunc('day', hi) as timestamp)) div 3600, 7L)")).alias("hour"))
    return hours.select(hour_start("hour").alias("ts")).select("ts", *[c.alias(n) for n, c in calendar_flags("ts").items()])


HOURS2 = "a AS (SELECT DISTINCT epoch_us(ts) // 3600000000 AS hour FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT epoch_us(ts) // 3600000000 AS hour FROM events WHERE event_type = 'click')"


def _hours_of(spark, sf, kind):
    return table(spark, sf, "events").where(F.col("event_type") == kind).select(hour_index("ts").alias("hour")).distinct()


@query(f"WITH {HOURS2} SELECT hour FROM a INTERSECT SELECT hour FROM b")
def hours_intersect(spark, sf):
    return _hours_of(spark, sf, "error").intersect(_hours_of(spark, sf, "click"))


@query(f"WITH {HOURS2} SELECT hour FROM a EXCEPT SELECT hour FROM b")
def hours_except(spark, sf):
    return _hours_of(spark, sf, "error").subtract(_hours_of(spark, sf, "click"))


@query(f"""WITH {C}, e AS (SELECT DISTINCT entity, hour - 1 AS hour FROM counts), {OBS}, x AS (SELECT entity, hour FROM obs)
 SELECT (SELECT count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM x)) AS only_expected, (SELECT count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM e)) AS only_actual, (SELECT count(*) FROM (SELECT * FROM e INTERSECT SELECT * FROM x)) AS both_sides""")
def key_reconciliation(spark, sf):
    from ..operators.audit import reconcile

    return reconcile(L.positives_next(counts(spark, sf)), observations(spark, sf), ["entity", "hour"])


@query(f"WITH {C}, {OBS} SELECT o.entity, o.hour FROM obs o WHERE NOT EXISTS (SELECT 1 FROM counts c WHERE c.entity = o.entity AND c.hour = o.hour)")
def anti_keys(spark, sf):
    return observations(spark, sf).join(counts(spark, sf), ["entity", "hour"], "left_anti")


@query(f"WITH {OBS} SELECT hour, count(*) AS entities FROM obs GROUP BY 1")
def dense_grid(spark, sf):
    return observations(spark, sf).groupBy("hour").agg(F.count("*").alias("entities"))


@query(f"""WITH {C}, {OBS}, p AS (SELECT o.entity, o.hour, ('0x' || substr(md5(concat_ws('|', o.entity, o.hour)), 1, 8))::BIGINT AS h FROM obs o), s AS (SELECT * FROM p ORDER BY h, entity, hour LIMIT 100)
 SELECT s.entity, s.hour, (SELECT count(*) FROM events e WHERE e.user_id = s.entity AND epoch_us(e.ts) >= (s.hour - 24) * 3600000000 AND epoch_us(e.ts) < s.hour * 3600000000) AS counted, 0::BIGINT AS mismatch FROM s""")
def leakage_audit(spark, sf):
    """100 rows, chosen by hash, counted again by a range join on raw times, against the window path."""
    obs = observations(spark, sf).withColumn("h", L.hash_number(F.col("entity"), F.col("hour"))).orderBy("h", "entity", "hour").limit(100).drop("h")
    fast = H.prior_counts(obs, counts(spark, sf), {"w": 24}).select("entity", "hour", "w")
    ev = table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    slow = F.broadcast(fast).join(ev, "entity", "left").groupBy("entity", "hour", "w").agg(F.sum(F.expr("cast(us >= (hour - 24) * 3600000000 and us < hour * 3600000000 as long)")).alias("counted"))  # 100 rows
    return slow.select("entity", "hour", "counted", F.abs(F.col("counted") - F.col("w")).alias("mismatch"))


@query(f"WITH {C}, s AS (SELECT *, CASE WHEN hour < 473600 THEN 'train' WHEN hour < 473900 THEN 'validation' ELSE 'test' END AS split FROM counts) SELECT split, count(*) AS rows, min(hour) AS first, max(hour) AS last FROM s GROUP BY 1")
def fixed_split(spark, sf):
    got = L.fixed_split(counts(spark, sf), "hour", 473600, 473900)
    return got.groupBy("split").agg(F.count("*").alias("rows"), F.min("hour").alias("first"), F.max("hour").alias("last"))


@query(f"WITH {C} SELECT entity, hour, n, false AS is_obs FROM counts UNION ALL SELECT user_id, epoch_us(ts) // 3600000000, NULL, true FROM events")
def union_all(spark, sf):
    """Observations and counts in one frame, repeated rows included."""
    obs = table(spark, sf, "events").select(F.col("user_id").alias("entity"), hour_index("ts").alias("hour"))
    return H.with_events(obs, counts(spark, sf), ["entity"])
