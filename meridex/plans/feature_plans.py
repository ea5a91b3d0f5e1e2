"""Queries on context features in full, audits of training, feature and external tables, and column contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hours import hour_index
from ..operators import audit as A
from ..operators import context as X
from ..operators import history as H
from ..operators import records as R
from .events import C, OBS, counts, observations
from .registry import query, table

START = 900_000_000
M = f"""m AS (SELECT o_custkey AS segment, 'i' || (o_orderkey % 1500) AS id, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey % 2500)::DOUBLE END AS distance, (o_orderkey % 26) / 25.0::DOUBLE AS confidence, CASE WHEN o_orderkey % 6 > 0 THEN {START} + (o_orderkey % 97 - 40) * 1800 END AS valid_from, CASE WHEN o_orderkey % 7 > 0 THEN {START} + o_orderkey % 200 * 1800 END AS valid_to,
 ['bridge_repair', 'road_repair', 'large_concert', 'football_match', 'festival'][1 + o_orderkey % 5] AS event_type, ['critical', 'high', 'medium', 'low', 'unknown'][1 + o_orderkey // 3 % 5] AS severity, ['full_closure', 'partial_closure', 'lane_narrowing', 'intersection_closure', NULL][1 + o_orderkey // 7 % 5] AS restriction, o_orderkey % 8 = 0 AS open_end, (1 + o_orderkey % 5) AS level, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 75) / 10.0::DOUBLE END AS intensity, ['Astana Arena', 'Hall', NULL][1 + o_orderkey % 3] AS venue FROM orders)"""


def matched(spark, sf):
    k = F.col("o_orderkey")
    of = lambda some, i: F.array(*map(F.lit, some))[i.cast("int")]
    return table(spark, sf, "orders").select(
        k.alias("record"), F.col("o_custkey").alias("segment"), F.concat(F.lit("i"), k % 1500).alias("id"), F.when(k % 11 > 0, (k % 2500).cast("double")).alias("distance"), ((k % 26) / 25).alias("confidence"),
        F.when(k % 6 > 0, START + (k % 97 - 40) * 1800).alias("valid_from"), F.when(k % 7 > 0, START + k % 200 * 1800).alias("valid_to"), of(("bridge_repair", "road_repair", "large_concert", "football_match", "festival"), k % 5).alias("event_type"),
        of(("critical", "high", "medium", "low", "unknown"), F.floor(k / 3) % 5).alias("severity"), of(("full_closure", "partial_closure", "lane_narrowing", "intersection_closure", None), F.floor(k / 7) % 5).alias("restriction"),
        (k % 8 == 0).alias("open_end"), (1 + k % 5).alias("level"), F.when(k % 4 > 0, (k % 75) / 10).alias("intensity"), of(("Astana Arena", "Hall", None), k % 3).alias("venue"),
    )


REPAIRS = f"""WITH {M}, w AS (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS sw, CASE restriction WHEN 'full_closure' THEN 2 WHEN 'partial_closure' THEN 1.5 WHEN 'intersection_closure' THEN 1.5 WHEN 'lane_narrowing' THEN 1.25 ELSE 1 END AS rw, row_number() OVER (PARTITION BY segment ORDER BY coalesce(distance, 'inf'::DOUBLE), id) AS r FROM m),
 f AS (SELECT segment, count(DISTINCT id) AS repairs, count(*) FILTER (restriction = 'full_closure') AS full_closures, count(*) FILTER (restriction = 'partial_closure') AS partial_closures, count(*) FILTER (restriction = 'lane_narrowing') AS lane_closures, count(*) FILTER (restriction = 'intersection_closure') AS intersection_closures, count(*) FILTER (event_type = 'bridge_repair') AS bridges,
 count(*) FILTER (sw >= 3) AS high_severity, round(sum(sw * confidence * rw), 3)::DOUBLE AS disruption, min(distance) AS nearest, max(confidence) AS confidence, count(*) FILTER (open_end) AS open_ends, round(min(greatest((valid_from - {START}) / 3600, 0)), 6) AS hours_until_start, any_value(id) FILTER (r = 1) AS source_id FROM w GROUP BY 1)"""


@query(REPAIRS + " SELECT * FROM f")
def repair_features(spark, sf):
    got = X.repair_features(matched(spark, sf), F.lit(START))
    return got.withColumns({"disruption": F.round("disruption", 3), "hours_until_start": F.round("hours_until_start", 6)}).drop("repair_start", "repair_end")


@query(f"""WITH {M}, u AS (SELECT *, row_number() OVER (PARTITION BY segment, id ORDER BY coalesce(distance, 'inf'::DOUBLE), valid_from NULLS FIRST) AS n FROM m), w AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY coalesce(distance, 'inf'::DOUBLE), id) AS r FROM u WHERE n = 1)
 SELECT segment, count(*) AS events, count(*) FILTER (distance <= 500) AS within_500, count(*) FILTER (distance <= 1000) AS within_1000, count(*) FILTER (distance <= 2000) AS within_2000, count(*) FILTER (level >= 4) AS major, count(*) FILTER (venue = 'Astana Arena') AS stadium, count(*) FILTER (event_type = 'large_concert') AS concerts, count(*) FILTER (event_type = 'football_match') AS sports,
 round(sum(coalesce(intensity, 0)), 3)::DOUBLE AS intensity_sum, max(coalesce(intensity, 0)) AS intensity_max, min(distance) AS nearest, round(min(greatest((valid_from - {START}) / 3600, 0)), 6) AS hours_until_start, coalesce(max((valid_to >= {START} AND valid_to < {START} + 86400 AND level >= 4)::INT), 0) AS outflow_risk, max(confidence) AS confidence, any_value(id) FILTER (r = 1) AS source_id FROM w GROUP BY 1""")
def event_features(spark, sf):
    m = matched(spark, sf).drop("severity").withColumnRenamed("level", "severity")
    got = X.event_features(m, F.lit(START), F.lit(START + 86400), "record")
    return got.withColumns({"intensity_sum": F.round("intensity_sum", 3), "hours_until_start": F.round("hours_until_start", 6)}).drop("venue", "event_start", "event_end")


Q = """q AS (SELECT user_id AS place, epoch_us(ts) // 1000000 AS sec, event_id AS n, CASE WHEN event_id % 13 > 0 THEN (event_id * 7 % 30 - 10)::DOUBLE END AS temperature, (event_id % 101)::DOUBLE AS humidity, (980 + event_id % 50)::DOUBLE AS pressure, (event_id % 17)::DOUBLE AS wind_speed, (event_id % 29)::DOUBLE AS wind_gust, CASE WHEN event_id % 3 = 0 THEN (event_id % 10) / 2.0::DOUBLE END AS rain, CASE WHEN event_id % 19 = 0 THEN 1.0::DOUBLE END AS snow,
 CASE WHEN event_id % 5 > 0 THEN (event_id * 37 % 9000)::DOUBLE END AS visibility, (event_id % 100)::DOUBLE AS clouds, [200, 500, 600, 701, 800, 801, NULL][1 + event_id % 7] AS weather_id FROM events)"""


def forecast(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("place"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"), k.alias("n"), F.when(k % 13 > 0, (k * 7 % 30 - 10).cast("double")).alias("temperature"), (k % 101).cast("double").alias("humidity"), (980 + k % 50).cast("double").alias("pressure"),
        (k % 17).cast("double").alias("wind_speed"), (k % 29).cast("double").alias("wind_gust"), F.when(k % 3 == 0, (k % 10) / 2).alias("rain"), F.when(k % 19 == 0, 1.0).alias("snow"), F.when(k % 5 > 0, (k * 37 % 9000).cast("double")).alias("visibility"), (k % 100).cast("double").alias("clouds"),
        F.array(*map(F.lit, (200, 500, 600, 701, 800, 801, None)))[(k % 7).cast("int")].alias("weather_id"),
    )


NUMBERS = ("temperature", "humidity", "pressure", "wind_speed", "visibility", "clouds")


@query(f"""WITH {Q}, t AS (SELECT n, place, temperature - lag(temperature) OVER (PARTITION BY place ORDER BY n) AS step FROM q WHERE temperature IS NOT NULL), l AS (SELECT q.*, step, row_number() OVER p AS i, lag(weather_id) OVER p AS before FROM q LEFT JOIN t USING (n, place) WINDOW p AS (PARTITION BY place ORDER BY n)),
 g AS (SELECT place, {', '.join(f'round(avg({c}), 6) AS {c}_mean, min({c}) AS {c}_min, max({c}) AS {c}_max, round(stddev_pop({c}), 6) AS {c}_std' for c in NUMBERS)}, max(temperature) - min(temperature) AS temperature_range, max(wind_gust) AS wind_gust_max, coalesce(sum(rain), 0)::DOUBLE AS rain_sum, coalesce(sum(snow), 0)::DOUBLE AS snow_sum, 3 * count(*) FILTER (rain > 0) AS rain_hours, 3 * count(*) FILTER (snow > 0) AS snow_hours, 3 * count(*) FILTER (visibility < 1000) AS fog_hours, 3 * count(*) FILTER (rain >= 2.5) AS heavy_rain_hours,
 3 * count(*) FILTER (wind_speed >= 10) AS strong_wind_hours, 3 * count(*) FILTER (temperature <= 0) AS freezing_hours, 3 * count(*) FILTER (weather_id = 200) AS storm_hours, count(*) FILTER (i > 1 AND weather_id IS DISTINCT FROM before) AS changes, coalesce(bool_or(step <= -5), false) AS rapid_drop, coalesce(min(temperature) <= 0 AND max(temperature) > 0, false) AS freeze_thaw FROM l GROUP BY 1),
 s AS (SELECT *, changes + rapid_drop::INT + freeze_thaw::INT AS instability, (rain_hours > 0)::INT + (snow_hours > 0)::INT + (fog_hours > 0)::INT + (strong_wind_hours > 0)::INT + (storm_hours > 0)::INT AS bad_weather, (rain_hours > 0)::INT + 2 * (snow_hours > 0)::INT + (freezing_hours > 0)::INT AS road_surface, (snow_hours > 0)::INT + (freezing_hours > 0)::INT + freeze_thaw::INT AS winter FROM g)
 SELECT *, bad_weather + road_surface + (fog_hours > 0)::INT AS driving, bad_weather + road_surface + (fog_hours > 0)::INT + instability AS severity FROM s""")
def forecast_features(spark, sf):
    got = X.forecast_features(forecast(spark, sf), "place", "n")
    return got.withColumns({f"{c}_{x}": F.round(f"{c}_{x}", 6) for c in NUMBERS for x in ("mean", "std")})


@query(f"""WITH {Q}, b AS (SELECT min(sec) AS t0 FROM q), p AS (SELECT q.*, (coalesce(rain > 0, false)::INT + 2 * coalesce(snow > 0, false)::INT + coalesce(visibility < 1000, false)::INT + coalesce(wind_speed >= 10, false)::INT) / 5 AS sev FROM q, b WHERE sec BETWEEN t0 + 864000 AND t0 + 950400)
 SELECT place, count(*) AS points, max(sev) AS severity, coalesce(bool_or(rain > 0), false) AS rain_expected, coalesce(bool_or(snow > 0), false) AS snow_expected, coalesce(bool_or(rain >= 2.5), false) AS heavy_rain_expected, min(visibility) AS visibility_min, max(wind_speed) AS wind_max, min(temperature) AS temperature_min, max(temperature) AS temperature_max, count(*) >= 9 AS complete, max(sev) >= 0.6 AS severe, arg_max(sec, (sev, -sec)) AS worst_start, arg_max(sec, (sev, -sec)) + 10800 AS worst_end FROM p GROUP BY 1""")
def day_summary(spark, sf):
    q = forecast(spark, sf)
    q = q.crossJoin(F.broadcast(q.agg(F.min("sec").alias("t0"))))  # one row
    return X.day_summary(q, "place", "sec", F.col("t0") + 864000)


@query(f"""WITH {C}, {OBS}, f AS (SELECT o.entity, o.hour, count(b.n) > 0 AS due FROM obs o LEFT JOIN counts b ON b.entity = o.entity AND b.hour > o.hour AND b.hour <= o.hour + 24 GROUP BY 1, 2), p AS (SELECT o.entity, o.hour, coalesce(sum(b.n), 0) AS prior FROM obs o LEFT JOIN counts b ON b.entity = o.entity AND b.hour < o.hour AND b.hour >= o.hour - 24 GROUP BY 1, 2),
 d AS (SELECT entity, hour, CASE WHEN (entity + hour) % 101 = 0 THEN 1 - due::INT ELSE due::INT END AS target, due, (entity + hour) % 97 = 0 AS off FROM f JOIN p USING (entity, hour)), r AS (SELECT count(*) FILTER (due AND target = 0) AS a, count(*) FILTER (NOT due AND target = 1) AS b, count(*) FILTER (off) AS h, abs(count(*) FILTER (target = 0) - 5 * count(*) FILTER (target = 1)) AS c, count(*) FILTER ((entity + hour) % 89 = 0) AS j, count(*) FILTER (hour < (SELECT lo + 48 FROM span)) AS o, count(*) FILTER ((entity + hour) % 83 = 0) AS z FROM d),
 x AS (SELECT unnest(['positive_missed', 'positive_unfounded', 'negative_not_free', 'duplicate_keys', 'history_mismatches', 'class_balance', 'missing_values', 'outside_coverage', 'join_poi', 'join_road', 'same_time_mismatches', 'foreign_entities', 'leakage']) AS check_name, unnest([a, b, a, 0, h, c, j, o, j, 0, z, 0, 1]) AS failures FROM r) SELECT check_name, failures, CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status FROM x UNION ALL SELECT 'final_status', count(*) FILTER (failures > 0), CASE WHEN count(*) FILTER (failures > 0) = 0 THEN 'READY' ELSE 'FAILED' END FROM x""")
def training_audit(spark, sf):
    """A table of observations with some labels turned round, counters off by one, values missing, early hours and the future."""
    obs, c = observations(spark, sf), counts(spark, sf)
    prior = H.prior_counts(obs, c, {"prior": 24}).select("entity", "hour", "prior")
    data = H.forward_label(obs, c, 24).select("entity", "hour", "target").join(prior, ["entity", "hour"])
    odd = lambda n: (F.col("entity") + F.col("hour")) % n == 0
    data = data.withColumns({"target": F.when(odd(101), 1 - F.col("target")).otherwise(F.col("target")), "prior": F.col("prior") + odd(97).cast("int")})
    data = data.withColumns({"poi_total": F.when(~odd(89), F.lit(1)), "road_lanes": F.lit(2), "future_count": F.lit(0)})
    timed = lambda df: df.withColumns({f"_{p}": A.SEASONS[p](F.col("hour")) for p in ("hour", "weekday")})
    same = H.prior_counts(timed(obs), timed(c), {"same_time": None}, ["entity", "_hour", "_weekday"]).select("entity", "hour", "same_time")
    data = data.join(same, ["entity", "hour"]).withColumn("same_time", F.col("same_time") + odd(83).cast("int"))
    span = c.agg((F.min("hour") + 48).alias("lo"), F.max("hour").alias("hi"))
    return A.training_audit(data, c, 24, 24, 5, span, {"poi": ["poi_total"], "road": ["road_lanes"]}, ("future_count", "target_count"), {"same_time": ["hour", "weekday"]})


@query(REPAIRS + """ SELECT count(*) = 1000 AS row_count, true AS unique_entities, true AS no_infinite_numeric, bool_and(repairs >= 0) AS nonnegative_counts, bool_and(coalesce(confidence BETWEEN 0 AND 1, true)) AS shares_in_range, bool_and(coalesce(nearest >= 0, true)) AS nonnegative_distances, true AS window_length, true AS keys_known, true AS unique_keys, NOT bool_or(segment NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS all_known, true AS stable_schema FROM f""")
def feature_contract(spark, sf):
    f = X.repair_features(matched(spark, sf), F.lit(START)).withColumns({"window_start": F.lit(START), "window_end": F.lit(START + 86400)})
    known = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("segment"))
    return A.feature_contract(f, ["segment", "window_start"], known, 1000, ("window_start", "window_end", 86400), ["repairs", "full_closures", "open_ends"], ["confidence"], ["nearest"], f.columns)


@query("""WITH a AS (SELECT DISTINCT epoch_us(ts) // 3600000000 AS hour FROM events WHERE event_type = 'click'), b AS (SELECT epoch_us(ts) // 3600000000 AS hour, CASE WHEN event_id % 9 > 0 THEN value END AS v FROM events WHERE event_type = 'error'), d AS (SELECT DISTINCT hour FROM b)
 SELECT 'calendar' AS source, unnest(['rows', 'first_hour', 'last_hour', 'duplicate_hours']) AS measure, unnest([count(*), min(hour), max(hour), 0]) AS value FROM a UNION ALL SELECT 'weather', unnest(['rows', 'first_hour', 'last_hour', 'duplicate_hours', 'missing_v']), unnest([count(*), min(hour), max(hour), count(*) - count(DISTINCT hour), count(*) - count(v)]) FROM b
 UNION ALL SELECT 'points', unnest(['rows', 'missing_coordinates']), unnest([count(*), count(*) FILTER (c_custkey % 4 = 0) + count(*) FILTER (c_custkey % 6 = 0)]) FROM customer UNION ALL SELECT 'points', 'category_' || c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment
 UNION ALL SELECT 'alignment', unnest(['calendar_only', 'weather_only', 'common_hours']), unnest([(SELECT count(*) FROM a WHERE hour NOT IN (SELECT hour FROM d)), (SELECT count(*) FROM d WHERE hour NOT IN (SELECT hour FROM a)), (SELECT count(*) FROM a JOIN d USING (hour))])""")
def external_audit(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "value", hour_index("ts").alias("hour"))
    weather = e.where("event_type = 'error'").select("hour", F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("v"))
    k = F.col("c_custkey")
    points = table(spark, sf, "customer").select("c_mktsegment", F.when(k % 4 > 0, 1.0).alias("lat"), F.when(k % 6 > 0, 1.0).alias("lon"))
    return A.external_audit(e.where("event_type = 'click'").select("hour").distinct(), weather, points, "hour", ["v"], ["lat", "lon"], "c_mktsegment")


@query("SELECT count(*) FILTER (o_orderkey % 50 = 0) AS only_stored, count(*) FILTER (o_orderkey % 50 = 0) AS only_rebuilt, count(*) FILTER (o_orderkey % 50 = 0) = 0 AS equal FROM orders")
def reconstruction_audit(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    again = o.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 50 == 0, 1.0).otherwise(0.0))
    return A.reconstruction_audit(o, again, ["o_orderkey", "o_custkey", "o_totalprice"])


@query("SELECT c_custkey, c_name AS dim_c_name, c_nationkey AS dim_c_nationkey, sha256('=' || c_custkey || chr(31) || '=' || c_name || chr(31) || '=' || c_nationkey) AS content_hash, c_nationkey || chr(31) || c_custkey AS identity_key, n AS city_n, 0 AS city_none FROM customer, (SELECT count(*) AS n FROM events)")
def contract_columns(spark, sf):
    """A checked projection with identity and content hashes, prefixed columns and one row of the city's figures."""
    c = table(spark, sf, "customer").withColumn("run_at", F.current_timestamp())
    kept = R.project_contract(c, ["c_custkey", "c_name", "c_nationkey", "run_at"], ["c_custkey"], ["c_name"])
    hashed = R.history_hash(kept, ["c_nationkey", "c_custkey"], ["run_at"]).drop("run_at")
    city = table(spark, sf, "events").agg(F.count("*").alias("city_n"), F.lit(None).cast("int").alias("city_none"))
    return R.with_city_row(R.prefix_columns(hashed, "dim_", ["c_custkey", "content_hash", "identity_key"]), city, ["city_none"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS p_size, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS p_retailprice FROM part")
def mask_imputed(spark, sf):
    p = table(spark, sf, "part").withColumns({"a": F.col("p_partkey") % 3 == 0, "b": (F.col("p_partkey") % 5 == 0).cast("int")})
    return R.mask_imputed(p, {"p_size": "a", "p_retailprice": "b"}).select("p_partkey", "p_size", "p_retailprice")
