"""Queries on intervals, context, rules and plans. Intervals are orders; scored entities are customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hours import hour_index
from ..operators import context as X
from ..operators import models as MO
from ..operators import records as RC
from ..operators import rules as R
from ..operators.tables import cut
from .registry import query, table

I = """i AS (SELECT o_orderkey AS id, o_custkey AS seg, epoch_us(o_orderdate) // 86400000000 AS s, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE epoch_us(o_orderdate) // 86400000000 + floor(o_totalprice / 50000)::BIGINT END AS e, o_orderkey % 14 = 0 AS open_end, CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'O' THEN 'partial' ELSE 'other' END AS kind, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 500)::DOUBLE END AS d, o_totalprice AS w FROM orders)"""
DAY = 10400
HIT = f"CASE WHEN e IS NOT NULL THEN s < {DAY} + 30 AND e >= {DAY} WHEN open_end THEN s < {DAY} + 30 ELSE s >= {DAY} AND s < {DAY} + 30 END"


def intervals(spark, sf):
    o = table(spark, sf, "orders")
    s = F.floor(hour_index("o_orderdate") / 24).cast("long")
    kind = F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "O", "partial").otherwise("other")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("seg"), s.alias("s"), F.when(F.col("o_orderkey") % 7 != 0, s + F.floor(F.col("o_totalprice") / 50000)).alias("e"),
        (F.col("o_orderkey") % 14 == 0).alias("open_end"), kind.alias("kind"), F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 500).cast("double")).alias("d"), F.col("o_totalprice").alias("w"),
    )


def hits(spark, sf):
    return intervals(spark, sf).where(X.overlaps(F.col("s"), F.col("e"), F.lit(DAY), F.lit(DAY + 30), F.col("open_end")))


@query(f"WITH {I} SELECT id, {HIT} AS hit FROM i")
def interval_overlap(spark, sf):
    return intervals(spark, sf).select("id", X.overlaps(F.col("s"), F.col("e"), F.lit(DAY), F.lit(DAY + 30), F.col("open_end")).alias("hit"))


@query(f"WITH {I} SELECT i.id, c_mktsegment FROM i JOIN customer ON c_custkey = seg WHERE {HIT}")
def overlap_join(spark, sf):
    return hits(spark, sf).join(table(spark, sf, "customer"), F.col("seg") == F.col("c_custkey")).select("id", "c_mktsegment")


@query(f"""WITH {I}, h AS (SELECT * FROM i WHERE {HIT}) SELECT seg, count(*) AS records, count(*) FILTER (kind = 'full') AS full, count(*) FILTER (kind = 'partial') AS partial, round(sum(w), 2) AS weight_sum, max(w) AS weight_max, min(d) AS nearest, count(*) FILTER (open_end) AS open_ends,
 min(s - {DAY}) FILTER (s >= {DAY}) AS next_start, min_by(id, (coalesce(d, 'inf'::DOUBLE), id)) AS primary FROM h GROUP BY 1""")
def interval_features_a(spark, sf):
    h = hits(spark, sf).withColumn("starts_in", F.col("s") - DAY)
    return X.interval_features(h, "seg", F.col("kind"), F.col("d"), F.col("w"), "id").withColumn("weight_sum", F.round("weight_sum", 2))


@query(f"WITH {I}, h AS (SELECT * FROM i WHERE {HIT}) SELECT seg, count(*) FILTER (d <= 100) AS within_100, count(*) FILTER (d <= 250) AS within_250, round(sum(w), 2) AS intensity_sum, max(w) AS intensity_max, min(d) AS nearest FROM h GROUP BY 1")
def interval_features_b(spark, sf):
    got = X.radius_features(hits(spark, sf), "seg", F.col("d"), F.col("w"), [100, 250])
    return got.withColumns({"within_100": F.coalesce("within_100", F.lit(0)), "within_250": F.coalesce("within_250", F.lit(0)), "intensity_sum": F.round("intensity_sum", 2)})


@query(f"WITH {I} SELECT count(DISTINCT seg) AS covered, round(count(*) / count(DISTINCT id), 6) AS per_record, min(d) AS lo, round(avg(d), 6) AS mean, max(d) AS hi FROM i")
def match_metrics(spark, sf):
    return intervals(spark, sf).agg(F.count_distinct("seg").alias("covered"), F.round(F.count("*") / F.count_distinct("id"), 6).alias("per_record"), F.min("d").alias("lo"), F.round(F.avg("d"), 6).alias("mean"), F.max("d").alias("hi"))


@query(f"WITH {I} SELECT seg, id FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY s DESC, id DESC) AS r FROM i WHERE d IS NOT NULL AND seg IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) WHERE r = 1")
def valid_matches(spark, sf):
    from ..operators.records import dedupe_first

    known = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("seg"))
    return dedupe_first(intervals(spark, sf).where("d is not null").join(known, "seg", "left_semi"), ["seg"], [F.desc("s"), F.desc("id")]).select("seg", "id")


@query(f"WITH {I} SELECT id, s + id % 5 AS known_from, id % 5 > 0 AS early FROM i WHERE s + id % 5 <= {DAY}")
def as_known_at(spark, sf):
    r = intervals(spark, sf).withColumn("known_from", F.col("s") + F.col("id") % 5)
    return X.known_at(r, "known_from", "s", F.lit(DAY)).select("id", "known_from", "early")


@query(f"WITH {I} SELECT id, list_filter([CASE WHEN d IS NULL THEN 'no_match' END, CASE WHEN e IS NULL AND NOT open_end THEN 'no_end' END, CASE WHEN kind = 'other' THEN 'irrelevant' END], lambda x: x IS NOT NULL) AS reasons, d IS NOT NULL AND NOT (e IS NULL AND NOT open_end) AND kind <> 'other' AS eligible FROM i")
def eligibility_reasons(spark, sf):
    why = X.reasons({"no_match": F.col("d").isNull(), "no_end": F.col("e").isNull() & ~F.col("open_end"), "irrelevant": F.col("kind") == "other"})
    return intervals(spark, sf).select("id", why.alias("reasons"), (F.size(why) == 0).alias("eligible"))


@query("""WITH n AS (SELECT max(epoch_us(ts)) // 1000000 AS now FROM events), t AS (SELECT unnest(['click', 'error', 'purchase', 'none']) AS provider, unnest([600, 1800, 60, 60]) AS ttl_seconds), l AS (SELECT event_type AS provider, max(epoch_us(ts) // 1000000) AS c FROM events GROUP BY 1)
 SELECT provider, now - c AS age_seconds, coalesce(now - c <= ttl_seconds, false) AS fresh, CASE WHEN c IS NULL THEN 'missing' WHEN now - c > ttl_seconds THEN 'stale' END AS warning, NOT coalesce(now - c <= ttl_seconds, false) AS degraded FROM t LEFT JOIN l USING (provider) CROSS JOIN n""")
def ttl_freshness(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("provider"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("collected_at"))
    now = e.agg(F.max("collected_at")).first()[0]
    ttl = spark.createDataFrame([("click", 600), ("error", 1800), ("purchase", 60), ("none", 60)], "provider string, ttl_seconds int")
    return X.ttl_freshness(e, ttl, F.lit(now))


W = "w AS (SELECT event_type, epoch_us(ts) // 3600000000 AS hour, avg(value) AS v FROM events GROUP BY 1, 2)"


def hourly(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", hour_index("ts").alias("hour")).agg(F.avg("value").alias("v"))


@query(f"WITH {W} SELECT event_type, round(avg(v), 6) AS mean, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(stddev_pop(v), 6) AS std, round(max(v) - min(v), 6) AS span, count(v) AS points, count(*) FILTER (v >= 20) * 3 AS strong_hours, count(*) FILTER (v >= 40) * 3 AS severe_hours FROM w GROUP BY 1")
def forecast_summary(spark, sf):
    got = X.forecast_summary(hourly(spark, sf), "event_type", "v", {"strong_hours": 20, "severe_hours": 40}, 3)
    return got.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi", "std", "span")], "points", "strong_hours", "severe_hours")


@query(f"WITH {W}, s AS (SELECT *, round(least(v / 60, 1) * 0.7 + least(hour % 24 / 23.0, 1) * 0.3, 9) AS sev FROM w) SELECT event_type, round(max(sev), 6)::DOUBLE AS severity, arg_max(hour, (sev, -hour)) AS hour, count(*) AS points FROM s GROUP BY 1")
def worst_period(spark, sf):
    h = hourly(spark, sf).withColumn("late", (F.col("hour") % 24).cast("double"))
    return X.worst_point(h, "event_type", "hour", {"v": ("v", 60.0, 0.7), "late": ("late", 23.0, 0.3)}).select("event_type", F.round("severity", 6).alias("severity"), "hour", "points")


@query(f"WITH {W}, l AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY hour) AS b FROM w) SELECT event_type, count(*) FILTER (b <> v) AS changes, bool_or(coalesce(b - v >= 30, false)) AS rapid_drop FROM l GROUP BY 1")
def consecutive_changes(spark, sf):
    return X.consecutive_changes(hourly(spark, sf), "event_type", "hour", "v", 30)


@query("SELECT p_partkey, round(least(greatest(p_size / 10.0, 0), 1), 6)::DOUBLE AS severity, p_size > 10 AS out_of_range FROM part")
def normalise_severity(spark, sf):
    return X.normalise_severity(table(spark, sf, "part"), "p_size").select("p_partkey", F.round("severity", 6).alias("severity"), "out_of_range")


H = f"c AS (SELECT o_custkey AS seg, epoch_us(o_orderdate) // 86400000000 AS day, count(*) AS n FROM orders GROUP BY 1, 2), h AS (SELECT k.c_custkey AS seg, coalesce(sum(n), 0)::BIGINT AS all_time, coalesce(sum(n) FILTER (day >= {DAY} - 30), 0)::BIGINT AS d30, coalesce(sum(n) FILTER (day >= {DAY} - 365), 0)::BIGINT AS d365 FROM customer k LEFT JOIN c ON c.seg = k.c_custkey AND day < {DAY} GROUP BY 1)"


def hot(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("seg"), F.floor(hour_index("o_orderdate") / 24).cast("long").alias("day")).agg(F.count("*").alias("n"))
    return X.hotspots(table(spark, sf, "customer").select(F.col("c_custkey").alias("seg")), c, "seg", "day", DAY, {"all_time": None, "d30": 30, "d365": 365})


@query(f"WITH {H} SELECT * FROM h")
def hotspots(spark, sf):
    return hot(spark, sf)


@query("SELECT event_type, count(*) AS runs, round(avg((value >= 5)::INT), 6) AS availability, max(epoch_us(ts)) AS last, count(*) FILTER (value < 5) AS warnings, bool_or(value < 5) AS any_degraded FROM events GROUP BY 1")
def provider_coverage(spark, sf):
    return X.provider_coverage(table(spark, sf, "events"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")), F.col("value") >= 5)


RISK = f"""{H}, r AS (SELECT seg, round((rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2) / count(*) OVER (), 6) AS pct, round((rank() OVER (ORDER BY all_time) + (count(*) OVER (PARTITION BY all_time) - 1) / 2) / count(*) OVER (), 6) AS hot,
 row_number() OVER (ORDER BY all_time DESC, seg) AS hot_rank, CASE WHEN seg % 13 = 0 THEN NULL ELSE (seg % 100) / 100.0 END AS weather, (seg % 37) / 37.0 AS traffic, seg % 17 = 0 AS rep, seg % 19 = 0 AS ev, c_nationkey FROM h JOIN customer ON c_custkey = seg),
 f AS (SELECT *, list_filter([CASE WHEN weather >= 0.60 THEN 'severe_weather' END, CASE WHEN traffic >= 0.70 THEN 'heavy_traffic' END, CASE WHEN rep THEN 'road_repair' END, CASE WHEN ev THEN 'major_event' END], lambda x: x IS NOT NULL) AS flags, weather IS NULL AS degraded FROM r),
 c2 AS (SELECT *, list_filter([CASE WHEN pct >= 0.99 THEN 'DYNAMIC_TOP_1PCT' END, CASE WHEN pct >= 0.95 AND pct < 0.99 THEN 'DYNAMIC_TOP_5PCT' END, CASE WHEN hot_rank <= 20 THEN 'HOTSPOT_TOP_20' END, CASE WHEN hot_rank BETWEEN 21 AND 50 THEN 'HOTSPOT_TOP_50' END,
 CASE WHEN list_contains(flags, 'severe_weather') THEN 'SEVERE_WEATHER' END, CASE WHEN list_contains(flags, 'heavy_traffic') THEN 'HEAVY_TRAFFIC' END, CASE WHEN rep THEN 'ROAD_REPAIR' END, CASE WHEN ev THEN 'MAJOR_EVENT' END,
 CASE WHEN pct >= 0.95 AND hot < 0.5 THEN 'MODEL_DISAGREEMENT' END, CASE WHEN (pct >= 0.95)::INT + (hot_rank <= 50)::INT + len(flags) >= 3 THEN 'MULTI_SIGNAL_AGREEMENT' END, CASE WHEN degraded THEN 'PROVIDER_DEGRADED' END], lambda x: x IS NOT NULL) AS codes FROM f),
 o AS (SELECT *, CASE WHEN pct >= 0.99 AND ((hot_rank <= 20 AND len(flags) > 0) OR list_contains(codes, 'MULTI_SIGNAL_AGREEMENT')) THEN 'critical' WHEN pct >= 0.95 OR len(flags) > 0 THEN 'high' WHEN hot_rank <= 50 THEN 'medium' WHEN degraded THEN 'monitor_only' ELSE 'low' END AS priority,
 CASE WHEN degraded THEN 'high' WHEN list_contains(codes, 'MODEL_DISAGREEMENT') THEN 'medium' ELSE 'low' END AS uncertainty FROM c2)"""


def risk(spark, sf):
    from ..operators.metrics import add_pct_average
    from ..operators.records import global_rank

    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "seg").join(hot(spark, sf), "seg")
    c = global_rank(add_pct_average(add_pct_average(c, "c_acctbal", "pct"), "all_time", "hot"), [F.desc("all_time"), F.col("seg")], "hot_rank")
    r = c.select("seg", F.round("pct", 6).alias("pct"), F.round("hot", 6).alias("hot"), "hot_rank", "c_nationkey", F.when(F.col("seg") % 13 != 0, (F.col("seg") % 100) / 100.0).alias("weather"), ((F.col("seg") % 37) / 37.0).alias("traffic"), (F.col("seg") % 17 == 0).cast("int").alias("rep"), (F.col("seg") % 19 == 0).cast("int").alias("ev"))
    r = r.withColumns(R.context_flags(F.col("weather"), F.col("traffic"), F.col("rep"), F.col("ev")))
    r = r.withColumn("codes", R.reason_codes(F.col("pct"), F.col("hot_rank"), F.col("hot"), F.col("flags"), F.col("degraded")))
    return r.withColumns(R.operational_priority(F.col("codes"), F.col("degraded")))


@query(f"WITH {RISK} SELECT seg, flags, degraded FROM o")
def context_flags(spark, sf):
    return risk(spark, sf).select("seg", "flags", "degraded")


@query(f"WITH {RISK} SELECT seg, codes FROM o")
def reason_codes(spark, sf):
    return risk(spark, sf).select("seg", "codes")


@query(f"""WITH {RISK} SELECT seg, priority, uncertainty, list_filter([CASE WHEN pct >= 0.95 THEN 'patrol' END, CASE WHEN pct >= 0.95 THEN 'speed' END, CASE WHEN hot_rank <= 50 THEN 'engineering' END, CASE WHEN list_contains(flags, 'severe_weather') THEN 'weather' END, CASE WHEN rep THEN 'repair' END, CASE WHEN ev OR list_contains(flags, 'heavy_traffic') THEN 'event' END, CASE WHEN degraded THEN 'monitor' END], lambda x: x IS NOT NULL) AS plans FROM o""")
def operational_priority(spark, sf):
    return risk(spark, sf).select("seg", "priority", "uncertainty", "plans")


@query(f"WITH {RISK} SELECT seg, priority, row_number() OVER (ORDER BY list_position(['critical', 'high', 'medium', 'low', 'monitor_only'], priority), pct DESC, hot_rank, seg) AS place FROM o")
def priority_rank(spark, sf):
    return R.priority_rank(risk(spark, sf), "priority", [F.desc("pct"), F.col("hot_rank"), F.col("seg")]).select("seg", "priority", "place")


# roads by nation, written in different cases; every fifth segment has only a reference, every tenth neither
ROADS = """CASE WHEN seg % 5 = 0 THEN NULL WHEN seg % 2 = 0 THEN ' ' || upper(n_name) ELSE n_name END AS road_name, CASE WHEN seg % 10 = 0 THEN NULL ELSE 'R' || (c_nationkey % 6) END AS road_ref,
 CASE WHEN ev AND seg % 2 = 0 THEN 'E' || (seg % 7) END AS event_id, CASE WHEN ev THEN 100 + seg % 5 END AS event_start, CASE WHEN ev AND seg % 3 > 0 THEN 110 + seg % 5 END AS event_end, CASE WHEN rep THEN 'P' || (seg % 5) END AS repair_id, CASE WHEN rep THEN 90 END AS repair_start, CASE WHEN rep AND seg % 3 = 0 THEN 130 END AS repair_end, 104 AS weather_start, 107 AS weather_end,
 CASE WHEN ev AND seg % 4 = 0 THEN 'Hall ' || (seg % 7) END AS event_venue, CASE WHEN ev THEN 'Gig ' || (seg % 7) END AS event_name, CASE WHEN rep AND seg % 2 = 0 THEN 'Works ' || (seg % 5) END AS repair_title, seg / 10.0 AS lon, seg / 20.0 AS lat, CASE WHEN seg % 3 = 0 THEN ['old', 'far'] WHEN seg % 13 = 0 THEN ['no weather'] END AS warnings"""


@query(f"""WITH {RISK}, s AS (SELECT o.*, {ROADS} FROM o JOIN nation ON n_nationkey = c_nationkey),
 a AS (SELECT unnest(['DYNAMIC_TOP_1PCT', 'DYNAMIC_TOP_1PCT', 'DYNAMIC_TOP_5PCT', 'DYNAMIC_TOP_5PCT', 'HOTSPOT_TOP_20', 'HOTSPOT_TOP_50', 'ROAD_REPAIR', 'MAJOR_EVENT', 'MAJOR_EVENT', 'HEAVY_TRAFFIC']) AS reason, unnest(['INCREASE_PATROL', 'SPEED_MONITORING', 'INCREASE_PATROL', 'SPEED_MONITORING', 'ENGINEERING_INSPECTION', 'ENGINEERING_INSPECTION', 'REPAIR_ZONE_SAFETY_REVIEW', 'EVENT_TRAFFIC_CONTROL', 'PEDESTRIAN_FLOW_MONITORING', 'CONGESTION_MONITORING']) AS action),
 k AS (SELECT * FROM s WHERE priority IN ('critical', 'high') OR (priority = 'medium' AND (len(flags) > 0 OR list_contains(codes, 'MULTI_SIGNAL_AGREEMENT'))) OR (priority = 'monitor_only' AND degraded)),
 e AS (SELECT DISTINCT k.*, action FROM (SELECT *, unnest(codes) AS reason FROM k) k JOIN a USING (reason)),
 m AS (SELECT * EXCLUDE (reason) FROM e UNION ALL SELECT k.*, 'CONTINUE_MONITORING' FROM k WHERE degraded AND NOT list_has_any(codes, (SELECT list(reason) FROM a))),
 g AS (SELECT *, CASE WHEN action IN ('EVENT_TRAFFIC_CONTROL', 'PEDESTRIAN_FLOW_MONITORING') AND event_id IS NOT NULL THEN 'event' WHEN action = 'REPAIR_ZONE_SAFETY_REVIEW' AND repair_id IS NOT NULL THEN 'repair' ELSE 'road' END AS kind FROM m),
 l AS (SELECT *, CASE kind WHEN 'event' THEN event_id WHEN 'repair' THEN repair_id ELSE lower(trim(coalesce(road_name, road_ref, seg::VARCHAR))) END AS label, row_number() OVER (PARTITION BY action, kind, CASE kind WHEN 'event' THEN event_id WHEN 'repair' THEN repair_id ELSE lower(trim(coalesce(road_name, road_ref, seg::VARCHAR))) END ORDER BY pct DESC, seg) AS best FROM g),
 q AS (SELECT action, kind, label, list_sort(list(seg)) AS segments, count(*)::INT AS n, list_sort(list_distinct(flatten(list(codes)))) AS reasons, max(coalesce(weather, 0)) AS w, max(CASE uncertainty WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS u, list_sort(list_distinct(flatten(list(coalesce(warnings, []))))) AS warned FROM l GROUP BY 1, 2, 3),
 z AS (SELECT q.*, b.pct AS percentile, b.hot AS hotspot, b.hot_rank AS hotspot_rank, b.lon::DOUBLE AS lon, b.lat::DOUBLE AS lat, CASE WHEN action IN ('EVENT_TRAFFIC_CONTROL', 'PEDESTRIAN_FLOW_MONITORING') THEN coalesce(event_venue, event_name, 'event zone') WHEN action = 'REPAIR_ZONE_SAFETY_REVIEW' THEN coalesce(repair_title, 'repair zone') ELSE coalesce(trim(road_name), road_ref, 'участок дороги') END AS display,
 CASE WHEN action IN ('EVENT_TRAFFIC_CONTROL', 'PEDESTRIAN_FLOW_MONITORING') THEN concat_ws('/', 'event', b.event_id, event_name, event_venue) WHEN action = 'REPAIR_ZONE_SAFETY_REVIEW' THEN concat_ws('/', 'repair', b.repair_id, repair_title) END AS context, round(greatest(least(0.4 * pct + 0.25 * hot + 0.2 * w + 0.1 * CASE b.priority WHEN 'critical' THEN 1 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0.1 END + 0.05 * least(n / 5, 1) - 0.05 * u, 1), 0), 6)::DOUBLE AS score,
 CASE WHEN action IN ('EVENT_TRAFFIC_CONTROL', 'PEDESTRIAN_FLOW_MONITORING') THEN coalesce(event_start, 100) WHEN action = 'REPAIR_ZONE_SAFETY_REVIEW' THEN coalesce(repair_start, 100) WHEN action = 'SPEED_MONITORING' THEN weather_start ELSE 100 END AS start,
 CASE WHEN action IN ('EVENT_TRAFFIC_CONTROL', 'PEDESTRIAN_FLOW_MONITORING') THEN coalesce(event_end, 100) WHEN action = 'REPAIR_ZONE_SAFETY_REVIEW' THEN coalesce(repair_end, 100) WHEN action = 'SPEED_MONITORING' THEN weather_end WHEN action = 'CONGESTION_MONITORING' THEN 100 ELSE 124 END AS "end",
 CASE WHEN action IN ('EVENT_TRAFFIC_CONTROL', 'PEDESTRIAN_FLOW_MONITORING') THEN 'event_period' WHEN action = 'REPAIR_ZONE_SAFETY_REVIEW' THEN 'repair_period' WHEN action = 'SPEED_MONITORING' THEN 'weather_period' WHEN action = 'CONGESTION_MONITORING' THEN 'traffic_period' ELSE 'prediction_horizon' END AS basis
 FROM q JOIN l b USING (action, kind, label) WHERE b.best = 1),
 y AS (SELECT *, substr(sha1('b1' || action || display || array_to_string(list_sort(list_transform(segments, lambda x: x::VARCHAR)), '|')), 1, 16) AS action_id FROM z)
 SELECT action_id, action, kind, label, display, segments, n, score, reasons, ['low', 'medium', 'high'][u + 1] AS uncertainty, start, "end", basis, percentile, hotspot, hotspot_rank, lon, lat, context, warned AS warnings, 'Consider ' || lower(replace(action, '_', ' ')) || ' for ' || display || ' during the recommended period.' AS advice, CASE WHEN score >= 0.8 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'monitor' END AS priority, row_number() OVER (ORDER BY score DESC, action, action_id) AS place FROM y ORDER BY place LIMIT 20""")
def action_plan(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    seg, ev, rep = F.col("seg"), F.col("ev") == 1, F.col("rep") == 1
    made = {
        "road_name": F.when(seg % 5 != 0, F.when(seg % 2 == 0, F.concat(F.lit(" "), F.upper("n_name"))).otherwise(F.col("n_name"))), "road_ref": F.when(seg % 10 != 0, F.concat(F.lit("R"), F.col("c_nationkey") % 6)),
        "event_id": F.when(ev & (seg % 2 == 0), F.concat(F.lit("E"), seg % 7)), "event_start": F.when(ev, 100 + seg % 5), "event_end": F.when(ev & (seg % 3 > 0), 110 + seg % 5),
        "repair_id": F.when(rep, F.concat(F.lit("P"), seg % 5)), "repair_start": F.when(rep, 90), "repair_end": F.when(rep & (seg % 3 == 0), 130), "weather_start": F.lit(104), "weather_end": F.lit(107),
        "event_venue": F.when(ev & (seg % 4 == 0), F.concat(F.lit("Hall "), seg % 7)), "event_name": F.when(ev, F.concat(F.lit("Gig "), seg % 7)), "repair_title": F.when(rep & (seg % 2 == 0), F.concat(F.lit("Works "), seg % 5)),
        "lon": seg / 10, "lat": seg / 20, "warnings": F.when(seg % 3 == 0, F.array(F.lit("old"), F.lit("far"))).when(seg % 13 == 0, F.array(F.lit("no weather"))),
    }
    rows = cut(risk(spark, sf)).join(n, "c_nationkey").withColumns(made).withColumnsRenamed({"seg": "segment", "pct": "percentile", "hot": "hotspot", "hot_rank": "hotspot_rank"})
    context = F.when(F.col("context").isNotNull(), F.concat_ws("/", *[f"context.{x}" for x in ("type", "source_id", "name", "place")]))
    return R.action_plan(rows, F.lit(100), F.lit(24), 20, batch_id="b1").withColumns({"context": context, "advice": F.col("text.en")}).drop("rank", "text", "requires_human_confirmation")


@query(f"WITH {RISK} SELECT 'SEVERE_WEATHER' AS warning_code, count(DISTINCT seg) AS affected, coalesce(min_by(seg + 1000, seg) FILTER (seg % 4 = 1), 7) AS start, coalesce(min_by(seg + 2000, seg) FILTER (seg % 400 = 399), 7) AS \"end\", 'weather_period' AS basis FROM o WHERE list_contains(codes, 'SEVERE_WEATHER') HAVING count(*) > 0")
def citywide_warning(spark, sf):
    seg = F.col("seg")
    rows = risk(spark, sf).withColumns({"first": F.when(seg % 4 == 1, seg + 1000), "last": F.when(seg % 400 == 399, seg + 2000)})
    return R.citywide_warning(rows, "codes", "SEVERE_WEATHER", "seg", "first", "last", F.lit(7))


@query("""WITH v AS (SELECT p_partkey, p_size / 100.0 AS p, p_partkey % 4 AS hist, (p_size - 20) / 50.0 AS g_hist, p_size % 5 = 0 AS narrow, (p_partkey % 7 - 3) / 10.0 AS g_snow, p_partkey % 2 AS snow, 20 + p_partkey % 9 * 10 AS speed, (p_retailprice - 1200) / 500 AS g_speed, p_partkey % 6 = 0 AS unknown, (p_partkey % 5 - 1) / 10.0 AS g_unknown, p_partkey % 8 AS schools, p_partkey % 11 / 20.0 AS g_schools, p_partkey % 9 AS stops, p_partkey % 13 / 20.0 AS g_stops, p_partkey % 3 = 0 AS oneway, (p_partkey % 10 - 4) / 10.0 AS g_oneway, (p_partkey % 12 - 2) / 40.0 AS g_length, p_partkey % 10 = 1 AS rush, (p_size - 10) / 80.0 AS g_rush FROM part),
 x AS (SELECT *, greatest(g_hist, g_snow, g_speed, g_unknown, g_schools, g_stops, g_oneway, g_length, g_rush) AS most, CASE WHEN p >= 0.35 THEN 'critical' WHEN p >= 0.20 THEN 'high' ELSE 'medium' END AS pr FROM v),
 u AS (SELECT p_partkey, unnest(['segment_accidents_total_prior', 'weather_snow_now', 'road_maxspeed_kmh', 'road_maxspeed_missing', 'poi_education_250m', 'poi_transit_stop_250m', 'road_oneway', 'road_length', 'calendar_is_rush_hour']) AS name, unnest([g_hist, g_snow, g_speed, g_unknown, g_schools, g_stops, g_oneway, g_length, g_rush]) AS g FROM x),
 w AS (SELECT p_partkey, list(name ORDER BY g DESC, name) FILTER (g > 0) AS up, list(name ORDER BY g, name) FILTER (g < 0) AS down FROM u GROUP BY 1)
 SELECT x.p_partkey, list_filter([CASE WHEN g_hist > 1e-6 AND hist >= 2 THEN 'historical_accidents/' || pr || '/segment_accidents_total_prior' END, CASE WHEN hist < 2 AND narrow THEN 'structural_risk_flag/medium/narrow_fast_road' END, CASE WHEN g_snow > 1e-6 AND snow > 0 THEN 'weather_hazard/' || pr || '/weather_snow_now' END, CASE WHEN g_speed > 1e-6 AND speed >= 60 AND NOT unknown THEN 'confirmed_high_speed/' || pr || '/road_maxspeed_kmh' END,
 CASE WHEN g_unknown > 1e-6 AND unknown THEN 'missing_speed_limit/' || pr || '/road_maxspeed_missing' END, CASE WHEN (g_schools > 1e-6 AND schools >= 3) OR (g_stops > 1e-6 AND stops >= 3) THEN 'nearby_poi/' || pr || CASE WHEN g_schools > 1e-6 AND schools >= 3 AND NOT (g_stops > g_schools AND stops >= 3) THEN '/poi_education_250m' ELSE '/poi_transit_stop_250m' END END,
 CASE WHEN g_oneway > 1e-6 AND oneway THEN 'oneway/' || pr || '/road_oneway' END, CASE WHEN g_length > 1e-6 AND g_length >= most * 0.1 THEN 'road_spatial/' || pr || '/road_length' END, CASE WHEN g_rush > 1e-6 AND rush THEN 'positive_rush_holiday/' || pr || '/calendar_is_rush_hour' END], lambda r: r IS NOT NULL) AS fired, coalesce(up[1:5], []) AS raising, coalesce(down[1:5], []) AS lowering FROM x JOIN w USING (p_partkey)""")
def local_rules(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = {
        "segment_accidents_total_prior": (k % 4, (size - 20) / 50), "narrow_fast_road": (size % 5 == 0, None), "weather_snow_now": (k % 2, (k % 7 - 3) / 10), "road_maxspeed_kmh": (20 + k % 9 * 10, (F.col("p_retailprice") - 1200) / 500),
        "road_maxspeed_missing": (k % 6 == 0, (k % 5 - 1) / 10), "poi_education_250m": (k % 8, k % 11 / 20), "poi_transit_stop_250m": (k % 9, k % 13 / 20), "road_oneway": (k % 3 == 0, (k % 10 - 4) / 10), "road_length": (F.lit("120.5"), (k % 12 - 2) / 40), "calendar_is_rush_hour": (k % 10 == 1, (size - 10) / 80),
    }
    values = F.create_map(*[x for n, (v, _) in rows.items() for x in (F.lit(n), v.cast("string"))])
    gains = F.create_map(*[x for n, (_, g) in rows.items() if g is not None for x in (F.lit(n), g.cast("double"))])
    p = table(spark, sf, "part").select("p_partkey", values.alias("v"), gains.alias("g"), (size / 100).alias("p"))
    got = p.withColumns(R.recommendations("g", "v", "p"))
    fired = F.transform("recommendations", lambda r: F.concat_ws("/", r["rule"], r["priority"], F.concat_ws(",", r["features"])))
    return got.select("p_partkey", fired.alias("fired"), "raising", "lowering")


@query("WITH t AS (SELECT s_suppkey, 0.25 + s_acctbal / 100000 AS v, 0.2 + s_acctbal / 90000 AS te FROM supplier) SELECT s_suppkey, v >= 0.25 * 1.03 AND te >= 0.2 AND s_suppkey % 3 <> 0 AS accepted FROM t")
def accept_rule(spark, sf):
    s = table(spark, sf, "supplier")
    c = {"val_pr": 0.25 + F.col("s_acctbal") / 100000, "test_pr": 0.2 + F.col("s_acctbal") / 90000, "fold_std": F.when(F.col("s_suppkey") % 3 == 0, 0.02).otherwise(0.001), "ece": F.lit(0.02)}
    b = {"val_pr": F.lit(0.25), "test_pr": F.lit(0.2), "fold_std": F.lit(0.0), "ece": F.lit(0.02)}
    return s.select("s_suppkey", MO.accept_rule(c, b).alias("accepted"))


@query(f"WITH {RISK} SELECT seg, {{'percentile': pct, 'hotspot': hot}} AS scores, {{'flags': flags, 'weather': weather::DOUBLE}} AS context FROM o WHERE priority IN ('critical', 'high')")
def public_view(spark, sf):
    rows = risk(spark, sf).where("priority in ('critical', 'high')").withColumn("weather", F.coalesce("weather", F.lit(float("nan"))))
    return RC.public_view(rows, ["seg"], {"scores": {"percentile": "pct", "hotspot": "hot"}, "context": {"flags": "flags", "weather": "weather"}})


@query(f"WITH {I} SELECT id, NOT coalesce(s <= {DAY} AND {DAY} < e, false) AS stale FROM i")
def snapshot_valid_at(spark, sf):
    i = intervals(spark, sf)
    return X.valid_at(i, "s", "e", F.lit(DAY)).select("id", "stale")
