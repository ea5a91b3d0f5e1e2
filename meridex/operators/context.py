"""Time intervals, freshness, and context features of entities from matched records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(start: Column, end: Column, win_start: Column, win_end: Column, open_end: Column) -> Column:
    """Whether [start, end] meets [win_start, win_end): an open end reaches on, a missing end that isn't open is a point."""
    point = start.isNotNull() & (start >= win_start) & (start < win_end)
    ranged = (start < win_end) & (end >= win_start)
    return F.coalesce(F.when(start.isNull(), F.lit(False)).when(end.isNotNull(), ranged).when(open_end, start < win_end).otherwise(point), F.lit(False))


def valid_at(df: DataFrame, start: str, end: str, at: Column) -> DataFrame:
    """Adds `stale`: not start <= at < end."""
    return df.withColumn("stale", ~F.coalesce((F.col(start) <= at) & (at < F.col(end)), F.lit(False)))


def ttl_freshness(readings: DataFrame, ttl: DataFrame, now: Column) -> DataFrame:
    """(provider, age_seconds, fresh, warning, degraded): every provider of `ttl`, with and without a reading."""
    last = readings.groupBy("provider").agg(F.max("collected_at").alias("collected_at"))
    got = ttl.join(last, "provider", "left").withColumn("age_seconds", now - F.col("collected_at"))
    fresh = F.coalesce((F.col("age_seconds") >= 0) & (F.col("age_seconds") <= F.col("ttl_seconds")), F.lit(False))
    warning = F.when(F.col("collected_at").isNull(), "missing").when(~fresh, "stale")
    return got.select("provider", "age_seconds", fresh.alias("fresh"), warning.alias("warning"), (~fresh).alias("degraded"))


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order; a null condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))


def known_at(records: DataFrame, known_from: str, starts: str, at: Column) -> DataFrame:
    """Records known by then, with a warning if they began before they were known."""
    return records.where(F.col(known_from) <= at).withColumn("early", F.coalesce(F.col(starts) < F.col(known_from), F.lit(False)))


def interval_features(matched: DataFrame, key: str, kind: Column, distance: Column, weight: Column, identity: str) -> DataFrame:
    """Aggregates of the records matched to each key: counts by kind, weights, nearest and primary record.

    The primary record is the nearest, null distances last, then the smallest identity.
    """
    m = matched.select(key, kind.alias("kind"), distance.alias("d"), weight.alias("w"), F.col(identity).alias("i"), "open_end", "starts_in")
    n = lambda c: F.sum(c.cast("long"))
    primary = F.min(F.struct(F.coalesce(F.col("d"), F.lit(float("inf"))).alias("d"), F.col("i").alias("i")))
    return m.groupBy(key).agg(
        F.count("*").alias("records"), n(F.col("kind") == "full").alias("full"), n(F.col("kind") == "partial").alias("partial"), F.sum("w").alias("weight_sum"), F.max("w").alias("weight_max"),
        F.min("d").alias("nearest"), n(F.coalesce("open_end", F.lit(False))).alias("open_ends"), F.min(F.when(F.col("starts_in") >= 0, F.col("starts_in"))).alias("next_start"), primary["i"].alias("primary"),
    )


def radius_features(matched: DataFrame, key: str, distance: Column, intensity: Column, radii: list[int]) -> DataFrame:
    """Counts within each radius, intensity sum and maximum, and the nearest distance."""
    m = matched.select(key, distance.alias("d"), intensity.alias("v"))
    within = [F.sum((F.col("d") <= r).cast("long")).alias(f"within_{r}") for r in radii]
    return m.groupBy(key).agg(*within, F.sum("v").alias("intensity_sum"), F.max("v").alias("intensity_max"), F.min("d").alias("nearest"))


def forecast_summary(points: DataFrame, key: str, value: str, thresholds: dict[str, float], step_hours: int) -> DataFrame:
    """Mean, extremes, population deviation, range, and hours above thresholds of a variable in each window."""
    above = [(F.sum((F.col(value) >= t).cast("long")) * step_hours).alias(n) for n, t in thresholds.items()]
    return points.groupBy(key).agg(F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.stddev_pop(value).alias("std"), (F.max(value) - F.min(value)).alias("span"), F.count(value).alias("points"), *above)


def worst_point(points: DataFrame, key: str, order: str, signals: dict[str, tuple[str, float, float]]) -> DataFrame:
    """The row of each key with the greatest severity, the earliest of equals: sum of weight * min(value / cap, 1)."""
    severity = sum((F.least(F.coalesce(F.col(c), F.lit(0.0)) / cap, F.lit(1.0)) * w for c, cap, w in signals.values()), F.lit(0.0))
    top = points.withColumn("_s", F.round(severity, 9)).groupBy(key).agg(F.max(F.struct(F.col("_s"), -F.col(order))).alias("t"), F.count("*").alias("points"))
    return top.select(key, F.col("t._s").alias("severity"), (-F.col("t.col2")).alias(order), "points")


def consecutive_changes(df: DataFrame, key: str, order: str, value: str, drop: float) -> DataFrame:
    """How often neighbours in time differ, and whether a value falls by at least `drop` from one to the next."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_b", before).groupBy(key).agg(F.sum(F.coalesce((F.col("_b") != F.col(value)).cast("long"), F.lit(0))).alias("changes"), F.max(F.coalesce(F.col("_b") - F.col(value) >= drop, F.lit(False))).alias("rapid_drop"))


def normalise_severity(df: DataFrame, value: str) -> DataFrame:
    """Values on a 0-1, 0-5 or 0-10 scale (told by the frame's greatest) to 0-1, with a flag for values out of range."""
    top = df.agg(F.max(value).alias("_t"))
    scale = F.when(F.col("_t") <= 1, 1.0).when(F.col("_t") <= 5, 5.0).otherwise(10.0)
    got = df.crossJoin(F.broadcast(top))  # one row
    return got.withColumns({"severity": F.least(F.greatest(F.col(value) / scale, F.lit(0.0)), F.lit(1.0)), "out_of_range": (F.col(value) < 0) | (F.col(value) > scale)}).drop("_t")


def hotspots(entities: DataFrame, counts: DataFrame, key: str, time: str, at: int, windows: dict[str, int | None]) -> DataFrame:
    """Strictly prior counts of every entity at one time, zeros included."""
    made = [F.sum(F.when(F.col(time) >= (at - w if w is not None else F.col(time)), F.col("n")).otherwise(0)).alias(n) for n, w in windows.items()]
    per = counts.where(F.col(time) < at).groupBy(key).agg(*made)
    return entities.join(per, key, "left").select(key, *[F.coalesce(n, F.lit(0)).alias(n) for n in windows])


def provider_coverage(log: DataFrame, provider: str, at: Column, ok: Column) -> DataFrame:
    return log.groupBy(provider).agg(F.count("*").alias("runs"), F.round(F.avg(ok.cast("double")), 6).alias("availability"), F.max(at).alias("last"), F.sum((~ok).cast("long")).alias("warnings"), F.max(~ok).alias("any_degraded"))


# Weights of severities and restrictions, and thresholds of the weather rules.
SEVERITY_WEIGHT = {"critical": 4.0, "high": 3.0, "medium": 2.0, "low": 1.0}
RESTRICTION_WEIGHT = {"full_closure": 2.0, "partial_closure": 1.5, "intersection_closure": 1.5, "single_lane_closure": 1.25, "lane_narrowing": 1.25}
FOG_M, HEAVY_RAIN, STRONG_WIND, FREEZING, DROP = 1000, 2.5, 10, 0, 5
STORM_IDS = (200, 201, 202, 210, 211, 212, 221, 230, 231, 232)


def _weight(c: Column, weights: dict[str, float], other: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.lower(c)), F.lit(other))


def _nearest(m: DataFrame, fields: list[str]) -> Column:
    """The record of the least distance, null ones last, then the smallest id."""
    return F.min_by(F.struct("id", *fields), F.struct(F.coalesce("distance", F.lit(float("inf"))), "id"))


def repair_features(matched: DataFrame, start: Column) -> DataFrame:
    """The repairs matched to each segment within a window that begins at `start` (epoch seconds), as one row.

    `matched`: segment, id, distance, confidence, valid_from, valid_to, event_type, severity, restriction, open_end.
    """
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    weight, r = _weight(F.col("severity"), SEVERITY_WEIGHT, 0.0), F.col("restriction")
    out = matched.groupBy("segment").agg(
        F.count_distinct("id").alias("repairs"), n(r == "full_closure").alias("full_closures"), n(r == "partial_closure").alias("partial_closures"), n(r.isin("single_lane_closure", "lane_narrowing")).alias("lane_closures"),
        n(r == "intersection_closure").alias("intersection_closures"), n(F.col("event_type") == "bridge_repair").alias("bridges"), n(weight >= 3).alias("high_severity"),
        F.round(F.sum(weight * F.col("confidence") * _weight(r, RESTRICTION_WEIGHT, 1.0)), 4).alias("disruption"), F.min("distance").alias("nearest"), F.max("confidence").alias("confidence"), n(F.col("open_end")).alias("open_ends"),
        F.min(F.greatest((F.col("valid_from") - start) / 3600, F.lit(0.0))).alias("hours_until_start"), _nearest(matched, ["valid_from", "valid_to"]).alias("p"),
    )
    return out.select("*", F.col("p.id").alias("source_id"), F.col("p.valid_from").alias("repair_start"), F.col("p.valid_to").alias("repair_end")).drop("p")


def event_features(matched: DataFrame, start: Column, end: Column, order: str | None = None) -> DataFrame:
    """The venue events matched to each segment within [start, end) (epoch seconds), as one row; an event counts once.

    `matched`: segment, id, distance, confidence, valid_from, valid_to, event_type, severity, intensity, venue. Of rows
    that repeat an event at a segment the nearest counts, of equally near ones the earliest, then the first by the column
    `order`, and then by what they hold, so that no tie is left to the order in which rows arrive.
    """
    row = F.struct("distance", "confidence", "valid_from", "valid_to", "event_type", "severity", "intensity", "venue")
    best = F.min_by(row, F.struct(F.coalesce("distance", F.lit(float("inf"))), "valid_from", *([order] if order else []), row.alias("row")))
    m = matched.groupBy("segment", "id").agg(best.alias("b")).select("segment", "id", "b.*")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    major, kind, v = F.col("severity") >= 4, F.col("event_type"), F.coalesce("intensity", F.lit(0.0))
    out = m.groupBy("segment").agg(
        F.count("*").alias("events"), *[n(F.col("distance") <= r).alias(f"within_{r}") for r in (500, 1000, 2000)], n(major).alias("major"), n(F.lower("venue").rlike("arena|stadium")).alias("stadium"),
        n(kind == "large_concert").alias("concerts"), n(kind.isin("football_match", "hockey_match", "sports_event")).alias("sports"), F.round(F.sum(v), 4).alias("intensity_sum"), F.max(v).alias("intensity_max"), F.min("distance").alias("nearest"),
        F.min(F.greatest((F.col("valid_from") - start) / 3600, F.lit(0.0))).alias("hours_until_start"), F.max(F.coalesce((F.col("valid_to") >= start) & (F.col("valid_to") < end) & major, F.lit(False)).cast("int")).alias("outflow_risk"),
        F.max("confidence").alias("confidence"), _nearest(m, ["venue", "valid_from", "valid_to"]).alias("p"),
    )
    return out.select("*", F.col("p.id").alias("source_id"), F.col("p.venue").alias("venue"), F.col("p.valid_from").alias("event_start"), F.col("p.valid_to").alias("event_end")).drop("p")


def forecast_features(points: DataFrame, key: str, order: str, step: int = 3) -> DataFrame:
    """Weather of each key's forecast points, as one row: summaries, hours of conditions, changes and scores.

    `points`: key, order, temperature, humidity, pressure, wind_speed, wind_gust, rain, snow, visibility, clouds, weather_id.
    """
    by = Window.partitionBy(key).orderBy(order)
    known = F.last("temperature", True).over(by.rowsBetween(Window.unboundedPreceding, -1))  # the one before that is known
    p = points.withColumns({"_t": known, "_w": F.lag("weather_id").over(by), "_n": F.row_number().over(by)})
    hours = lambda c: (F.sum(F.coalesce(c, F.lit(False)).cast("long")) * step)
    one = [f(c).alias(f"{c}_{n}") for c in ("temperature", "humidity", "pressure", "wind_speed", "visibility", "clouds") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))]
    t = F.col("temperature")
    got = p.groupBy(key).agg(
        *one, (F.max(t) - F.min(t)).alias("temperature_range"), F.max("wind_gust").alias("wind_gust_max"), F.coalesce(F.sum("rain"), F.lit(0.0)).alias("rain_sum"), F.coalesce(F.sum("snow"), F.lit(0.0)).alias("snow_sum"),
        hours(F.col("rain") > 0).alias("rain_hours"), hours(F.col("snow") > 0).alias("snow_hours"), hours(F.col("visibility") < FOG_M).alias("fog_hours"), hours(F.col("rain") >= HEAVY_RAIN).alias("heavy_rain_hours"),
        hours(F.col("wind_speed") >= STRONG_WIND).alias("strong_wind_hours"), hours(t <= FREEZING).alias("freezing_hours"), hours(F.col("weather_id").isin(*STORM_IDS)).alias("storm_hours"),
        F.sum(((F.col("_n") > 1) & ~F.col("weather_id").eqNullSafe(F.col("_w"))).cast("long")).alias("changes"), F.max(F.coalesce(F.col("_t") - t >= DROP, F.lit(False))).alias("rapid_drop"),
        F.coalesce((F.min(t) <= 0) & (F.max(t) > 0), F.lit(False)).alias("freeze_thaw"),
    )
    is_ = lambda c: (F.col(f"{c}_hours") > 0).cast("int")
    i = lambda c: F.col(c).cast("int")
    bad, surface = is_("rain") + is_("snow") + is_("fog") + is_("strong_wind") + is_("storm"), is_("rain") + 2 * is_("snow") + is_("freezing")
    unstable = F.col("changes") + i("rapid_drop") + i("freeze_thaw")
    driving = bad + surface + is_("fog")
    return got.withColumns({"instability": unstable, "bad_weather": bad, "road_surface": surface, "winter": is_("snow") + is_("freezing") + i("freeze_thaw"), "driving": driving, "severity": driving + unstable})


def day_summary(points: DataFrame, key: str, at: str, start: Column, step_hours: int = 3, expected: int = 9) -> DataFrame:
    """The forecast points of [start, start + 24 h] (`at` in epoch seconds) of each key: worst point, completeness, extremes."""
    signals = F.when(F.col("rain") > 0, 1).otherwise(0) + F.when(F.col("snow") > 0, 2).otherwise(0) + F.when(F.col("visibility") < FOG_M, 1).otherwise(0) + F.when(F.col("wind_speed") >= STRONG_WIND, 1).otherwise(0)
    p = points.where((F.col(at) >= start) & (F.col(at) <= start + 86400)).withColumn("_s", F.least(signals / 5, F.lit(1.0)))
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)))
    got = p.groupBy(key).agg(
        F.count("*").alias("points"), F.max("_s").alias("severity"), F.max(F.struct("_s", (-F.col(at)).alias("t"))).alias("w"), any_(F.col("rain") > 0).alias("rain_expected"), any_(F.col("snow") > 0).alias("snow_expected"),
        any_(F.col("rain") >= HEAVY_RAIN).alias("heavy_rain_expected"), F.min("visibility").alias("visibility_min"), F.max("wind_speed").alias("wind_max"), F.min("temperature").alias("temperature_min"), F.max("temperature").alias("temperature_max"),
    )
    return got.withColumns({"complete": F.col("points") >= expected, "severe": F.col("severity") >= 0.6, "worst_start": -F.col("w.t"), "worst_end": -F.col("w.t") + step_hours * 3600}).drop("w")
