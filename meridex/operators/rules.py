"""Evidence-gated recommendations, reason codes, priorities and action plans, as column expressions and grouped jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .context import reasons
from .records import global_rank

# Thresholds of the recommendation rules.
MIN_CONTRIBUTION = 0.000001
MIN_POI = 3
HIGH_SPEED = 60
MIN_HISTORY = 2
SPATIAL_SHARE = 0.10
STRUCTURAL = ("speed_infra_mismatch", "pedestrian_exposure_gap", "narrow_fast_road", "junction_complexity_unregulated", "visibility_risk")
WEATHER_TOKENS = "precip|snow|freezing|ice|risk_adverse"
SPATIAL = ("road_length", "segment_latitude", "segment_longitude", "road_highway")
CALENDAR = ("calendar_is_rush_hour", "calendar_is_holiday")
# Order of priorities, plans by reason, and what counts as a strong signal.
PRIORITIES = ("critical", "high", "medium", "low", "monitor_only")
STRONG = ("severe_weather", "heavy_traffic", "road_repair", "major_event")
PLANS = {
    "patrol": ("DYNAMIC_TOP_1PCT", "DYNAMIC_TOP_5PCT"), "speed": ("DYNAMIC_TOP_1PCT", "DYNAMIC_TOP_5PCT"), "engineering": ("HOTSPOT_TOP_20", "HOTSPOT_TOP_50"), "weather": ("SEVERE_WEATHER",),
    "repair": ("ROAD_REPAIR",), "event": ("MAJOR_EVENT", "HEAVY_TRAFFIC"), "monitor": ("PROVIDER_DEGRADED",),
}
# Worth of priorities and the actions that each reason calls for.
WORTH = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25, "monitor_only": 0.1}
ACTIONS = {
    "DYNAMIC_TOP_1PCT": ("INCREASE_PATROL", "SPEED_MONITORING"), "DYNAMIC_TOP_5PCT": ("INCREASE_PATROL", "SPEED_MONITORING"), "HOTSPOT_TOP_20": ("ENGINEERING_INSPECTION",),
    "HOTSPOT_TOP_50": ("ENGINEERING_INSPECTION",), "ROAD_REPAIR": ("REPAIR_ZONE_SAFETY_REVIEW",), "MAJOR_EVENT": ("EVENT_TRAFFIC_CONTROL", "PEDESTRIAN_FLOW_MONITORING"), "HEAVY_TRAFFIC": ("CONGESTION_MONITORING",),
}
PERIODS = {"event": ("EVENT_TRAFFIC_CONTROL", "PEDESTRIAN_FLOW_MONITORING"), "repair": ("REPAIR_ZONE_SAFETY_REVIEW",), "weather": ("SPEED_MONITORING", "ROAD_SURFACE_CHECK", "DRIVER_WARNING"), "traffic": ("CONGESTION_MONITORING",)}


def truth(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin("1", "true", "yes", "да"), F.lit(False))


def _rank_pairs(pairs: Column, k: int, positive: bool) -> Column:
    """Names of the k largest positive, or the k most negative, of (value, name) pairs, the first name of equals first."""
    sign = -1 if positive else 1
    some = F.filter(pairs, lambda x: (x["value"] * sign) < 0)
    return F.transform(F.slice(F.array_sort(F.transform(some, lambda x: F.struct((x["value"] * sign).alias("value"), x["name"].alias("name")))), 1, k), lambda x: x["name"])


def recommendations(contributions: str, values: str, probability: str) -> dict[str, Column]:
    """Nine rules on a row's contributions (map of name to number) and values (map of name to text).

    `recommendations`: array of (rule, category, priority, features), in the rules' order. A rule that looks at the
    model needs a positive contribution of its feature besides its condition; the structural one needs neither history
    nor contributions. Missing names and values that are no numbers are 0 or false; among several features that qualify
    the first by name counts, or for points of interest the one that contributes most. `raising` and `lowering`: the
    five features that contribute most to either side.
    """
    shap, value, p = F.col(contributions), F.col(values), F.col(probability)
    text = lambda n: F.try_element_at(value, F.lit(n) if isinstance(n, str) else n)
    number = lambda n: F.coalesce(text(n).try_cast("double"), F.lit(0.0))
    gain = lambda n: F.coalesce(F.try_element_at(shap, F.lit(n)), F.lit(0.0))
    has = lambda n: gain(n) > MIN_CONTRIBUTION
    priority = F.when(p >= 0.35, "critical").when(p >= 0.20, "high").otherwise("medium")
    names = F.array_sort(F.coalesce(F.map_keys(F.map_filter(shap, lambda _, v: v > MIN_CONTRIBUTION)), F.array().cast("array<string>")))
    weather = F.filter(names, lambda n: n.startswith("weather_") & n.rlike(WEATHER_TOKENS) & (truth(text(n)) | (number(n) > 0)))
    near = F.filter(names, lambda n: n.startswith("poi_") & (number(n) >= MIN_POI))
    best_poi = F.array_sort(F.transform(near, lambda n: F.struct((-F.try_element_at(shap, n)).alias("g"), n.alias("n"))))[0]["n"]
    most = F.coalesce(F.array_max(F.map_values(shap)), F.lit(0.0))
    spatial = F.array_compact(F.array(*[F.when(has(n) & (gain(n) >= F.greatest(most, F.lit(0.0)) * SPATIAL_SHARE), F.lit(n)) for n in SPATIAL]))
    calendar = F.array_compact(F.array(*[F.when(has(n) & truth(text(n)), F.lit(n)) for n in CALENDAR]))
    flaws = F.array_compact(F.array(*[F.when(truth(text(n)), F.lit(n)) for n in STRUCTURAL]))
    history = number("segment_accidents_total_prior") >= MIN_HISTORY
    speed, unknown = "road_maxspeed_kmh", "road_maxspeed_missing"
    one = lambda n: F.array(F.lit(n) if isinstance(n, str) else n)
    rules = [
        ("historical_accidents", "inspection", has("segment_accidents_total_prior") & history, one("segment_accidents_total_prior")),
        ("structural_risk_flag", "inspection", ~history & (F.size(flaws) > 0), flaws),
        ("weather_hazard", "operational", F.size(weather) > 0, one(F.get(weather, F.lit(0)))),
        ("confirmed_high_speed", "long_term", has(speed) & (number(speed) >= HIGH_SPEED) & ~truth(text(unknown)), one(speed)),
        ("missing_speed_limit", "inspection", has(unknown) & truth(text(unknown)), one(unknown)),
        ("nearby_poi", "inspection", F.size(near) > 0, one(best_poi)),
        ("oneway", "inspection", has("road_oneway") & truth(text("road_oneway")), one("road_oneway")),
        ("road_spatial", "long_term", F.size(spatial) > 0, one(F.get(spatial, F.lit(0)))),
        ("positive_rush_holiday", "operational", F.size(calendar) > 0, one(F.get(calendar, F.lit(0)))),
    ]
    each = [
        F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(c).alias("category"), (F.lit("medium") if n == "structural_risk_flag" else priority).alias("priority"), f.alias("features")))
        for n, c, holds, f in rules
    ]
    pairs = F.transform(F.coalesce(F.map_entries(shap), F.array().cast("array<struct<key:string,value:double>>")), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("name")))
    return {"recommendations": F.array_compact(F.array(*each)), "raising": _rank_pairs(pairs, 5, True), "lowering": _rank_pairs(pairs, 5, False)}


def context_flags(weather: Column, traffic: Column, repairs: Column, events: Column) -> dict[str, Column]:
    """Flags of signals above their thresholds; a missing provider is no flag but makes the row degraded."""
    flags = reasons({"severe_weather": weather >= 0.60, "heavy_traffic": traffic >= 0.70, "road_repair": repairs > 0, "major_event": events > 0})
    return {"flags": flags, "degraded": weather.isNull() | traffic.isNull() | repairs.isNull() | events.isNull()}


def reason_codes(percentile: Column, hotspot_rank: Column, hotspot_percentile: Column, flags: Column, degraded: Column) -> Column:
    """Ordered reasons of a row; null signals don't hold."""
    top1, top5, hot20, hot50 = percentile >= 0.99, percentile >= 0.95, hotspot_rank <= 20, hotspot_rank <= 50
    number = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    signals = number(top5) + number(hot50) + F.size(F.array_intersect(flags, F.array(*map(F.lit, STRONG))))
    return reasons({
        "DYNAMIC_TOP_1PCT": top1, "DYNAMIC_TOP_5PCT": top5 & ~top1, "HOTSPOT_TOP_20": hot20, "HOTSPOT_TOP_50": hot50 & ~hot20,
        **{f.upper(): F.array_contains(flags, f) for f in STRONG},
        "MODEL_DISAGREEMENT": top5 & (hotspot_percentile < 0.50), "MULTI_SIGNAL_AGREEMENT": signals >= 3, "PROVIDER_DEGRADED": degraded,
    })


def operational_priority(codes: Column, degraded: Column) -> dict[str, Column]:
    """priority, uncertainty and plans by a row's reasons."""
    has = lambda *names: reduce(lambda a, b: a | b, [F.array_contains(codes, n) for n in names])
    strong = has(*[f.upper() for f in STRONG])
    priority = (
        F.when(has("DYNAMIC_TOP_1PCT") & ((has("HOTSPOT_TOP_20") & strong) | has("MULTI_SIGNAL_AGREEMENT")), "critical").when(has("DYNAMIC_TOP_1PCT", "DYNAMIC_TOP_5PCT") | strong, "high")
        .when(has("HOTSPOT_TOP_20", "HOTSPOT_TOP_50", "MODEL_DISAGREEMENT"), "medium").when(degraded, "monitor_only").otherwise("low")
    )
    uncertainty = F.when(degraded, "high").when(has("MODEL_DISAGREEMENT"), "medium").otherwise("low")
    return {"priority": priority, "uncertainty": uncertainty, "plans": reasons({k: has(*v) for k, v in PLANS.items()})}


def priority_rank(df: DataFrame, priority: str, order: list[Column]) -> DataFrame:
    """Adds `place`: by the order of priorities, then `order`."""
    level = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col(priority))
    return global_rank(df, [level, *order], "place")


# Fixed value: the display name of a road without one.
NO_ROAD = "участок дороги"
# What is said of an action, in three languages, around its code and place.
ADVICE = {
    "ru": ("Рассмотреть действие ", "code", " на участке ", "place", " в рекомендуемый период."),
    "kz": ("Ұсынылатын кезеңде ", "place", " учаскесінде ", "code", " әрекетін қарастыру."),
    "en": ("Consider ", "plain", " for ", "place", " during the recommended period."),
}
#: Columns of a plan's input that may be missing; missing ones are null.
OPTIONAL = {
    **dict.fromkeys(("road_name", "road_ref", "event_id", "event_name", "event_venue", "repair_id", "repair_title", "repair_road_name"), "string"),
    **dict.fromkeys(("rank", "hotspot_rank"), "bigint"), **dict.fromkeys(("lon", "lat", "weather"), "double"), "warnings": "array<string>",
}


def action_plan(df: DataFrame, at: Column, horizon: Column, top: int = 10, least: str = "medium", batch_id: str = "") -> DataFrame:
    """The best actions: (action_id, action, kind, label, display, segments, n, score, priority, reasons, uncertainty,
    start, end, basis, rank, percentile, hotspot_rank, hotspot, lon, lat, context, warnings, text (by language),
    requires_human_confirmation, place).

    `df` has a row for each segment: segment, codes, priority, uncertainty, percentile, hotspot, event_start, event_end,
    repair_start, repair_end, weather_start, weather_end, and those of `OPTIONAL` that it has. Rows of at least the
    priority `least` count, of medium ones those with a strong signal, and degraded monitor-only ones. Each reason calls
    for actions; one event or repair is one group, other segments group by road name, reference or their own id. A
    group's score is that of its row of the highest percentile (the smallest segment of equals), with its worst weather,
    size and uncertainty; ranks, centre, context and display name are of that row, warnings of all rows. The id is a hash
    of batch, action, display name and segments; actions of one score go by code and id. Groups are aggregated
    partially; `segments` grows with a road, not with the data.
    """
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in df.columns})
    codes, priority = F.col("codes"), F.col("priority")
    worth = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WORTH.items() for x in kv]), priority), F.lit(0.0))
    strong = F.arrays_overlap(codes, F.array(*[F.lit(f.upper()) for f in STRONG], F.lit("MULTI_SIGNAL_AGREEMENT")))
    degraded = F.array_contains(codes, "PROVIDER_DEGRADED")
    rows = df.where(((worth >= WORTH[least]) | ((priority == "monitor_only") & degraded)) & ((priority != "medium") | strong))
    catalogue = F.create_map(*[x for r, a in ACTIONS.items() for x in (F.lit(r), F.array(*map(F.lit, a)))])
    called = F.array_distinct(F.flatten(F.transform(codes, lambda c: F.coalesce(F.try_element_at(catalogue, c), F.array().cast("array<string>")))))
    acts = F.when(F.size(called) > 0, called).when(degraded, F.array(F.lit("CONTINUE_MONITORING"))).otherwise(called)
    each = rows.withColumns({"_worth": worth, "action": F.explode(acts)})
    of = lambda k: F.col("action").isin(*PERIODS[k])
    event, repair = of("event") & F.col("event_id").isNotNull(), of("repair") & F.col("repair_id").isNotNull()
    road = F.lower(F.trim(F.coalesce(F.nullif("road_name", F.lit("")), F.nullif("road_ref", F.lit("")), F.col("segment").cast("string"))))
    kind = F.when(event, "event").when(repair, "repair").otherwise("road")
    label = F.when(event, F.col("event_id").cast("string")).when(repair, F.col("repair_id").cast("string")).otherwise(road)
    level = F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("uncertainty"))
    per = each.groupBy("action", kind.alias("kind"), label.alias("label")).agg(
        F.max_by(F.struct("percentile", "hotspot", "_worth", *[c for c in OPTIONAL if c not in ("weather", "warnings")], *[f"{k}_{x}" for k in ("event", "repair", "weather") for x in ("start", "end")]), F.struct(F.coalesce("percentile", F.lit(0.0)), -F.col("segment"))).alias("b"),
        F.array_sort(F.collect_set("segment")).alias("segments"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("codes")))).alias("reasons"), F.max(F.coalesce("weather", F.lit(0.0))).alias("weather"), F.max(level).alias("level"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("warnings", F.array().cast("array<string>")))))).alias("warnings"),
    )
    n = F.size("segments")
    off = F.when(F.col("level") <= 1, 0.0).when(F.col("level") == 2, 0.05).otherwise(0.1)
    raw = 0.4 * F.coalesce("b.percentile", F.lit(0.0)) + 0.25 * F.coalesce("b.hotspot", F.lit(0.0)) + 0.2 * F.greatest("weather", F.lit(0.0)) + 0.1 * F.col("b._worth") + 0.05 * F.least(n / 5, F.lit(1.0)) - off
    score = F.round(F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)), 6)
    start = lambda x, z: F.when(of("event"), F.coalesce(F.col(f"b.event_{x}"), z)).when(of("repair"), F.coalesce(F.col(f"b.repair_{x}"), z)).when(of("weather"), F.coalesce(F.col(f"b.weather_{x}"), z)).when(of("traffic"), z)
    basis = reduce(lambda a, k: a.when(of(k), f"{k}_period"), PERIODS, F.when(F.lit(False), F.lit(""))).otherwise("prediction_horizon")
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(f"b.{c}"), F.lit("")) for c in names])
    display = F.when(of("event"), F.coalesce(first("event_venue", "event_name"), F.lit("event zone"))).when(of("repair"), F.coalesce(first("repair_road_name", "repair_title"), F.lit("repair zone")))
    display = display.otherwise(F.coalesce(first("road_name", "road_ref"), F.lit(NO_ROAD)))
    ids = F.array_join(F.array_sort(F.transform("segments", lambda x: x.cast("string"))), "|")
    named = lambda x: F.struct(F.lit(x).alias("type"), F.col(f"b.{x}_id").alias("source_id"), F.col("b.event_name" if x == "event" else "b.repair_title").alias("name"), F.col("b.event_venue" if x == "event" else "b.repair_road_name").alias("place"), F.col(f"b.{x}_start").alias("start"), F.col(f"b.{x}_end").alias("end"))
    words = {"code": F.col("action"), "plain": F.lower(F.replace("action", F.lit("_"), F.lit(" "))), "place": display}
    text = F.struct(*[F.concat(*[words[x] if x in words else F.lit(x) for x in parts]).alias(language) for language, parts in ADVICE.items()])
    out = per.select(F.substring(F.sha1(F.concat(F.lit(batch_id), "action", display, ids)), 1, 16).alias("action_id"), "action", "kind", "label", display.alias("display"), "segments", n.alias("n"), score.alias("score"), "reasons",
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("level").cast("int")).alias("uncertainty"), F.coalesce(start("start", at), at).alias("start"), F.coalesce(start("end", at), at + horizon).alias("end"), basis.alias("basis"),
        "b.rank", "b.percentile", "b.hotspot_rank", "b.hotspot", "b.lon", "b.lat", F.when(of("event"), named("event")).when(of("repair"), named("repair")).alias("context"), "warnings", text.alias("text"), F.lit(True).alias("requires_human_confirmation"))
    best = out.orderBy(F.desc("score"), "action", "action_id").limit(top)
    level = F.when(F.col("score") >= 0.8, "critical").when(F.col("score") >= 0.6, "high").when(F.col("score") >= 0.4, "medium").otherwise("monitor")
    return best.withColumns({"priority": level, "place": F.row_number().over(Window.orderBy(F.desc("score"), "action", "action_id"))})  # at most `top` rows


def citywide_warning(df: DataFrame, codes: str, code: str, segment: str, start: str | None = None, end: str | None = None, at: Column | None = None) -> DataFrame:
    """One row for a code that any row has: (warning_code, affected, start, end, basis); no row else.

    The period is the first known start and end of the rows that have the code, by segment, and `at` where none is.
    """
    hit = df.where(F.array_contains(codes, code))
    at = F.lit(None) if at is None else at
    known = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(segment))), at) if c else at
    one = hit.agg(F.count_distinct(segment).alias("affected"), known(start).alias("start"), known(end).alias("end"))
    return one.where("affected > 0").select(F.lit(code).alias("warning_code"), "affected", "start", "end", F.lit("weather_period").alias("basis"))


def plan_summary(df: DataFrame, plan: DataFrame, segment: str = "segment") -> DataFrame:
    """(segments_analyzed, actions_returned): sizes of a plan and its input, as one row."""
    return df.agg(F.count_distinct(segment).alias("segments_analyzed")).join(F.broadcast(plan.agg(F.count("*").alias("actions_returned"))))  # one row each
