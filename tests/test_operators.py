"""Hand-made cases: boundaries, ties, nulls, repeated rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meridex.functions import geo as G
from meridex.functions import hours as HR
from meridex.functions import text as T
from meridex.operators import audit as A
from meridex.operators import context as X
from meridex.operators import history as H
from meridex.operators import joins as J
from meridex.operators import labels as L
from meridex.operators import metrics as M
from meridex.operators import models as MO
from meridex.operators import records as R
from meridex.operators import rules as RU
from meridex.operators import spatial as S

BASE = 473_352  # an hour index: 2024-01-01 00:00


def test_hour_counts_and_strict_windows(spark):
    ev = spark.createDataFrame([("s1", datetime(2024, 1, 2, 10, 15)), ("s1", datetime(2024, 1, 2, 10, 40)), ("s1", datetime(2024, 1, 3, 10, 0)), ("s2", datetime(2024, 1, 2, 11, 0))], "seg string, ts timestamp_ntz")
    c = H.event_counts(ev, "seg", "ts")
    got = {(r.entity, r.hour - BASE): r for r in H.own_prior_counts(c, {"total": None, "day": 24}).collect()}
    assert got["s1", 34].n == 2 and (got["s1", 34].total, got["s1", 34].hours_since_prev, got["s1", 34].has_history) == (0, -1.0, False)
    r = got["s1", 58]
    assert (r.total, r.day, r.hours_since_prev, r.has_history) == (2, 2, 24.0, True)


def test_forward_label_edges(spark):
    c = spark.createDataFrame([("a", 100, 1)], "entity string, hour long, n long")
    obs = spark.createDataFrame([("a", h) for h in (75, 76, 99, 100)], "entity string, hour long")
    got = {r.hour: r.target for r in H.forward_label(obs, c, 24).collect()}
    assert got == {75: 0, 76: 1, 99: 1, 100: 0}
    assert sorted(r.hour for r in L.positives_window(c.union(spark.createDataFrame([("b", 10, 1)], c.schema)), 24).where("entity = 'a'").collect()) == list(range(76, 100))


def test_asof_is_strict(spark):
    right = spark.createDataFrame([("k", 1, 10.0), ("k", 5, 50.0)], "k string, t long, v double")
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 6), ("x", 9)], "k string, t long")
    got = {(r.k, r.t): r.v_asof for r in H.asof_strict(left, right, "k", "v", "t").collect()}
    assert got == {("k", 1): None, ("k", 5): 10.0, ("k", 6): 50.0, ("x", 9): None}


def test_bracket_needs_both_sides(spark):
    p = spark.createDataFrame([("c", 0, 10.0, "a"), ("c", 3, 40.0, "b"), ("c", 20, 0.0, "c")], "c string, t long, v double, cat string")
    w = spark.createDataFrame([("c", t) for t in (0, 1, 2, 10, 30)], "c string, t long")
    got = {r.t: (r.interpolated, r.category) for r in H.asof_bracket(p, w, ["c"], "t", "v", "cat", 6).collect()}
    assert got == {0: (10.0, "a"), 1: (20.0, "a"), 2: (30.0, "b"), 10: (None, None), 30: (None, None)}


def test_negatives_are_exact_disjoint_and_repeatable(spark):
    taken = {(e, h) for e in range(10) for h in range(5)}
    pos = spark.createDataFrame(sorted(taken), "entity long, hour long")
    mem = spark.createDataFrame([(e, "s" if e % 2 else "t") for e in range(200)], "entity long, stratum string")
    one = [tuple(r) for r in L.sample_negatives(pos, mem, 3).collect()]
    assert sorted(one) == sorted(tuple(r) for r in L.sample_negatives(pos.orderBy(F.rand()), mem, 3).collect())
    assert len(set(one)) == len(one) == 150 and not {(e, h) for h, e in one} & taken
    assert all(sum(e % 2 for h, e in one if h == k) == 15 for k in range(5))
    few = spark.createDataFrame([(e, "s" if e < 12 else "t") for e in range(60)], "entity long, stratum string")
    more = {tuple(r) for r in L.sample_negatives(pos, few, 3).collect()}
    assert len(more) == 150 and {(h, e) for h in range(5) for e in (10, 11)} <= more and not {(e, h) for h, e in more} & taken
    with pytest.raises(ValueError, match="free members"):
        L.sample_negatives(pos, few, 3, fallback=False)
    with pytest.raises(ValueError, match="free members"):
        L.sample_negatives(pos, few, 6)


def test_metrics_and_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)], "s double, y int")
    assert M.roc_auc(df, "s", "y").first()[0] == 1 and M.pr_auc(df, "s", "y").first()[0] == 1
    tied = spark.createDataFrame([(0.5, y) for y in (1, 0, 0, 1)], "s double, y int")
    assert M.roc_auc(tied, "s", "y").first()[0] == 0.5 and M.pr_auc(tied, "s", "y").first()[0] == 0.5
    empty = df.limit(0)
    assert M.roc_auc(empty, "s", "y").first()[0] is None and M.best_f1(df, "s", "y").first().threshold == 0.8


def test_intervals(spark):
    df = spark.createDataFrame([(1, 5, 20, False), (2, 31, 40, False), (3, 1, None, True), (4, 1, None, False), (5, 12, None, False), (6, None, None, True)], "i int, s int, e int, o boolean")
    hit = X.overlaps(F.col("s"), F.col("e"), F.lit(10), F.lit(30), F.col("o"))
    assert {r.i: r.h for r in df.select("i", hit.alias("h")).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_severity_scale(spark):
    df = spark.createDataFrame([(3.0,), (5.0,), (0.0,), (None,)], "v double")
    assert [r.severity for r in X.normalise_severity(df, "v").orderBy(F.desc_nulls_last("v")).collect()][:3] == [1.0, 0.6, 0.0]


def test_upserts(spark):
    row = "p string, i string, seg string, d double, h string, created_at int, updated_at int"
    make = lambda rows, t: spark.createDataFrame([(p, i, s, d, f"{d}", t, t) for p, i, s, d in rows], row)
    first = make([("x", "1", "a", 1.0), ("x", "1", "b", 2.0), ("y", "2", "a", 3.0)], 1)
    nothing = first.limit(0)
    assert [r.status for r in R.upsert(nothing, first.union(first), ["p", "i", "seg"], "h").collect()] == ["new"] * 3
    second = make([("x", "1", "a", 9.0)], 2)
    got = {(r.p, r.seg): r for r in R.upsert_scoped(first, second, ["p", "i", "seg"], ["p", "i"], "h").collect()}
    assert {k: r.status for k, r in got.items()} == {("x", "a"): "updated", ("x", "b"): "deleted", ("y", "a"): "kept"}
    assert (got["x", "a"].created_at, got["x", "a"].updated_at, got["x", "a"].d) == (1, 2, 9.0)


def test_required_and_bins(spark):
    df = spark.createDataFrame([(None, 1.0), (1, None), (2, 100.0), (3, 100.1)], "i int, x double")
    why = R.first_failure({"no_id": F.col("i").isNull(), "no_x": F.col("x").isNull()})
    assert [r[0] for r in df.select(why).collect()] == ["no_id", "no_x", "kept", "kept"]
    assert [r[0] for r in df.select(R.bin_label(F.col("x"), [100], ["near", "far"])).collect()] == ["near", None, "near", "far"]
    with pytest.raises(ValueError):
        R.risk_level(F.col("x"), [(0.1, "a")])
    with pytest.raises(KeyError):
        R.lookup_ordered(df, "i", [2, 77])


def test_global_rank_and_even_sample(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    assert all(r.k + 1 == r.r for r in R.global_rank(df, [F.col("k")], "r").collect())
    assert sorted(r.k for r in R.even_sample(df, ["k"], 4).collect()) == [0, 333, 666, 999]


def test_geometry(spark):
    wkt = spark.createDataFrame([("LINESTRING (0 0, 3 4, 3 10)",), ("POINT (1 2)",), ("LINESTRING (a b, 1 2)",)], "w string").select(G.wkt_points(F.col("w")).alias("l"))
    rows = wkt.withColumns({"n": G.polyline_length(F.col("l")), "m": G.polyline_midpoint(F.col("l"))}).collect()
    assert rows[0].n == 11 and (rows[0].m.x, rows[0].m.y) == (3.0, 4.5) and rows[1].l is None and rows[2].l is None
    seg = spark.createDataFrame([("1_2_0", 0.0, 0.0, 10.0, 0.0), ("2_3_0", 10.0, 0.0, 20.0, 0.0), ("far", 900.0, 900.0, 910.0, 900.0)], "seg string, ax double, ay double, bx double, by double")
    line = spark.createDataFrame([(1, 5.0, 0.0, 15.0, 0.0)], "line int, ax double, ay double, bx double, by double")
    assert {r.seg for r in S.line_intersections(line, seg, 7.0).collect()} == {"1_2_0", "2_3_0"}
    pts = spark.createDataFrame([(1, 10.0, 3.0), (2, 500.0, 500.0)], "id int, x double, y double")
    near = {r.id: (r.seg, round(r.distance, 3)) for r in S.nearest_segment(pts, seg, 2.0).collect()}
    assert near == {1: ("1_2_0", 3.0), 2: ("far", round((400**2 * 2) ** 0.5, 3))}
    ring = spark.createDataFrame([(1, [(-5.0, -5.0), (30.0, -5.0), (30.0, 5.0), (-5.0, 5.0)])], "poly int, ring array<struct<x:double,y:double>>")
    assert {r.seg for r in S.polygon_intersections(ring, seg, 8.0).collect()} == {"1_2_0", "2_3_0"}


def test_shortest_paths(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (8, 9, 1.0)], "a int, b int, cost double")
    q = spark.createDataFrame([("p", 1, 3), ("none", 1, 9)], "request string, source int, target int")
    assert {r.request: (r.cost, r.path) for r in J.shortest_paths(e, q).collect()} == {"p": (2.0, [1, 2, 3]), "none": (None, None)}
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(0, 40, 100.0)], "a int, b int, cost double")
    assert J.shortest_paths(chain, spark.createDataFrame([("far", 0, 40)], "request string, source int, target int")).first().cost == 40.0


def test_section_between_boundary_streets(spark):
    edges = spark.createDataFrame([("turan", 1, 2, 1.0), ("turan", 2, 3, 1.0), ("turan", 3, 4, 1.0), ("a", 1, 10, 1.0), ("b", 3, 11, 1.0), ("c", 20, 21, 1.0)], "road string, a int, b int, cost double")
    asked = spark.createDataFrame([("x", "turan", "a", "b"), ("y", "turan", "a", "c")], "section string, road string, from_street string, to_street string")
    assert {r.section: r.path for r in J.section_path(edges, asked).collect()} == {"x": [1, 2, 3], "y": None}


def test_names_match_wherever_one_contains_the_other(spark):
    a = spark.createDataFrame([("turan avenue",), ("ab",), ("xaby",), ("",), (None,)], "a string")
    b = spark.createDataFrame([("north turan avenue",), ("ave",), ("b",), ("zzz",), (None,)], "b string")
    got = {tuple(r) for r in J.name_match(a, b, "a", "b").collect()}
    assert got == {("turan avenue", "north turan avenue"), ("turan avenue", "ave"), ("ab", "b"), ("xaby", "b")}


def test_enrich_refuses_repeats(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        J.enrich(spark.range(2).select(F.col("id").cast("int").alias("k")), d, ["k"])


def test_rules_and_priorities(spark):
    rows = [(0.995, 10, 0.98, ["severe_weather", "heavy_traffic"], False), (0.20, 300, 0.1, [], True), (0.96, 400, 0.3, [], False), (0.5, 40, 0.9, [], False), (0.5, 40, 0.9, ["road_repair"], False), (0.5, 90, 0.9, [], False)]
    df = spark.createDataFrame(rows, "p double, r int, h double, f array<string>, d boolean")
    c = df.withColumn("c", RU.reason_codes(*map(F.col, "prhfd")))
    got = c.withColumns(RU.operational_priority(F.col("c"), F.col("d"))).collect()
    assert got[0].priority == "critical" and {"DYNAMIC_TOP_1PCT", "HOTSPOT_TOP_20", "MULTI_SIGNAL_AGREEMENT"} <= set(got[0].c) and got[0].plans == ["patrol", "speed", "engineering", "weather", "event"]
    assert (got[1].priority, got[1].uncertainty, got[1].c, got[1].plans) == ("monitor_only", "high", ["PROVIDER_DEGRADED"], ["monitor"])
    assert (got[2].priority, got[2].uncertainty, got[2].c) == ("high", "medium", ["DYNAMIC_TOP_5PCT", "MODEL_DISAGREEMENT"])
    assert [(r.priority, r.c) for r in got[3:]] == [("medium", ["HOTSPOT_TOP_50"]), ("high", ["HOTSPOT_TOP_50", "ROAD_REPAIR"]), ("low", [])]


def test_action_plan_groups_and_score(spark):
    columns = "segment int, codes array<string>, priority string, uncertainty string, percentile double, hotspot double, weather double, road_name string, road_ref string, event_id string, event_start int, event_end int, repair_id string, repair_start int, repair_end int, weather_start int, weather_end int"
    quiet = [None] * 8
    rows = [
        (0, ["DYNAMIC_TOP_1PCT", "SEVERE_WEATHER"], "critical", "low", 0.99, 0.9, 1.0, "Main", "R1", *quiet),
        (1, ["DYNAMIC_TOP_1PCT"], "critical", "low", 0.98, 0.9, 1.0, " main ", None, *quiet),
        (2, ["MAJOR_EVENT"], "high", "low", 0.5, 0.1, None, "Main", None, "e1", 5, 9, None, None, None, None, None),
        (3, ["MAJOR_EVENT"], "high", "medium", 0.6, 0.1, None, "Other", None, "e1", 5, 9, None, None, None, None, None),
        (4, ["HOTSPOT_TOP_50"], "medium", "low", 0.6, 0.9, None, "Third", None, *quiet),
        (5, ["PROVIDER_DEGRADED"], "monitor_only", "high", 0.1, 0.1, None, None, "R9", *quiet),
    ]
    got = {(r.action, r.label): r for r in RU.action_plan(spark.createDataFrame(rows, columns), F.lit(1), F.lit(24), 20).collect()}
    patrol = got["INCREASE_PATROL", "main"]
    assert patrol.segments == [0, 1] and abs(patrol.score - (0.4 * 0.99 + 0.25 * 0.9 + 0.2 + 0.1 + 0.05 * 0.4)) < 1e-6 and (patrol.start, patrol.end, patrol.basis, patrol.priority) == (1, 25, "prediction_horizon", "critical")
    event = got["EVENT_TRAFFIC_CONTROL", "e1"]
    assert (event.segments, event.start, event.end, event.basis, event.uncertainty) == ([2, 3], 5, 9, "event_period", "medium")
    assert set(got) == {("INCREASE_PATROL", "main"), ("SPEED_MONITORING", "main"), ("EVENT_TRAFFIC_CONTROL", "e1"), ("PEDESTRIAN_FLOW_MONITORING", "e1"), ("CONTINUE_MONITORING", "r9")}
    assert RU.citywide_warning(spark.createDataFrame(rows, columns), "codes", "SEVERE_WEATHER", "segment").collect()[0].affected == 1
    assert RU.citywide_warning(spark.createDataFrame(rows[1:], columns), "codes", "SEVERE_WEATHER", "segment").collect() == []


def test_recommendations_need_evidence(spark):
    cases = [
        ({"segment_accidents_total_prior": 0.1}, {"segment_accidents_total_prior": "3"}, ["historical_accidents"]), ({"segment_accidents_total_prior": -0.1}, {"segment_accidents_total_prior": "3"}, []),
        ({}, {"narrow_fast_road": "true"}, ["structural_risk_flag"]), ({"weather_snow_now": 0.2}, {"weather_snow_now": "1"}, ["weather_hazard"]), ({"weather_snow_now": 0.2}, {"weather_snow_now": "0"}, []),
        ({"road_maxspeed_kmh": 0.1}, {"road_maxspeed_kmh": "60"}, ["confirmed_high_speed"]), ({"road_maxspeed_kmh": 0.1}, {"road_maxspeed_kmh": "90", "road_maxspeed_missing": "1"}, []), ({"road_maxspeed_missing": 0.1}, {"road_maxspeed_missing": "1"}, ["missing_speed_limit"]),
        ({"poi_a_100m": -0.5, "poi_b_100m": 0.1}, {"poi_a_100m": "9", "poi_b_100m": "3"}, ["nearby_poi"]), ({"poi_b_100m": 0.1}, {"poi_b_100m": "2"}, []), ({"road_oneway": 0.1}, {"road_oneway": "да"}, ["oneway"]),
        ({"road_length": 0.1, "x": 0.9}, {}, ["road_spatial"]), ({"road_length": 0.05, "x": 0.9}, {}, []), ({"calendar_is_holiday": 0.1}, {"calendar_is_holiday": "True"}, ["positive_rush_holiday"]), (None, None, []),
    ]
    df = spark.createDataFrame([(i, g, v, 0.36) for i, (g, v, _) in enumerate(cases)], "i int, g map<string,double>, v map<string,string>, p double")
    got = {r.i: r for r in df.withColumns(RU.recommendations("g", "v", "p")).collect()}
    for i, (_, _, want) in enumerate(cases):
        assert [x.rule for x in got[i].recommendations or []] == want, i
    assert got[0].recommendations[0].priority == "critical" and got[2].recommendations[0].priority == "medium" and got[8].recommendations[0].features == ["poi_b_100m"]
    assert (got[8].raising, got[8].lowering) == (["poi_b_100m"], ["poi_a_100m"])


def test_audits(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, 0.4, 2), (2, 0.4, 2)], "k int, s double, r int")
    bad = A.rank_contract(df, ["k"], "s", "r").first()
    assert (bad.unique_keys, bad.ranks_exact) == (False, False)
    assert {r.status for r in A.check_suite(df, {"neg": ("error", F.col("s") < 0)}).collect()} == {"pass", "READY"}


def test_models(spark):
    df = spark.range(400).select((F.col("id") % 17).cast("double").alias("x"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("c"), ((F.col("id") % 17) > 8).cast("double").alias("y"), (F.col("id") % 4 == 0).alias("v"))
    for kind in ("gbt", "logistic", "forest"):
        out = MO.fit_classifier(df, ["x"], ["c"], "y", kind, maxIter=5) if kind != "forest" else MO.fit_classifier(df, ["x"], ["c"], "y", kind, numTrees=5)
        assert out.transform(df).where("prediction = y").count() > 380
    trials = MO.tune(df.where("not v"), df.where("v"), ["x"], [], "y", [{"maxIter": 1, "maxDepth": 1}, {"maxIter": 3}], seeds=(1, 2)).collect()
    assert trials[0].pr_auc > 0.95 and trials[0].pr_auc >= trials[1].pr_auc and abs(trials[0].gap) < 0.05 and trials[0].lift > 1.5 and trials[0].seed_std < 0.01 and trials[1].seed_std is None
    assert MO.count_model(df, ["x"], "y").transform(df).where("prediction < 0").count() == 0
    r = MO.linear_contributions(df, {"x": 2.0}, {"x": 8.0}, 1.0).agg(F.max(F.abs("residual"))).first()[0]
    assert r < 1e-9


def test_text(spark):
    page = '<h1>A &amp; B</h1><script type="application/ld+json">{"@type":"Event","name":"Cup","startDate":"2024-01-02","location":{"name":"Arena"}}</script><script type="application/ld+json">{"@graph":[{"@type":"MusicEvent","name":"Gig","startDate":"2024-02-02","location":{"name":"Hall"}}]}</script>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, h string")
    assert {(r.k, r.name, r.venue) for r in T.jsonld_events(df, "k", "h").collect()} == {(1, "Cup", "Arena"), (1, "Gig", "Hall")}
    assert [r[0] for r in df.orderBy("k").select(T.html_to_text(F.col("h"))).collect()] == ["A & B", None, ""]
    lists = spark.createDataFrame([("['60', '70']",), ("a; b|c",)], "t string").select(T.list_items(F.col("t"))).collect()
    assert [r[0] for r in lists] == [["60", "70"], ["a", "b", "c"]]


def test_daylight(spark):
    got = [r[0] for r in spark.createDataFrame([(172,), (355,)], "d int").select(HR.daylight(F.col("d"), 51.1)).collect()]
    assert got[0] > 16 and got[1] < 8.5
