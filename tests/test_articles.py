"""Articles, venue events, contracts and context features: hand-made cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meridex.functions import articles as A
from meridex.functions import hours as HR
from meridex.functions import text as T
from meridex.operators import audit as AU
from meridex.operators import context as X
from meridex.operators import records as R


def values(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in make(F.col("t")).items()]).first().asDict()


def test_article_with_section_and_period(spark):
    page = "<html><h1>Ремонт</h1><p>Опубликовано 1 июля 2026 года. С 4 июля по 4 августа будет частично перекрыта ул. Сыганак от Туран до Мангилик.</p></html>"
    r = A.article_record(spark.createDataFrame([(page,), (None,)], "html string"), "html", F.lit(None).cast("timestamp_ntz")).collect()
    assert (r[0].restriction, r[0].event_type, r[0].severity, r[0].score) == ("partial_closure", "traffic_restriction", "medium", 4)
    assert (r[0].start, r[0].end, r[0].open_end, r[0].road_name, r[0].from_street, r[0].to_street) == (datetime(2026, 7, 4), datetime(2026, 8, 4), False, "ул. Сыганак", "Туран", "Мангилик")
    assert r[0].relevant and r[0].confidence == 0.95 and len(r[0].content_hash) == 64 and r[1].start is None


@pytest.mark.parametrize(("text", "event", "severity"), [("полностью перекрыт перекресток", "intersection_closure", "critical"), ("ремонт: мост", "bridge_repair", "unknown"), ("закрыта одна полоса", "lane_closure", "medium"), ("толық жабылды", "road_closure", "high"), ("қиылыс толық жабылды", "intersection_closure", "critical"), ("", "traffic_restriction", "unknown")])
def test_article_classes(spark, text, event, severity):
    got = values(spark, text, A.classify)
    assert (got["event_type"], got["severity"]) == (event, severity)


def test_periods(spark):
    at = F.lit(datetime(2026, 7, 1)).cast("timestamp_ntz")
    got = lambda t: values(spark, t, lambda c: A.period(c, at))
    assert got("Закрыто с 20:00 5 июля") == {"start": datetime(2026, 7, 5, 20), "end": None, "open_end": True, "warning": "open_end_date"}
    assert got("до 9 шілде")["end"] == datetime(2026, 7, 9) and got("нет дат")["warning"] == "date_not_found"
    assert got("с 31 июня по 2 июля") == {"start": None, "end": datetime(2026, 7, 2), "open_end": False, "warning": None}


def test_locations_and_road_keys(spark):
    got = values(spark, "перекрытие на пересечении Абая. проспекта Туран частично, улица Достык", A.locations)
    assert got["phrases"] == ["проспекта Туран", "улица Достык"] and got["intersection"] == "Абая"
    assert values(spark, None, A.locations)["road_name"] is None
    keys = spark.createDataFrame([("ул. Қабанбай батыр",), ("  Улица  Кабанбай-Батыр от Туран до Сыганак",), (None,), ("",)], "t string").select(A.road_key(F.col("t"))).collect()
    assert [r[0] for r in keys] == ["кабанбайбатыр", "кабанбайбатыр", "", ""]


def test_venue_events_and_lists(spark):
    df = spark.createDataFrame([("Матч", None, "Astana Arena", 30000), ("встреча", "Expo", None, None), (None, None, None, 5000)], "n string, c string, v string, k int")
    got = df.select(*[c.alias(n) for n, c in A.venue_event(*map(F.col, "ncvk")).items()]).collect()
    assert [tuple(r) for r in got] == [("football_match", 5, 7.5), ("exhibition", 2, 2.0), ("public_event", 2, 2.3)]
    lists = spark.createDataFrame([('["a", 1]',), ("{}",), ("[x",), (None,), ("",)], "t string").select(T.json_list(F.col("t"))).collect()
    assert [r[0] for r in lists] == [["a", "1"], [], [], [], []]


def test_sun_and_dew(spark):
    r = spark.createDataFrame([(0, 3600, 36000), (5000, None, 36000)], "a int, u int, d int").select(*[c.alias(n) for n, c in HR.sun_times(*map(F.col, "aud")).items()], HR.dew_point(F.lit(20.0), F.lit(100.0)).alias("dew")).collect()
    assert (r[0].day_length, r[0].dark_hours, r[0].until_sunrise, r[0].until_sunset) == (9, 15, 1, 10) and abs(r[0].dew - 20) < 1e-9
    assert (r[1].day_length, r[1].dark_hours, r[1].until_sunrise) == (None, None, None) and abs(r[1].until_sunset - 31000 / 3600) < 1e-9


START = 1_784_100_000


def test_repairs_and_events_of_segments(spark):
    hour = lambda h: None if h is None else START + h * 3600
    repairs = [("s1", "g1", 10.0, 0.8, hour(2), hour(26), "road_closure", "high", "full_closure", False), ("s1", "g3", 20.0, 0.6, hour(-22), None, "road_repair", "medium", None, True)]
    df = spark.createDataFrame(repairs, "segment string, id string, distance double, confidence double, valid_from long, valid_to long, event_type string, severity string, restriction string, open_end boolean")
    r = X.repair_features(df, F.lit(START)).first()
    assert (r.repairs, r.full_closures, r.nearest, r.confidence, r.open_ends, r.source_id, r.hours_until_start) == (2, 1, 10.0, 0.8, 1, "g1", 0.0) and r.disruption == round(3 * 0.8 * 2 + 2 * 0.6, 4)
    e = [("s2", "e1", 400.0, 0.9, hour(4), hour(7), "large_concert", 5, 7.5, "Astana Arena"), ("s2", "e1", 900.0, 0.5, hour(4), hour(7), "large_concert", 5, 7.5, "Astana Arena")]
    df = spark.createDataFrame(e, "segment string, id string, distance double, confidence double, valid_from long, valid_to long, event_type string, severity int, intensity double, venue string")
    r = X.event_features(df, F.lit(START), F.lit(START + 86400)).first()
    assert (r.events, r.within_500, r.within_1000, r.intensity_sum, r.intensity_max, r.major, r.concerts, r.stadium, r.outflow_risk, r.confidence) == (1, 1, 1, 7.5, 7.5, 1, 1, 1, 1, 0.9)


def test_forecasts(spark):
    columns = "k string, at long, temperature double, humidity double, pressure double, wind_speed double, wind_gust double, rain double, snow double, visibility double, clouds double, weather_id int"
    rows = [("x", START, 8.0, 50.0, 1000.0, 3.0, 5.0, 3.0, None, 9000.0, 10.0, 500), ("x", START + 10800, 2.0, 60.0, 1000.0, 11.0, 15.0, None, None, 900.0, 20.0, 201), ("x", START + 82800, None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, columns)
    r = X.forecast_features(df, "k", "at").first()
    assert (r.rain_sum, r.strong_wind_hours, r.storm_hours, r.rapid_drop, r.changes, r.freeze_thaw, r.temperature_mean) == (3.0, 3, 3, True, 2, False, 5.0)
    day = X.day_summary(df, "k", "at", F.lit(START)).first()
    assert (day.points, day.severity, day.complete, day.severe, day.worst_start) == (3, 0.4, False, False, START + 10800)
    worst = X.day_summary(spark.createDataFrame([("x", START, 1.0, 1.0, 1.0, 15.0, 1.0, 3.0, None, 500.0, 1.0, 1)], columns), "k", "at", F.lit(START)).first()
    assert worst.severity == 0.6 and worst.severe and worst.heavy_rain_expected


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, None, 2)], "k int, v string, w int")
    assert R.project_contract(df, ["k", "w"], ["k"], ["w"]).columns == ["k", "w"]
    for keep, key, required in ((["k", "no"], ["k"], []), (["k", "v"], ["k"], ["v"])):
        with pytest.raises(ValueError, match="missing"):
            R.project_contract(df, keep, key, required)
    with pytest.raises(ValueError, match="repeat"):
        R.project_contract(df.union(df), ["k", "w"], ["k"], [])
    none = df.limit(0).select(F.col("w").alias("city"))
    assert [r.city for r in R.with_city_row(df, none, ["city"]).collect()] == [0, 0]
    a, b = (R.history_hash(df.withColumn("at", F.lit(i)), ["k"], ["at"]).orderBy("k").collect() for i in (1, 2))
    assert [r.content_hash for r in a] == [r.content_hash for r in b] and a[0].content_hash != a[1].content_hash
    assert AU.reconstruction_audit(df, df, ["k", "v"]).first().equal


def test_equally_near_rows_of_an_event_leave_no_choice(spark):
    """Rows of one event that agree in distance and start: the first by `order` counts, else the least, however they arrive."""
    names = "record int, segment string, id string, distance double, confidence double, valid_from long, valid_to long, event_type string, severity int, intensity double, venue string"
    rows = [(k, "s", "e", 100.0, (k * 7 % 20) / 20, None, START + 60 * k, "festival", k % 5, float(k), "Hall") for k in range(1, 20)]
    for dealt in (rows, rows[::-1], rows[7:] + rows[:7]):
        df = spark.createDataFrame(dealt, names).repartition(3)
        r = X.event_features(df, F.lit(START), F.lit(START + 86400), "record").first()
        assert (r.events, r.confidence, r.intensity_sum, r.event_end) == (1, 0.35, 1.0, START + 60)
        r = X.event_features(df.drop("record"), F.lit(START), F.lit(START + 86400)).first()
        assert (r.events, r.confidence, r.intensity_sum) == (1, 0.05, 3.0)
