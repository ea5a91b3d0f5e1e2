import json
import random

import pytest
from pyspark.sql import functions as F

from meridex.operators import history as H
from meridex.sources import readers as RD
from meridex.sources import sinks as SK
from meridex.streaming import jobs as ST


def test_readers(spark, tmp_path):
    (tmp_path / "e.csv").write_text('u,v,key,geometry\n1,2,0,"LINESTRING (0 0, 1 1)"\n3,4,0,oops\n')
    assert [r.segment_id for r in RD.read_edges(spark, str(tmp_path / "e.csv")).collect()] == ["1_2_0"]
    with pytest.raises(ValueError, match="nope"):
        RD.read_events(spark, str(tmp_path / "e.csv"), ["nope"])
    (tmp_path / "p.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"amenity": "school"}}, {"type": "way", "id": 1, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"amenity": "school"}}, {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"amenity": "school"}}, {"type": "node", "id": 9, "tags": {"amenity": "school"}}]}))
    assert RD.read_poi_elements(spark, str(tmp_path / "p.json"), {"school": ("amenity", "school")}).count() == 2
    for i in (1, 2):
        (tmp_path / f"w{i}.json").write_text(json.dumps({"hourly": {"time": ["2024-01-01T00:00", f"2024-01-01T0{i}:00"], "t": [1.0, 2.0]}}))
    assert RD.read_columnar_json(spark, [str(tmp_path / f"w{i}.json") for i in (1, 2)], ["t"]).count() == 3
    body = json.dumps({"list": [{"dt": t, "main": {"temp": v}, "rain": {"3h": 1.0}, "weather": [{"id": 201}]} for t, v in ((-10, 9.0), (0, 8.0), (10, 2.0), (86400, 4.0))]})
    df = spark.createDataFrame([("c", body, 0)], "k string, body string, start long")
    assert sorted(r.temperature for r in RD.read_forecast(df, "k", "body", "start").collect()) == [2.0, 8.0]


def test_sinks(spark, tmp_path):
    df = spark.range(6).select("id", (F.col("id") % 2).alias("day"), (F.col("id") * 1.5).alias("s"))
    at = str(tmp_path)
    SK.write_dual(df, f"{at}/dual")
    assert spark.read.parquet(f"{at}/dual/parquet").count() == spark.read.option("header", True).csv(f"{at}/dual/csv").count() == 6
    first = {r.day: r.rows for r in SK.write_chunks(df.where("day = 0"), f"{at}/chunks", "day").collect()}
    again = {r.day: r.rows for r in SK.write_chunks(df, f"{at}/chunks", "day").collect()}
    assert first == {0: 3} and again == {0: 3, 1: 3}
    assert SK.write_if_changed(df, f"{at}/same") and not SK.write_if_changed(df.orderBy(F.desc("id")), f"{at}/same")
    SK.write_batch(df, f"{at}/b", "one", "2024-01-01")
    SK.write_batch(df.where("id < 2"), f"{at}/b", "two", "2024-01-02")
    assert SK.read_batch(spark, f"{at}/b").count() == 2 and SK.top_of_batch(SK.read_batch(spark, f"{at}/b", "one"), "s", "id", 0).count() == 1
    geo = spark.createDataFrame([(i, [(0.0, 0.0), (1.0, 1.0)]) for i in range(6)], "id long, line array<struct<x:double,y:double>>")
    assert json.loads(SK.geojson_features(df, geo, "id", ["s"]).first().value)["geometry"]["coordinates"] == [[0.0, 0.0], [1.0, 1.0]]
    with pytest.raises(ValueError):
        SK.geojson_features(df, geo.where("id > 0"), "id", ["s"])
    SK.append_snapshot(df, f"{at}/snap", "2024-01-01 00:00:00")
    assert spark.read.parquet(f"{at}/snap").count() == 6


def test_upsert_table(spark, tmp_path):
    make = lambda rows, t: spark.createDataFrame([(k, v, v, t, t) for k, v in rows], "k string, v string, h string, created_at int, updated_at int")
    at = str(tmp_path / "t")
    assert SK.upsert_table(spark, at, make([("a", "1"), ("b", "2")], 1), ["k"], "h") == {"new": 2}
    assert SK.upsert_table(spark, at, make([("a", "1"), ("b", "3")], 2), ["k"], "h") == {"unchanged": 1, "updated": 1}
    assert {(r.k, r.v, r.created_at) for r in SK.current_version(spark, at).collect()} == {("a", "1", 1), ("b", "3", 1)}
    many = make([(str(i), "1") for i in range(200)], 3)
    assert SK.upsert_table(spark, at, many, ["k"], "h")["new"] == 200
    before = {b: v for b, v, _ in SK._latest(spark, at)}
    assert SK.upsert_table(spark, at, make([("7", "2")], 4), ["k"], "h")["updated"] == 1
    assert sum(before[b] != v for b, v, _ in SK._latest(spark, at)) == 1 and SK.current_version(spark, at).count() == 202
    scoped = str(tmp_path / "scoped")
    SK.upsert_table(spark, scoped, make([("x1", "1"), ("x2", "1"), ("y1", "1")], 1).withColumn("s", F.substring("k", 1, 1)), ["s", "k"], "h", ["s"])
    done = SK.upsert_table(spark, scoped, make([("x1", "1")], 2).withColumn("s", F.lit("x")), ["s", "k"], "h", ["s"])
    assert (done["unchanged"], done["deleted"]) == (1, 1) and {r.k for r in SK.current_version(spark, scoped).collect()} == {"x1", "y1"}
    assert SK.upsert_table(spark, scoped, make([], 3).withColumn("s", F.lit("x")), ["s", "k"], "h", ["s"]) == {}


def run_stream(spark, df, at, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{at}/c-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streaming_counts_equal_batch(spark, tmp_path):
    at = str(tmp_path)
    rows = [(i % 3, f"2024-01-01 {h:02d}:{(7 * i) % 60:02d}:00", i) for i, h in enumerate([0, 0, 1, 1, 3, 4, 4, 9, 9, 10, 23])]
    ev = spark.createDataFrame(rows, "entity long, t string, id int").select("entity", F.to_timestamp("t").alias("ts"), "id")
    ev.coalesce(1).write.parquet(f"{at}/in")
    stream = lambda: spark.readStream.schema(ev.schema).parquet(f"{at}/in")
    per = {(r.entity, str(r.hour_start)): r.n for r in run_stream(spark, ST.hourly_counts(stream(), "entity", "ts"), at, "m2").collect()}
    want = {(r.entity, str(r.w)): r.n for r in ev.groupBy("entity", F.date_trunc("hour", "ts").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert per and per.items() <= want.items() and len(per) >= len(want) - 1
    assert run_stream(spark, ST.rolling_counts(stream(), "entity", "ts"), at, "m3").count() > 0
    assert run_stream(spark, ST.activity_runs(stream(), "entity", "ts"), at, "m6").count() > 0
    assert run_stream(spark, ST.deduplicated(stream(), ["id"], "ts"), at, "m7").count() == len(rows)
    fresh = run_stream(spark, ST.freshness(stream(), "entity", "ts", 60), at, "m5", "complete").collect()
    assert len(fresh) == 3 and all(r.degraded for r in fresh)
    joined = run_stream(spark, ST.interval_join(stream(), stream().select("entity", F.col("ts").alias("issued")), "entity", "ts", "issued"), at, "m8")
    assert joined.count() >= len(rows)


def brute_counters(arrivals, windows, late):
    """Counts at arrival, batch by batch: rows of hours that are known before the row's own hour, by plain loops."""
    seen, out, mark = {}, [], None
    for batch in arrivals:
        top = max((h for _, h, _ in batch), default=None)
        kept = [r for r in batch if mark is None or r[1] >= mark]
        per = {}
        for e, h, n in kept:
            per[e, h] = per.get((e, h), 0) + n
        for e, h in sorted(per, key=lambda x: x[1]):
            own = seen.setdefault(e, {})
            before = [(t, c) for t, c in own.items() if t < h]
            prior = [sum(c for t, c in before if t >= h - w) for w in windows]
            out.append((e, h, per[e, h], sum(c for _, c in before), *prior, float(h - max(t for t, _ in before)) if before else -1.0))
            own[h] = own.get(h, 0) + per[e, h]
        if top is not None:
            mark = max(top - late, mark if mark is not None else top - late)
    return out


def counted(spark, at, name, batches, windows, late=24):
    for rows in batches:
        spark.createDataFrame(rows, "entity long, hour long, n long").coalesce(1).write.mode("append").parquet(f"{at}/{name}")
    stream = spark.readStream.schema("entity long, hour long, n long").option("maxFilesPerTrigger", 1).parquet(f"{at}/{name}")
    return run_stream(spark, ST.prior_counters(stream, windows, late), at, name)


def test_stateful_counters_equal_batch(spark, tmp_path):
    at, rows = str(tmp_path), [(1, 100, 2), (1, 110, 1), (1, 200, 1), (2, 150, 3), (1, 1000, 1)]
    hourly = spark.createDataFrame(rows, "entity long, hour long, n long")
    got = counted(spark, at, "one", [rows], None)
    want = H.own_prior_counts(hourly, {"prior_total": None, **ST.COUNTER_WINDOWS}).drop("has_history")
    assert {tuple(r) for r in got.select(want.columns).collect()} == {tuple(r) for r in want.collect()}


def test_counters_of_late_hours_and_silent_entities(spark, tmp_path):
    """Late hours, repeated hours over batches, hours beyond the delay, windows that empty, and entities that come back."""
    rnd = random.Random(4)
    windows, late, batches, now = {"w3": 3, "w10": 10}, 6, [], 100
    for _ in range(7):
        batch = [(e, now + rnd.randint(-late, 5), rnd.randint(1, 3)) for e in (1, 2, 3) for _ in range(rnd.randint(0, 5))]
        batches.append([*batch, (4, now + 5, 1)])
        now += rnd.choice((4, 9, 30))
    batches.append([(5, now, 1), (5, now - 200, 1)])
    got = counted(spark, str(tmp_path), "late", batches, windows, late)
    assert got.columns == ["entity", "hour", "n", "prior_total", "w3", "w10", "hours_since_prev"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_counters(batches, list(windows.values()), late))


def test_upsert_stream(spark, tmp_path):
    at = str(tmp_path)
    df = spark.createDataFrame([("a", "1", "1", 1, 1)], "k string, v string, h string, created_at int, updated_at int")
    df.write.parquet(f"{at}/in")
    q = ST.upsert_stream(spark.readStream.schema(df.schema).parquet(f"{at}/in"), f"{at}/t", ["k"], "h", f"{at}/c")
    q.awaitTermination(120)
    assert SK.current_version(spark, f"{at}/t").count() == 1
    q = ST.append_chunks(spark.readStream.schema(df.schema).parquet(f"{at}/in"), f"{at}/chunks", "k", f"{at}/c2")
    q.awaitTermination(120)
    assert SK.read_chunks(spark, f"{at}/chunks").count() == 1


def test_silent_providers_degrade(spark, tmp_path):
    import time

    at = str(tmp_path)
    spark.createDataFrame([("quiet", "2024-01-01 00:00:00")], "p string, t string").select("p", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(f"{at}/in")
    stream = ST.freshness_watch(spark.readStream.schema("p string, ts timestamp").parquet(f"{at}/in"), "p", "ts", 1)
    q = stream.writeStream.format("memory").queryName("silent").option("checkpointLocation", f"{at}/c").outputMode("append").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("silent").where("degraded").isEmpty():
            time.sleep(1)
    finally:
        q.stop()
    assert sorted((r.provider, r.degraded) for r in spark.table("silent").collect()) == [("quiet", False), ("quiet", True)]
