"""Queries that write given tables in other forms, read or stream them back, and models' linear parts."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import history as H
from ..operators import models as MO
from ..operators import records as R
from ..operators.joins import enrich_inner
from ..operators.tables import folder
from ..sources import commits as CM
from ..sources import readers as RD
from ..sources import sinks as SK
from ..streaming import jobs as ST
from .registry import query, table


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def read_events(spark, sf):
    """Two formats written side by side; the CSV one is read with checked columns."""
    at = folder(spark, "dual")
    SK.write_dual(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), at)
    return RD.read_events(spark, f"{at}/csv", ["c_custkey", "c_name", "c_nationkey"], "c_custkey string, c_name string, c_nationkey string")


@query("SELECT s_suppkey || '_' || s_nationkey || '_0' AS segment_id, 2::INT AS points, s_suppkey::DOUBLE AS first_x FROM supplier WHERE s_suppkey % 10 > 0")
def read_edges(spark, sf):
    at, s = folder(spark, "edges"), table(spark, sf, "supplier")
    wkt = F.when(F.col("s_suppkey") % 10 > 0, F.concat(F.lit("LINESTRING ("), "s_suppkey", F.lit(" 1, 2 "), "s_nationkey", F.lit(")"))).otherwise("POINT EMPTY")
    s.select(F.col("s_suppkey").alias("u"), F.col("s_nationkey").alias("v"), F.lit(0).alias("key"), wkt.alias("geometry")).write.option("header", True).csv(at)
    return RD.read_edges(spark, at).select("segment_id", F.size("line").alias("points"), F.col("line")[0]["x"].alias("first_x"))


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'node' ELSE 'way' END AS type, p_partkey AS id, p_size::DOUBLE AS lat, p_retailprice AS lon, CASE WHEN p_partkey % 3 = 0 THEN 'school' ELSE 'stop' END AS category FROM part WHERE p_partkey % 3 < 2")
def read_poi_elements(spark, sf):
    at, p, k = folder(spark, "poi"), table(spark, sf, "part"), F.col("p_partkey")
    spot = lambda: (F.col("p_size").cast("double").alias("lat"), F.col("p_retailprice").alias("lon"))
    tags = F.when(k % 3 == 0, F.create_map(F.lit("amenity"), F.lit("school"))).when(k % 3 == 1, F.create_map(F.lit("highway"), F.lit("bus_stop"))).otherwise(F.create_map(F.lit("shop"), F.lit("yes")))
    e = p.select(F.struct(F.when(k % 2 == 0, "node").otherwise("way").alias("type"), k.alias("id"), *[F.when(k % 2 == 0, c).alias(n) for n, c in zip(("lat", "lon"), spot(), strict=True)], F.when(k % 2 == 1, F.struct(*spot())).alias("center"), tags.alias("tags")).alias("e"), F.floor(k / 50).alias("f"))
    e.union(e.where("e.id % 7 = 0")).groupBy("f").agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("value")).select("value").write.text(at)
    return RD.read_poi_elements(spark, at, {"school": ("amenity", "school"), "stop": ("highway", "bus_stop")}, False).select("type", "id", "lat", "lon", "category")


@query("SELECT make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) AS time, round(sum(value), 3) AS v FROM events GROUP BY 1")
def read_columnar_json(spark, sf):
    at = folder(spark, "hourly")
    h = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("t")).agg(F.round(F.sum("value"), 3).alias("v"))
    one = h.select(F.struct(F.date_format("t", "yyyy-MM-dd'T'HH:mm").alias("time"), "v").alias("x"), F.to_date("t").alias("day"))
    some = one.groupBy("day").agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.to_json(F.struct(F.struct(F.col("x.time").alias("time"), F.col("x.v").alias("v")).alias("hourly"))).alias("value"))
    some.write.text(at)
    return RD.read_columnar_json(spark, [at], ["v"], whole_file=False)


@query("SELECT user_id AS place, epoch_us(ts) // 1000000 AS dt, round(value, 3) AS temperature, CASE WHEN event_id % 2 = 0 THEN 1.5 ELSE 0 END::DOUBLE AS rain, (200 + event_id % 3)::INT AS weather_id FROM events, (SELECT min(epoch_us(ts)) // 1000000 AS lo FROM events) WHERE epoch_us(ts) // 1000000 >= lo + 864000 AND epoch_us(ts) // 1000000 < lo + 864000 + 240 * 3600")
def read_forecast(spark, sf):
    e = table(spark, sf, "events").withColumn("dt", F.unix_seconds(F.col("ts").cast("timestamp")))
    k = F.col("event_id")
    point = F.struct("dt", F.struct(F.round("value", 3).alias("temp")).alias("main"), F.when(k % 2 == 0, F.create_map(F.lit("3h"), F.lit(1.5))).alias("rain"), F.array(F.struct((200 + k % 3).cast("int").alias("id"))).alias("weather"))
    nested = e.groupBy(F.col("user_id").alias("place")).agg(F.to_json(F.struct(F.collect_list(point).alias("list"))).alias("body"))
    nested = nested.crossJoin(F.broadcast(e.agg((F.min("dt") + 864000).alias("start"))))  # one row
    return RD.read_forecast(nested, "place", "body", "start", 240).select("place", "dt", "temperature", "rain", "weather_id")


@query("SELECT n_nationkey::VARCHAR AS id, 'LineString' AS kind, [[n_nationkey::DOUBLE, 0.0], [1.0, n_regionkey::DOUBLE]] AS line, n_name AS name FROM nation")
def geojson_features(spark, sf):
    n = table(spark, sf, "nation")
    spot = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    shapes = n.select("n_nationkey", F.array(spot(F.col("n_nationkey"), F.lit(0)), spot(F.lit(1), F.col("n_regionkey"))).alias("line"))
    n = n.withColumns({"p": F.col("n_nationkey") / 25, "level": F.when(F.col("n_nationkey") < 10, "low").otherwise("high")})
    made = SK.geojson_features(n, shapes, "n_nationkey", ["n_name"], "level", "p", [(0.0, "low"), (0.4, "high")])
    back = made.select(F.from_json("value", "id string, geometry struct<type:string,coordinates:array<array<double>>>, properties struct<n_name:string>").alias("v"))
    return back.select("v.id", F.col("v.geometry.type").alias("kind"), F.col("v.geometry.coordinates").alias("line"), F.col("v.properties.n_name").alias("name"))


@query("SELECT nullif(o_orderstatus, 'P') AS status, count(*) AS rows, count(*) AS rows_read FROM orders GROUP BY 1")
def write_chunks(spark, sf):
    """Chunks by status, some of them (that of null too) written beforehand: later runs write only the others."""
    at, o = folder(spark, "chunks"), table(spark, sf, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("status"))
    SK.write_chunks(o.where("status = 'F' OR status IS NULL"), at, "status")
    for _ in range(2):  # the second run finds all of them
        done = SK.write_chunks(o, at, "status")
    found = SK.read_chunks(spark, at).groupBy(F.col("status").alias("read")).agg(F.count("*").alias("rows_read"))
    return done.join(found, F.col("status").eqNullSafe(F.col("read")), "full").select("status", "rows", "rows_read")

@query("SELECT n_name, t AS collected_at FROM nation, (SELECT unnest([TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-02 00:00:00']) AS t)")
def append_snapshot(spark, sf):
    at, n = folder(spark, "snapshots"), table(spark, sf, "nation").select("n_name")
    for day in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        SK.append_snapshot(n, at, day)
    return spark.read.parquet(at).select("n_name", F.col("collected_at").cast("timestamp_ntz").alias("collected_at"))


@query("SELECT unnest(['first', 'same in another order', 'changed']) AS write, unnest([true, false, true]) AS wrote FROM (SELECT count(*) AS n FROM customer) WHERE n > 0")
def write_if_changed(spark, sf):
    at, c = folder(spark, "same"), table(spark, sf, "customer").select("c_custkey", "c_name")
    wrote = [SK.write_if_changed(d, at) for d in (c, c.orderBy(F.desc("c_custkey")), c.withColumn("c_name", F.concat("c_name", F.lit("!"))))]
    names = F.array(*map(F.lit, ("first", "same in another order", "changed")))
    return c.limit(1).select(F.inline(F.arrays_zip(names.alias("write"), F.array(*map(F.lit, wrote)).alias("wrote"))))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_nationkey")
def enrich_one_to_one(spark, sf):
    n, r = table(spark, sf, "nation").select("n_nationkey", "n_name"), table(spark, sf, "region").select(F.col("r_regionkey").alias("n_nationkey"), "r_name")
    return enrich_inner(n.join(r.select("n_nationkey"), "n_nationkey", "left_semi"), r, ["n_nationkey"])


@query("""WITH k AS (SELECT p_partkey, p_partkey % 4 AS k, p_brand FROM part) SELECT p_partkey, 'P' || p_partkey AS name, p_brand AS venue, '2024-01-02' AS start, CASE k WHEN 0 THEN 'Thing, SportsEvent' ELSE 'Event' END AS category, NULL AS city FROM k WHERE k < 2
 UNION ALL SELECT p_partkey, 'sub', NULL, '2024-02-02', 'MusicEvent', NULL FROM k WHERE k IN (1, 2) UNION ALL SELECT p_partkey, 'deep', p_brand, '2024-03-02', 'x', 'Town' FROM k WHERE k IN (1, 2)""")
def jsonld_events(spark, sf):
    """Lists, graphs and lists of items; events in events in events; several types; entities before JSON; broken JSON."""
    k = F.col("p_partkey")
    node = lambda kind, more="": F.concat(F.lit(f'{{"@type":{kind},"name":"P'), k, F.lit('","startDate":"2024-01-02","location":{"name":"'), "p_brand", F.lit('"}'), F.lit(more) if isinstance(more, str) else more, F.lit("}"))
    deep = F.concat(F.lit(',"subEvent":{"@type":["Place","TheaterEVENT"],"category":"x","name":"deep","startDate":"2024-03-02","location":[{"name":"'), "p_brand", F.lit('","address":{"addressLocality":"Town"}}]}'))
    sub = F.concat(F.lit(',"subEvent":[{"@type":"MusicEvent","name":"sub","startDate":"2024-02-02"'), deep, F.lit('},{"@type":"Event","name":"no start"}]'))
    body = F.when(k % 4 == 0, F.concat(F.lit("["), node('["Thing","SportsEvent"]'), F.lit("]"))).when(k % 4 == 1, F.concat(F.lit('{"@graph":['), node('"Event"', sub), F.lit("]}"))).when(k % 4 == 2, F.concat(F.lit('{"itemListElement":[{"item":'), node('"Place"', sub), F.lit("}]}"))).otherwise(F.concat(F.lit("{"), node('"Event"')))
    html = F.concat(F.lit('<p>x</p><script type="application/ld+json">'), F.when(k % 8 < 4, F.replace(body, F.lit('"'), F.lit("&quot;"))).otherwise(body), F.lit("</script>"))
    return T.jsonld_events(table(spark, sf, "part").select("p_partkey", html.alias("html")), "p_partkey", "html").select("p_partkey", "name", "venue", "start", "category", "city")


@query("SELECT p_partkey, round(0.5 * (coalesce(p_size, 25) - 25), 6) AS c_p_size, round(-0.01 * (p_retailprice - 1000), 6) AS c_p_retailprice, 0.0::DOUBLE AS residual FROM part")
def linear_contributions(spark, sf):
    got = MO.linear_contributions(table(spark, sf, "part"), {"p_size": 0.5, "p_retailprice": -0.01}, {"p_size": 25.0, "p_retailprice": 1000.0}, 3.0)
    return got.select("p_partkey", F.round("c_p_size", 6).alias("c_p_size"), F.round("c_p_retailprice", 6).alias("c_p_retailprice"), F.abs(F.round("residual", 6)).alias("residual"))


def streamed(spark, sf, name):
    """A table as a stream of files; times get a zone, as watermarks need."""
    df = table(spark, sf, name)
    s = spark.readStream.schema(df.schema).parquet(f"{sf}/{name}.parque[t]")  # a pattern, as the table may be one file
    return s.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def in_batches(spark, df, name, number=4):
    """A table, dealt over `number` files by its first column, as a stream of so many micro-batches."""
    at = folder(spark, name)
    for k in range(number):
        df.where(F.pmod(F.xxhash64(df.columns[0]), F.lit(number)) == k).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)


def landed(spark, stream, name, rocksdb=False):
    """What a stream has written when all its input is read."""
    at = folder(spark, name)
    writer = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True)
    with ST.state_in_rocksdb(spark) if rocksdb else nullcontext():
        started = writer.start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def plain(*names):
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


LATE = "l AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events)"


@query(f"WITH {LATE} SELECT user_id AS entity, date_trunc('hour', ts) AS hour_start, count(*) AS n FROM events, l GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= any_value(mark)")
def stream_hourly_counts(spark, sf):
    """The hours that the watermark has passed."""
    return landed(spark, ST.hourly_counts(streamed(spark, sf, "events"), "user_id", "ts"), "hourly").select("entity", *plain("hour_start"), "n")


@query(f"WITH {LATE}, w AS (SELECT user_id, date_trunc('day', ts) + INTERVAL 1 DAY + INTERVAL 6 HOUR * k AS until, ts FROM events, generate_series(-3, 3) t(k)) SELECT user_id AS entity, until, count(*) AS n FROM w, l WHERE ts < until AND ts >= until - INTERVAL 24 HOUR GROUP BY 1, 2 HAVING until <= any_value(mark)")
def stream_rolling_counts(spark, sf):
    return landed(spark, ST.rolling_counts(streamed(spark, sf, "events"), "user_id", "ts", step="6 hours"), "rolling").select("entity", *plain("until"), "n")


@query(f"WITH {LATE}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id AS entity, min(ts) AS first, max(ts) + INTERVAL 12 HOUR AS until, count(*) AS n FROM s, l GROUP BY user_id, run HAVING max(ts) + INTERVAL 12 HOUR <= any_value(mark)")
def stream_activity_runs(spark, sf):
    return landed(spark, ST.activity_runs(streamed(spark, sf, "events"), "user_id", "ts", "12 hours"), "runs").select("entity", *plain("first", "until"), "n")


@query("SELECT count(DISTINCT (user_id, event_type)) AS identities FROM events")
def stream_deduplicated(spark, sf):
    got = landed(spark, ST.deduplicated(streamed(spark, sf, "events"), ["user_id", "event_type"], "ts", "400 days"), "once")
    return got.agg(F.count("*").alias("identities"))


@query("SELECT e.event_id, f.event_id AS forecast_event_id FROM events e JOIN events f ON e.user_id = f.user_id AND f.event_type = 'error' AND f.ts <= e.ts AND f.ts > e.ts - INTERVAL 24 HOUR")
def stream_interval_join(spark, sf):
    e = streamed(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    issued = e.where("event_type = 'error'").select("user_id", "event_id", F.col("ts").alias("issued"))
    return landed(spark, ST.interval_join(e.drop("event_type"), issued, "user_id", "ts", "issued"), "near").select("event_id", "forecast_event_id")


@query("SELECT event_type AS provider, max(ts) AS last, (max(ts) < TIMESTAMP '2030-01-01 00:00:00' - INTERVAL 60 SECOND) AS degraded FROM events GROUP BY 1")
def stream_freshness(spark, sf):
    """The state of each provider after the last batch, told by a fixed clock."""
    at = folder(spark, "fresh")
    s = ST.freshness(streamed(spark, sf, "events"), "event_type", "ts", 60, "timestamp'2030-01-01 00:00:00'")
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/state/{n}")
    s.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).schema(s.schema).parquet(f"{at}/state")
    return got.groupBy("provider").agg(F.max_by("last", "last").alias("last"), F.max_by("degraded", "last").alias("degraded")).select("provider", *plain("last"), "degraded")


@query("""WITH c AS (SELECT user_id AS entity, epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events GROUP BY 1, 2) SELECT a.entity, a.hour, any_value(a.n) AS n, coalesce(sum(b.n), 0)::BIGINT AS prior_total,
 coalesce(sum(b.n) FILTER (b.hour >= a.hour - 24), 0)::BIGINT AS prior_24h, coalesce(sum(b.n) FILTER (b.hour >= a.hour - 168), 0)::BIGINT AS prior_7d,
 coalesce(sum(b.n) FILTER (b.hour >= a.hour - 720), 0)::BIGINT AS prior_30d, coalesce((a.hour - max(b.hour))::DOUBLE, -1.0) AS hours_since_prev
 FROM c a LEFT JOIN c b ON a.entity = b.entity AND b.hour < a.hour GROUP BY 1, 2""")
def stream_prior_counters(spark, sf):
    """Counters at arrival over five micro-batches, each a part of the time; they equal those of the batch."""
    at, c = folder(spark, "counted"), H.event_counts(table(spark, sf, "events"), "user_id", "ts")
    span = c.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).first()
    lo, hi = span if span.lo is not None else (0, 0)  # without events, all parts are empty
    for k in range(5):
        edge = lambda i: lo + (hi + 1 - lo) * i // 5
        c.where((F.col("hour") >= edge(k)) & (F.col("hour") < edge(k + 1))).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    return landed(spark, ST.prior_counters(stream), "counters", rocksdb=True)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '!' ELSE c_name END AS c_name, 1 AS created_at, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS updated_at FROM customer")
def stream_upsert(spark, sf):
    """Three micro-batches of new rows, then one that changes half of them, then all once more, which changes nothing."""
    at, c = folder(spark, "upserts"), table(spark, sf, "customer").select("c_custkey", "c_name")
    dated = lambda d, t: d.withColumns({"hash": R.content_hash(["c_name"]), "created_at": F.lit(t), "updated_at": F.lit(t)})
    changed = c.select("c_custkey", F.expr("if(c_custkey % 2 = 0, concat(c_name, '!'), c_name)").alias("c_name"))
    for k, (d, t, parts) in enumerate(((c, 1, 3), (changed, 2, 1), (changed, 3, 1))):
        ST.upsert_stream(in_batches(spark, dated(d, t), "customers", parts), f"{at}/table", ["c_custkey"], "hash", f"{at}/checkpoint-{k}").awaitTermination()
    return SK.current_version(spark, f"{at}/table").select("c_custkey", "c_name", "created_at", "updated_at")


@query("SELECT o_orderstatus AS status, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def stream_chunks(spark, sf):
    """Four micro-batches that all have rows of each chunk; the last is then written once more, as after a failure."""
    at, o = folder(spark, "appended"), table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    ST.append_chunks(in_batches(spark, o, "orders"), f"{at}/rows", "status", f"{at}/checkpoint", "orders").awaitTermination()
    CM.write_batch_chunks(o, f"{at}/rows", "status", "orders:3")
    return SK.read_chunks(spark, f"{at}/rows").groupBy("status").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query()
def fitted_classifier(spark, sf):
    """Held-out scores of boosted trees; tests hold them against their labels."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", (F.col("l_quantity") * (1 + F.col("l_discount")) > 26).cast("double").alias("y"))
    held = F.crc32(F.col("l_orderkey").cast("string")) % 3 == 1
    model = MO.fit_classifier(li.where(~held), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"], "y", "gbt", maxIter=5)
    from pyspark.ml.functions import vector_to_array

    return model.transform(li.where(held)).select("l_orderkey", "l_linenumber", "y", vector_to_array("probability")[1].alias("score"))


@query()
def tuned(spark, sf):
    """Trials of boosted trees with early stopping on held-out orders, best first, and whether the best would be accepted."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", (F.col("l_quantity") * (1 + F.col("l_discount")) > 26).cast("double").alias("y"))
    held = F.crc32(F.col("l_orderkey").cast("string")) % 3 == 1
    grid = [{"maxIter": 2, "maxDepth": 1}, {"maxIter": 4, "maxDepth": 3}]
    trials = MO.tune(li.where(~held), li.where(held), ["l_quantity", "l_discount"], ["l_returnflag"], "y", grid, key=["l_orderkey", "l_linenumber"], seeds=(1, 2))
    base = li.agg(F.avg("y").alias("val_pr"), F.avg("y").alias("test_pr"), F.lit(0.5).alias("ece"))
    best = MO.accepted_trial(trials, base, 0.9, 0.1).select("trial", "accepted")
    return trials.join(F.broadcast(best), "trial", "left")  # one row


@query()
def fitted_counts(spark, sf):
    """Expected orders of each customer by a Poisson model of balance; tests hold the sum against the count."""
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = table(spark, sf, "customer").join(n, "c_custkey", "left").select("c_custkey", (F.col("c_acctbal") / 10000).alias("x"), F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    return MO.count_model(c, ["x"], "n").transform(c).select("c_custkey", "n", F.col("prediction").alias("expected"))


@query("WITH c AS (SELECT user_id AS entity, epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT entity, hour, row_number() OVER (ORDER BY hour, entity) AS r FROM c) SELECT a.entity, a.hour, coalesce(sum(b.n), 0)::BIGINT AS score FROM c a LEFT JOIN c b ON b.entity = a.entity AND b.hour < a.hour GROUP BY 1, 2")
def hotspot_baseline(spark, sf):
    """The number of earlier events as a score."""
    c = H.event_counts(table(spark, sf, "events"), "user_id", "ts")
    return H.own_prior_counts(c, {"score": None}).select("entity", "hour", "score")
