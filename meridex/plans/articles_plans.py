"""Queries on articles and venue events. The provided tables hold no such prose, so orders and parts are put into words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import articles as A
from ..functions import hours as HR
from ..functions import text as T
from .registry import query, table

PHRASES = ("полностью перекрыт мост", "ремонт моста", "частично ограничен проезд на дорогах", "закрыта полоса движения", "сужение полос", "асфальтирование", "реконструкция развязки", "концерт в парке")
STREETS = ("Абая", "Сарыарка", "Кенесары")
# what each phrase must give: score, event type, restriction, severity
EXPECTED = """x AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i, unnest(['полностью перекрыт мост', 'ремонт моста', 'частично ограничен проезд на дорогах', 'закрыта полоса движения', 'сужение полос', 'асфальтирование', 'реконструкция развязки', 'концерт в парке']) AS title, unnest([3, 3, 3, 2, 2, 2, 3, 0]) AS score,
 unnest(['intersection_closure', 'bridge_repair', 'traffic_restriction', 'lane_closure', 'lane_closure', 'road_repair', 'road_reconstruction', 'traffic_restriction']) AS event_type, unnest(['full_closure', 'no_restriction', 'partial_closure', 'single_lane_closure', 'lane_narrowing', 'no_restriction', 'no_restriction', 'unknown']) AS restriction, unnest(['critical', 'unknown', 'medium', 'medium', 'medium', 'low', 'unknown', 'unknown']) AS severity)"""


def articles(spark, sf):
    """(o_orderkey, html): a phrase, for every third order a street and a section, and one of five forms of a period."""
    k = F.col("o_orderkey")
    d1, d2 = (1 + k % 27).cast("string"), (1 + k % 25).cast("string")
    of = lambda some, i: F.array(*map(F.lit, some))[i.cast("int")]
    place = F.when(k % 3 == 0, F.concat(F.lit(" На ул. "), of(STREETS, F.floor(k / 3) % 3), F.lit(" от Гоголя до Пушкина."))).otherwise("")
    form = F.floor(k / 8) % 5
    when = (
        F.when(form == 0, F.concat(F.lit("с "), d1, F.lit(" июля по "), d2, F.lit(" августа"))).when(form == 1, F.concat(F.lit("с 20:00 "), d1, F.lit(" июля"))).when(form == 2, F.concat(F.lit("до "), d2, F.lit(" августа")))
        .when(form == 3, F.concat(F.lit("С "), d1, F.lit(" шілде до "), d2, F.lit(" августа"))).otherwise("")
    )
    html = F.concat(F.lit("<html><h1>"), of(PHRASES, k % 8), F.lit("</h1><p>Дата 2 марта 2024."), place, F.lit("</p> <b>"), when, F.lit(".</b></html>"))
    return table(spark, sf, "orders").select("o_orderkey", html.alias("html"))


@query(f"""WITH {EXPECTED}, o AS (SELECT o_orderkey AS k, o_orderkey // 8 % 5 AS form FROM orders), y AS (SELECT *, make_timestamp(2024, 7, 1 + k % 27, CASE form WHEN 1 THEN 20 ELSE 0 END, 0, 0) AS s, make_timestamp(2024, 8, 1 + k % 25, 0, 0, 0) AS e, k % 3 = 0 AS at_street FROM o JOIN x ON x.i = k % 8)
 SELECT k AS o_orderkey, title, make_timestamp(2024, 3, 2, 0, 0, 0) AS published, score, event_type, restriction, severity, CASE WHEN form IN (0, 1, 3) THEN s END AS start, CASE WHEN form IN (0, 2, 3) THEN e END AS "end", form = 1 AS open_end, CASE form WHEN 1 THEN 'open_end_date' WHEN 4 THEN 'date_not_found' END AS warning,
 CASE WHEN at_street THEN 'ул. ' || ['Абая', 'Сарыарка', 'Кенесары'][1 + k // 3 % 3] END AS road_name, CASE WHEN at_street THEN 'Гоголя' END AS from_street, CASE WHEN at_street THEN 'Пушкина' END AS to_street, round(least(0.95, 0.35 + 0.15 * score - CASE WHEN form = 1 THEN 0.15 ELSE 0 END), 6)::DOUBLE AS confidence, score >= 3 OR (score >= 2 AND at_street) AS relevant FROM y""")
def article_record(spark, sf):
    got = A.article_record(articles(spark, sf), "html", F.lit(None).cast("timestamp_ntz"))
    return got.select("o_orderkey", "title", "published", "score", "event_type", "restriction", "severity", "start", "end", "open_end", "warning", "road_name", "from_street", "to_street", "confidence", "relevant")


@query("""WITH x AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i, unnest(['football_match', 'large_concert', 'festival', 'exhibition', 'theatre', 'public_event']) AS event_type, unnest([5, 5, 4, 2, 1, 2]) AS severity) SELECT p_partkey, event_type, severity, severity * CASE WHEN p_partkey % 9 = 0 THEN 1 WHEN p_size >= 30 THEN 1.5 WHEN p_size >= 10 THEN 1.3 WHEN p_size >= 5 THEN 1.15 ELSE 1 END::DOUBLE AS intensity FROM part JOIN x ON i = p_partkey % 6""")
def venue_event(spark, sf):
    name = F.array(*map(F.lit, ("Матч сезона", "Большой Концерт", "Фестиваль", "Expo", "Спектакль", "Встреча")))[(F.col("p_partkey") % 6).cast("int")]
    capacity = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") * 1000)
    got = A.venue_event(name, F.lit(None).cast("string"), F.col("p_brand"), capacity)
    return table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in got.items()])


@query("""WITH t AS (SELECT s_suppkey AS k, s_suppkey % 7 AS e, CASE s_suppkey % 4 WHEN 0 THEN 'very_high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'unknown' END AS tier FROM supplier), i AS (SELECT *, CASE WHEN e = 0 THEN 0 WHEN e IN (1, 2) THEN CASE tier WHEN 'very_high' THEN 5 WHEN 'high' THEN 4 ELSE 3 END WHEN e = 3 THEN CASE WHEN tier IN ('high', 'very_high') THEN 4 ELSE 3 END WHEN e = 4 THEN 0 WHEN tier IN ('high', 'very_high') THEN 2 ELSE 1 END AS impact FROM t)
 SELECT k AS s_suppkey, tier, impact >= 3 AS relevant, impact, ['exclude', 'low', 'medium', 'high', 'high', 'very_high'][impact + 1] AS class, CASE e WHEN 0 THEN 'cinema' WHEN 4 THEN 'online' END AS exclusion FROM i""")
def transport_impact(spark, sf):
    """Events of several kinds at venues of all tiers; exclusions go before what draws crowds."""
    k = F.col("s_suppkey")
    words = F.array(*map(F.lit, ("Кино-концерт", "МАТЧ", "Concert", "Фестиваль", "Онлайн форум", "Встреча", "")))[(k % 7).cast("int")]
    venue = F.array(*map(F.lit, ("The Astana ARENA", "Дворец независимости", "EXPO hall", "Somewhere")))[(k % 4).cast("int")]
    df = A.venue_tier(table(spark, sf, "supplier").select("s_suppkey", words.alias("title"), venue.alias("venue")), "s_suppkey", F.col("venue"))
    return df.select("s_suppkey", "tier", *[c.alias(n) for n, c in A.transport_impact(F.concat_ws(" ", "title", "venue"), F.col("tier")).items()])


@query("SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9_]', '', 'g') AS key FROM nation")
def road_key(spark, sf):
    k, name = F.col("n_nationkey") % 4, F.col("n_name")
    spoken = F.when(k == 0, F.concat(F.lit("Улица "), name)).when(k == 1, F.concat(F.lit("  ПРОСПЕКТ  "), name)).when(k == 2, F.concat(name, F.lit(" Street, от Гоголя до Абая"))).otherwise(F.concat(name, F.lit(" көшесі")))
    return table(spark, sf, "nation").select("n_nationkey", A.road_key(spoken).alias("key"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN [event_type, (event_id % 5)::VARCHAR] ELSE [] END AS items FROM events")
def json_lists(spark, sf):
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, F.concat(F.lit('["'), "event_type", F.lit('", '), k % 5, F.lit("]"))).when(k % 4 == 1, F.lit('{"a": ["b"]}')).when(k % 4 == 2, F.lit("[broken"))
    return table(spark, sf, "events").select("event_id", T.json_list(raw).alias("items"))


@query("""WITH e AS (SELECT event_id, (event_id * 7 % 60 - 20)::DOUBLE AS t, (event_id % 101)::DOUBLE AS h, CASE WHEN event_id % 5 > 0 THEN 20000 + event_id % 3600 END AS rise, 60000 + event_id % 7200 AS fall, event_id % 86400 AS tm FROM events), g AS (SELECT *, ln(greatest(h, 0.1) / 100) + 17.62 * t / (243.12 + t) AS gamma FROM e)
 SELECT event_id, round(243.12 * gamma / (17.62 - gamma), 5) AS dew_point, round((fall - rise) / 3600, 6) AS day_length, round(greatest(24 - (fall - rise) / 3600, 0), 6) AS dark_hours, round(greatest((rise - tm) / 3600, 0), 6) AS until_sunrise, round(greatest((fall - tm) / 3600, 0), 6) AS until_sunset FROM g WHERE rise IS NOT NULL
 UNION ALL SELECT event_id, round(243.12 * gamma / (17.62 - gamma), 5), NULL, NULL, NULL, round(greatest((fall - tm) / 3600, 0), 6) FROM g WHERE rise IS NULL""")
def sun_and_dew(spark, sf):
    k = F.col("event_id")
    sun = HR.sun_times(k % 86400, F.when(k % 5 > 0, 20000 + k % 3600), 60000 + k % 7200)
    dew = HR.dew_point((k * 7 % 60 - 20).cast("double"), (k % 101).cast("double"))
    return table(spark, sf, "events").select("event_id", F.round(dew, 5).alias("dew_point"), *[F.round(c, 6).alias(n) for n, c in sun.items()])
