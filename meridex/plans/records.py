"""Queries on cleaning, profiling, keys, upserts and pages of text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import models as MO
from ..operators import records as R
from ..operators.segments import quantiles
from ..operators.tables import folder
from ..sources import commits as CM
from ..sources import sinks as SK
from .registry import query, table

NULLED = "p AS (SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part)"


def parts(spark, sf):
    """Parts with nulls made by a rule."""
    p = table(spark, sf, "part")
    return p.withColumns({"p_size": F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")), "p_retailprice": F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice"))})


@query(f"WITH {NULLED} SELECT CASE WHEN p_brand IS NULL THEN 'no_brand' WHEN p_size IS NULL THEN 'no_size' WHEN p_retailprice IS NULL THEN 'no_price' ELSE 'kept' END AS reason, count(*) AS n FROM p GROUP BY 1")
def required_filter_counts(spark, sf):
    p = parts(spark, sf)
    why = R.first_failure({"no_brand": F.col("p_brand").isNull(), "no_size": F.col("p_size").isNull(), "no_price": F.col("p_retailprice").isNull()})
    return p.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT vec_id, NOT coalesce(embedding[1] BETWEEN -0.1 AND 0.1 AND embedding[2] BETWEEN -0.1 AND 0.1, false) AS suspicious FROM embeddings")
def bbox_suspicious(spark, sf):
    inside = F.col("embedding")[0].cast("double").between(-0.1, 0.1) & F.col("embedding")[1].cast("double").between(-0.1, 0.1)
    return table(spark, sf, "embeddings").select("vec_id", (~F.coalesce(inside, F.lit(False))).alias("suspicious"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM embeddings WHERE embedding[1] BETWEEN 0 AND 0.2 AND embedding[2] BETWEEN -0.2 AND 0")
def bbox_query(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return e.where("x between 0 and 0.2 and y between -0.2 and 0").select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {NULLED} SELECT coalesce(p_retailprice <= 1200, false) AS valid, count(*) AS n, count(p_retailprice) AS with_price FROM p GROUP BY 1")
def valid_vs_suspicious(spark, sf):
    return parts(spark, sf).groupBy(F.coalesce(F.col("p_retailprice") <= 1200, F.lit(False)).alias("valid")).agg(F.count("*").alias("n"), F.count("p_retailprice").alias("with_price"))


@query("SELECT CASE WHEN o_totalprice <= 100000 THEN 'high' WHEN o_totalprice <= 300000 THEN 'medium' WHEN o_totalprice <= 400000 THEN 'low' ELSE 'very_low' END AS confidence, count(*) AS n FROM orders GROUP BY 1")
def confidence_bins(spark, sf):
    return table(spark, sf, "orders").groupBy(R.bin_label(F.col("o_totalprice"), [100000, 300000, 400000], ["high", "medium", "low", "very_low"]).alias("confidence")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN s < 0.25 THEN 'low' WHEN s < 0.5 THEN 'medium' WHEN s < 0.75 THEN 'high' ELSE 'critical' END AS level, count(*) AS n FROM (SELECT l_discount * 10 AS s FROM lineitem) GROUP BY 1")
def risk_level_counts(spark, sf):
    level = R.risk_level(F.col("l_discount") * 10, [(0.0, "low"), (0.25, "medium"), (0.5, "high"), (0.75, "critical")])
    return table(spark, sf, "lineitem").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("SELECT i - 1 AS position, c_custkey, c_name FROM (SELECT unnest([17, 3, 101, 42]) AS c_custkey, unnest([1, 2, 3, 4]) AS i) JOIN customer USING (c_custkey)")
def lookup_ordered(spark, sf):
    return R.lookup_ordered(table(spark, sf, "customer"), "c_custkey", [17, 3, 101, 42]).select("position", "c_custkey", "c_name")


@query("SELECT page_id, url, regexp_extract(url, '/([0-9]+)', 1) AS item FROM (SELECT *, row_number() OVER (PARTITION BY regexp_extract(url, '/([0-9]+)', 1) ORDER BY page_id) AS r FROM pages WHERE regexp_matches(url, '^https://.*/[0-9]+')) WHERE r = 1")
def canonical_urls(spark, sf):
    p = table(spark, sf, "pages").where(F.col("url").rlike("^https://.*/[0-9]+")).withColumn("item", F.regexp_extract("url", "/([0-9]+)", 1))
    return R.dedupe_first(p, ["item"], [F.col("page_id")]).select("page_id", "url", "item")


@query("SELECT doc_id, text AS first_text, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_first(spark, sf):
    return R.dedupe_first(table(spark, sf, "documents"), ["lang", "source"], [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", F.col("text").alias("first_text"), "lang")


@query(f"""WITH {NULLED}, q AS (SELECT count(*) AS a, count(p_size) AS s, count(DISTINCT p_size) AS sd, count(p_retailprice) AS r, count(DISTINCT p_retailprice) AS rd, count(p_brand) AS b, count(DISTINCT p_brand) AS bd FROM p),
 u AS (SELECT 'p_size' AS column_name, s AS non_null, a, sd AS distinct_values FROM q UNION ALL SELECT 'p_retailprice', r, a, rd FROM q UNION ALL SELECT 'p_brand', b, a, bd FROM q) SELECT column_name, non_null, a - non_null AS missing, round(100 * (a - non_null) / a, 6) AS missing_pct, distinct_values, CASE column_name WHEN 'p_size' THEN (SELECT list(v) FROM (SELECT DISTINCT p_size::VARCHAR AS v FROM p WHERE p_size IS NOT NULL ORDER BY 1 LIMIT 5)) WHEN 'p_brand' THEN (SELECT list(v) FROM (SELECT DISTINCT p_brand AS v FROM p WHERE p_brand IS NOT NULL ORDER BY 1 LIMIT 5)) END AS samples FROM u WHERE column_name <> 'p_retailprice'""")
def column_profile(spark, sf):
    return A.column_profile(parts(spark, sf), ["p_size", "p_brand"])


@query(f"WITH {NULLED} SELECT 'p_size' AS column_name, round(avg((p_size IS NULL)::INT), 6) AS missing_rate FROM p UNION ALL SELECT 'p_retailprice', round(avg((p_retailprice IS NULL)::INT), 6) FROM p")
def missing_rates(spark, sf):
    return A.missing_rates(parts(spark, sf), {"p_size": F.col("p_size"), "p_retailprice": F.col("p_retailprice")})


@query("""WITH d AS (SELECT text, lang, source, n_chars FROM documents), t AS (SELECT text AS k, count(*) AS n FROM d WHERE trim(text) <> '' GROUP BY 1 HAVING count(*) > 1), c AS (SELECT lang || '|' || source || '|' || n_chars AS k, count(*) AS n FROM d GROUP BY lang, source, n_chars HAVING count(*) > 1), f AS (SELECT coalesce(text, '') || '|' || lang || '|' || source || '|' || n_chars AS k, count(*) AS n FROM d GROUP BY text, lang, source, n_chars HAVING count(*) > 1)
 SELECT 'text' AS identifier, coalesce(sum(n), 0)::BIGINT AS duplicated_rows, count(*) AS duplicated_keys, (SELECT coalesce(list(k), []) FROM (SELECT k FROM t ORDER BY k LIMIT 3)) AS samples FROM t UNION ALL SELECT 'lang_source_size', coalesce(sum(n), 0)::BIGINT, count(*), (SELECT coalesce(list(k), []) FROM (SELECT k FROM c ORDER BY k LIMIT 3)) FROM c UNION ALL SELECT 'full_row', coalesce(sum(n), 0)::BIGINT, count(*), (SELECT coalesce(list(k), []) FROM (SELECT k FROM f ORDER BY k LIMIT 3)) FROM f""")
def duplicate_report(spark, sf):
    return A.duplicate_report(table(spark, sf, "documents").select("text", "lang", "source", "n_chars"), {"text": ["text"], "lang_source_size": ["lang", "source", "n_chars"]})


@query("SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS n FROM orders GROUP BY 1, 2")
def time_distribution(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))


@query(f"""WITH {NULLED}, u AS (SELECT 'p_size' AS column_name, p_size::VARCHAR AS value FROM p UNION ALL SELECT 'p_brand', p_brand FROM p), g AS (SELECT column_name, value, count(*) AS n FROM u GROUP BY 1, 2)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value NULLS FIRST) AS nth FROM g) WHERE nth <= 10""")
def frequent_values(spark, sf):
    return A.frequent_values(parts(spark, sf), ["p_size", "p_brand"], 10)


@query("SELECT count(*) FILTER (isinf(o_totalprice)) AS infinite, count(*) FILTER (o_totalprice < 0) AS negative, count(*) FILTER (o_totalprice IS NULL) AS missing FROM orders")
def numeric_sanity(spark, sf):
    n = lambda c: F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0))
    return table(spark, sf, "orders").agg(n("abs(o_totalprice) = double('infinity')").alias("infinite"), n("o_totalprice < 0").alias("negative"), n("o_totalprice is null").alias("missing"))


@query("SELECT round(min(v), 6) AS lo, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS hi, count(*) FILTER (v > 100000) AS over_100k, count(*) FILTER (v > 300000) AS over_300k FROM (SELECT o_totalprice AS v FROM orders)")
def distance_quantiles(spark, sf):
    o = table(spark, sf, "orders").withColumn("v", F.col("o_totalprice"))
    n = lambda x: F.sum((F.col("v") > x).cast("long"))
    got = o.agg(n(100000).alias("over_100k"), n(300000).alias("over_300k"))
    named = [F.round(F.col("v")[i], 6).alias(c) for i, c in enumerate(("lo", "p50", "p90", "p95", "hi"))]
    return quantiles(o, ["v"], [0.0, 0.5, 0.9, 0.95, 1.0]).select(*named).join(F.broadcast(got))  # one row each


@query(f"WITH {NULLED} SELECT p_type, round(median(p_size), 6) AS p_size_median, round(median(p_retailprice), 6) AS p_retailprice_median FROM p GROUP BY 1")
def median_by_group(spark, sf):
    return MO.median_by_group(parts(spark, sf), "p_type", ["p_size", "p_retailprice"])


@query(f"WITH {NULLED}, m AS (SELECT median(p_size) AS a, median(p_retailprice) AS b FROM p WHERE p_partkey % 3 <> 0) SELECT p_partkey, coalesce(p_size::DOUBLE, a) AS p_size, round(coalesce(p_retailprice, b), 6) AS p_retailprice FROM p, m WHERE p_partkey % 3 = 0")
def median_impute(spark, sf):
    p = parts(spark, sf)
    got = MO.median_impute(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 3 = 0"), ["p_size", "p_retailprice"])
    return got.select("p_partkey", "p_size", F.round("p_retailprice", 6).alias("p_retailprice"))


@query("WITH k AS (SELECT p_type FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1 HAVING count(*) >= 200) SELECT p_partkey, CASE WHEN p_type IS NULL THEN 'UNKNOWN' WHEN p_type IN (SELECT p_type FROM k) THEN p_type ELSE 'OTHER' END AS p_type FROM part WHERE p_partkey % 3 = 0")
def rare_to_other(spark, sf):
    p = table(spark, sf, "part")
    return MO.rare_to_other(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 3 = 0"), "p_type", 200).select("p_partkey", "p_type")


@query("WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey), p_brand) - 1 AS c FROM part WHERE p_size < 20 GROUP BY 1) SELECT p_partkey, coalesce(c, -1)::INT AS p_brand_code FROM part LEFT JOIN b USING (p_brand) WHERE p_size >= 20")
def ordinal_codes(spark, sf):
    p = table(spark, sf, "part")
    return MO.ordinal_codes(p.where("p_size < 20"), p.where("p_size >= 20"), "p_brand", "p_partkey").select("p_partkey", "p_brand_code")


@query(f"WITH {NULLED}, m AS (SELECT p_type, median(p_size) AS a, median(p_retailprice) AS b FROM p GROUP BY 1) SELECT p_partkey, coalesce(p_size > a, false)::INT AS p_size_high, coalesce(p_retailprice > b, false)::INT AS p_retailprice_high, coalesce(p_size > a, false)::INT + coalesce(p_retailprice > b, false)::INT AS high_count FROM p JOIN m USING (p_type)")
def structural_flags(spark, sf):
    p = parts(spark, sf)
    got = MO.structural_flags(p, MO.median_by_group(p, "p_type", ["p_size", "p_retailprice"]), "p_type", ["p_size", "p_retailprice"])
    return got.select("p_partkey", "p_size_high", "p_retailprice_high", "high_count")


@query(f"WITH {NULLED} SELECT p_partkey, coalesce(p_size >= 25, false)::INT AS big, coalesce(p_retailprice >= 1500, false)::INT AS dear, greatest(coalesce(p_size >= 25, false)::INT, coalesce(p_retailprice >= 1500, false)::INT) AS any_adverse FROM p")
def adverse_flags(spark, sf):
    flags = MO.adverse_flags({"big": (F.col("p_size"), 25), "dear": (F.col("p_retailprice"), 1500)})
    return parts(spark, sf).select("p_partkey", *[c.alias(n) for n, c in flags.items()])


@query(f"WITH {NULLED} SELECT p_partkey, coalesce(p_size >= 25, false)::INT * coalesce(p_retailprice, 0) AS big_price, concat_ws('|', p_brand, coalesce(p_type, '__MISSING__')) AS brand_type FROM p")
def interactions(spark, sf):
    big = F.coalesce(F.col("p_size") >= 25, F.lit(False)).cast("int")
    return parts(spark, sf).select("p_partkey", (big * F.coalesce("p_retailprice", F.lit(0.0))).alias("big_price"), F.concat_ws("|", "p_brand", F.coalesce("p_type", F.lit("__MISSING__"))).alias("brand_type"))


@query(f"WITH {NULLED}, c AS (SELECT p_partkey, (coalesce(p_size, 0) - 25) / 50 AS size_part, (coalesce(p_retailprice, 1200) - 1200) / 600 AS price_part, (p_partkey % 11 - 5) / 10 AS key_part FROM p), u AS (UNPIVOT c ON size_part, price_part, key_part INTO NAME name VALUE v), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY v DESC, name DESC) AS up, row_number() OVER (PARTITION BY p_partkey ORDER BY v, name) AS down FROM u WHERE v <> 0) SELECT p.p_partkey, coalesce((SELECT list(name ORDER BY v DESC, name DESC) FROM r WHERE r.p_partkey = p.p_partkey AND v > 0 AND up <= 2), []) AS raising, coalesce((SELECT list(name ORDER BY v, name) FROM r WHERE r.p_partkey = p.p_partkey AND v < 0 AND down <= 2), []) AS lowering FROM p")
def top_factors(spark, sf):
    c = parts(spark, sf).select("p_partkey", ((F.coalesce("p_size", F.lit(0)) - 25) / 50).alias("size_part"), ((F.coalesce("p_retailprice", F.lit(1200.0)) - 1200) / 600).alias("price_part"), ((F.col("p_partkey") % 11 - 5) / 10).alias("key_part"))
    return c.select("p_partkey", *[x.alias(n) for n, x in R.top_factors(["size_part", "price_part", "key_part"], 2).items()])


BOTH = """t AS (SELECT c_custkey, c_name, round(c_acctbal, 2) AS bal, 1 AS created_at, 1 AS updated_at FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, c_name, round(c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END, 2) AS bal, 2 AS created_at, 2 AS updated_at FROM customer WHERE c_custkey % 2 = 0)"""


def both_sides(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    t = c.where("c_custkey % 3 <> 0").withColumns({"bal": F.round("c_acctbal", 2), "created_at": F.lit(1), "updated_at": F.lit(1)})
    n = c.where("c_custkey % 2 = 0").withColumns({"bal": F.round(F.col("c_acctbal") + F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0), 2), "created_at": F.lit(2), "updated_at": F.lit(2)})
    keep = lambda d: d.drop("c_acctbal").withColumn("hash", R.content_hash(["c_name", "bal"]))
    return keep(t), keep(n)


ST = BOTH + ", j AS (SELECT coalesce(t.c_custkey, n.c_custkey) AS k, CASE WHEN t.c_custkey IS NULL THEN 'new' WHEN n.c_custkey IS NULL THEN 'kept' WHEN t.bal = n.bal THEN 'unchanged' ELSE 'updated' END AS status, t.bal AS tb, n.bal AS nb FROM t FULL JOIN n USING (c_custkey))"


@query(f"WITH {ST} SELECT status, count(*) AS n FROM j GROUP BY 1")
def upsert_status(spark, sf):
    return R.upsert(*both_sides(spark, sf), ["c_custkey"], "hash").groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {ST} SELECT k AS c_custkey, CASE WHEN status IN ('new', 'updated') THEN nb ELSE tb END AS bal, CASE WHEN status = 'new' THEN 2 ELSE 1 END AS created_at, CASE WHEN status IN ('new', 'updated') THEN 2 ELSE 1 END AS updated_at, status FROM j")
def upsert_result(spark, sf):
    return R.upsert(*both_sides(spark, sf), ["c_custkey"], "hash").select("c_custkey", "bal", "created_at", "updated_at", "status")


@query(f"WITH {ST}, s AS (SELECT j.*, c_nationkey FROM j JOIN customer c ON c.c_custkey = k), i AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey % 4 <> 0) SELECT s.k AS c_custkey, CASE WHEN x.c_custkey IS NULL AND s.status IN ('unchanged', 'updated') THEN CASE WHEN s.c_nationkey IN (SELECT * FROM i) THEN 'deleted' ELSE 'kept' END WHEN s.status = 'kept' AND s.c_nationkey IN (SELECT * FROM i) THEN 'deleted' ELSE s.status END AS status FROM s LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey % 4 <> 0) x ON x.c_custkey = s.k WHERE NOT (x.c_custkey IS NULL AND s.status = 'new')")
def upsert_scoped(spark, sf):
    t, n = both_sides(spark, sf)
    return R.upsert_scoped(t, n.where("c_nationkey % 4 <> 0"), ["c_custkey"], ["c_nationkey"], "hash").select("c_custkey", "status")


@query("SELECT 'b' || (o_orderkey % 3) AS batch, o_orderkey AS id, o_totalprice AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_orderkey % 3 = 1) WHERE rank <= 20")
def latest_batch_top(spark, sf):
    """The 20 best rows of the latest complete batch of a store, one batch being written twice and another never finished."""
    at = folder(spark, "batches")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    for k, day in ((0, "2024-01-01"), (1, "2024-01-03"), (1, "2024-01-03"), (2, "2024-01-02")):
        SK.write_batch(o.where(F.col("id") % 3 == k), at, f"b{k}", day)
    CM.write_attempt(o, at, None, "b9", "2024-01-09")
    rows = SK.top_of_batch(SK.read_batch(spark, at), "score", "id", 20)
    return rows.select(F.col("batch_id").alias("batch"), "id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))  # 20 rows


@query("SELECT 'c_name' AS column_name, count(*) AS n, sum(('0x' || substr(md5(coalesce(c_name, 'null')), 1, 8))::BIGINT)::BIGINT AS checksum FROM customer UNION ALL SELECT 'c_custkey', count(*), sum(('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT)::BIGINT FROM customer")
def column_checksum(spark, sf):
    return R.frame_checksum(table(spark, sf, "customer"), ["c_name", "c_custkey"])


@query("""WITH f AS (SELECT count(*) FILTER (o_totalprice IS NULL) AS a, count(*) FILTER (o_totalprice > 450000) AS b, count(*) FILTER (year(o_orderdate) < 1995) AS c FROM orders)
 SELECT 'price_missing' AS check_name, 'error' AS severity, a AS failures, CASE WHEN a = 0 THEN 'pass' ELSE 'fail' END AS status FROM f UNION ALL SELECT 'price_high', 'warning', b, CASE WHEN b = 0 THEN 'pass' ELSE 'fail' END FROM f UNION ALL SELECT 'date_early', 'error', c, CASE WHEN c = 0 THEN 'pass' ELSE 'fail' END FROM f
 UNION ALL SELECT 'overall', 'summary', a + b + c, CASE WHEN a + c > 0 THEN 'NOT READY' WHEN b > 0 THEN 'READY WITH WARNINGS' ELSE 'READY' END FROM f""")
def check_suite(spark, sf):
    return A.check_suite(table(spark, sf, "orders"), {"price_missing": ("error", F.col("o_totalprice").isNull()), "price_high": ("warning", F.col("o_totalprice") > 450000), "date_early": ("error", F.year("o_orderdate") < 1995)})


@query("SELECT o.o_orderkey, c.c_mktsegment, n.n_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def enrich_left(spark, sf):
    from ..operators.joins import enrich

    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = enrich(o, table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey")), ["c_custkey"])
    return enrich(c, table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).select("o_orderkey", "c_mktsegment", "n_name")


@query("SELECT doc_id, length(regexp_replace(trim(text), '[ \\t\\n]+', ' ', 'g')) AS n, upper(left(text, 1)) = left(text, 1) AS capital, list_max(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: CASE WHEN length(x) < 10 THEN x::BIGINT END)) AS biggest FROM documents")
def numeric_from_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.length(T.squeeze(F.col("text"))).alias("n"), (F.upper(F.substring("text", 1, 1)) == F.substring("text", 1, 1)).alias("capital"), T.largest_number(F.col("text")).alias("biggest"))


@query("SELECT conv_id, turn, regexp_matches(lpad(((conv_id * 7 + turn) % 30)::VARCHAR, 2, '0') || ':' || lpad(((conv_id + turn * 13) % 70)::VARCHAR, 2, '0'), '^([01][0-9]|2[0-3]):[0-5][0-9]$') AS good FROM conversations")
def time_format_check(spark, sf):
    c = table(spark, sf, "conversations")
    t = F.concat(F.lpad(((F.col("conv_id") * 7 + F.col("turn")) % 30).cast("string"), 2, "0"), F.lit(":"), F.lpad(((F.col("conv_id") + F.col("turn") * 13) % 70).cast("string"), 2, "0"))
    return c.select("conv_id", "turn", T.is_clock_time(t).alias("good"))


@query("SELECT event_id, (make_timestamp(epoch_us(ts) - epoch_us(ts) % 86400000000 + ((event_id * 37) % 1440) * 60000000)) AS local_ts, hour(make_timestamp(((event_id * 37) % 1440) * 60000000))::INT AS hour FROM events")
def local_datetime(spark, sf):
    e = table(spark, sf, "events")
    clock = F.concat(F.lpad(F.floor((F.col("event_id") * 37) % 1440 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(((F.col("event_id") * 37) % 60).cast("string"), 2, "0"))
    at = T.date_and_clock(F.unix_millis(F.col("ts").cast("timestamp")), clock, "UTC")
    return e.select("event_id", at.alias("local_ts"), F.hour(at).alias("hour"))


@query("SELECT count(*) FILTER (year(l_shipdate) <> year(o_orderdate)) AS year_mismatch, count(*) FILTER (month(l_shipdate) <> month(o_orderdate)) AS month_mismatch, count(*) AS rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_part_mismatches(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = lambda f: F.sum((f("l_shipdate") != f("o_orderdate")).cast("long"))
    return j.agg(n(F.year).alias("year_mismatch"), n(F.month).alias("month_mismatch"), F.count("*").alias("rows"))


@query("SELECT s_suppkey, round(n / (s_acctbal::DOUBLE * 0 + 100 + 20), 6) AS per_length, round(1 - exp(-n / 600.0), 6) AS probability FROM supplier JOIN (SELECT l_suppkey AS s_suppkey, count(*) AS n FROM lineitem GROUP BY 1) USING (s_suppkey)")
def exposure_rates(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "supplier").join(n, "s_suppkey").select("s_suppkey", F.round(F.col("n") / (F.lit(100.0) + 20), 6).alias("per_length"), F.round(1 - F.exp(-F.col("n") / 600), 6).alias("probability"))


@query("SELECT year(o_orderdate)::INT AS year, round(avg((o_orderstatus = 'F')::INT), 6) AS done, round(avg((o_totalprice > 100000)::INT), 6) AS dear, round(1 - count(DISTINCT (o_custkey, o_orderdate)) / count(*), 6) AS duplicate_rate FROM orders GROUP BY 1")
def quality_rates(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("done"), F.round(F.avg((F.col("o_totalprice") > 100000).cast("double")), 6).alias("dear"), F.round(1 - F.count_distinct("o_custkey", "o_orderdate") / F.count("*"), 6).alias("duplicate_rate"))


# the entities that the pages hold, the ampersand last and with or without its semicolon
READ = "regexp_replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&quot;', chr(34)), '&amp;?', '&', 'g')"


def shown(c: str) -> str:
    """The text of a piece of HTML in SQL."""
    return "trim(regexp_replace(" + READ.format(f"regexp_replace(regexp_replace({c}, '(?i)<script(?s:.*?)</script>|<style(?s:.*?)</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')") + r", '\s+', ' ', 'g'))"


def first_of(tag: str) -> str:
    found = f"regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1)"
    return f"CASE WHEN regexp_matches(html, '(?is)<{tag}[^>]*>.*?</{tag}>') THEN {shown(found)} END"


@query(f"SELECT page_id, {shown('html')} AS plain FROM pages")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("plain"))


@query(f"SELECT page_id, {first_of('h1')} AS h1, {first_of('title')} AS title, {first_of('h5')} AS none FROM pages")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", *[T.tag_text(F.col("html"), t).alias(n) for t, n in (("h1", "h1"), ("title", "title"), ("h5", "none"))])


SHELLS = """SELECT page_id, CASE page_id % 5 WHEN 1 THEN regexp_replace(html, '(?is)<h1[^>]*>.*?</h1>', '<h1> &nbsp;</h1>') WHEN 2 THEN html || '<DIV id="root"></DIV>' WHEN 3 THEN html[1:700] ELSE html END AS html FROM pages"""


@query(f"""SELECT page_id, coalesce({first_of('h1')}, '') = '' OR length({shown('html')}) < 400 OR contains(lower(html), '<div id="root"') OR contains(lower(html), 'you need to enable javascript') OR contains(lower(html), '/static/js/main') AS shell FROM ({SHELLS})""")
def html_shell(spark, sf):
    """Pages, some with an empty heading, a marker or little text."""
    k, html = F.col("page_id") % 5, F.col("html")
    made = F.when(k == 1, F.regexp_replace(html, "(?is)<h1[^>]*>.*?</h1>", "<h1> &nbsp;</h1>")).when(k == 2, F.concat(html, F.lit('<DIV id="root"></DIV>'))).when(k == 3, F.substring(html, 1, 700)).otherwise(html)
    return table(spark, sf, "pages").select("page_id", T.is_shell(made).alias("shell"))


@query("SELECT page_id, chr((161 + page_id % 700)::INT) || '|' || chr((913 + page_id % 20)::INT) || '|é«' || chr(8734) || '&x&¬it;' AS read FROM pages")
def html_entities(spark, sf):
    """Entities by number, hexadecimal number and name, with and without semicolon."""
    k = F.col("page_id")
    text = F.concat(F.lit("&#"), 161 + k % 700, F.when(k % 2 == 0, ";|").otherwise("|"), F.lit("&#x"), F.hex(913 + k % 20), F.lit(";|&eacute;&laquo&infin;&x&amp;&notit;"))
    return table(spark, sf, "pages").select("page_id", T.unescape(text).alias("read"))


@query("WITH l AS (SELECT page_id, regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1) AS a FROM pages), u AS (SELECT page_id, a[i] AS link, i FROM (SELECT *, unnest(generate_series(1, len(a))) AS i FROM l)), d AS (SELECT page_id, link, min(i) AS i FROM u GROUP BY 1, 2) SELECT page_id, 'https://example.org' || link AS link, row_number() OVER (PARTITION BY page_id ORDER BY i) AS place FROM d")
def html_links(spark, sf):
    return T.links(table(spark, sf, "pages"), "page_id", "html", 'href="(/[^"]*)"', "https://example.org")


@query("WITH k AS (SELECT unnest(['idiot', 'moron', 'worthless']) AS w, unnest([1, 2, 3]) AS p), m AS (SELECT doc_id, min(p) AS p FROM documents, k WHERE contains(lower(text), w) GROUP BY 1) SELECT d.doc_id, coalesce(w, 'none') AS kind FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN k USING (p)")
def keyword_classify(spark, sf):
    kind = T.first_keyword(F.lower("text"), {"idiot": "idiot", "moron": "moron", "worthless": "worthless"}, "none")
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"))


@query("SELECT doc_id, score, CASE WHEN score >= 2 THEN 'strong' WHEN score = 1 THEN 'weak' ELSE 'none' END AS class FROM (SELECT doc_id, regexp_matches(lower(text), 'license|copyright')::INT + regexp_matches(lower(text), 'rights reserved|version [0-9]')::INT + regexp_matches(lower(text), 'apache|mit|gnu')::INT AS score FROM documents)")
def article_classify(spark, sf):
    s = T.group_score(F.lower("text"), ["license|copyright", "rights reserved|version [0-9]", "apache|mit|gnu"])
    return table(spark, sf, "documents").select("doc_id", s.alias("score"), F.when(s >= 2, "strong").when(s == 1, "weak").otherwise("none").alias("class"))


@query("""WITH w AS (SELECT doc_id, list_filter(['license', 'copyright'], lambda x: contains(t, x)) AS strong, list_filter(['rights', 'released'], lambda x: contains(t, x)) AS weak, list_filter(['reserved', 'under', 'all'], lambda x: contains(t, x)) AS context FROM (SELECT doc_id, lower(coalesce(source, '') || ' ' || coalesce(text, '')) AS t FROM documents))
 SELECT *, (2 * len(strong) + len(weak) + len(context))::INT AS score, len(strong) > 0 OR (len(weak) > 0 AND len(context) > 0) AS selected, CASE WHEN len(strong) = 0 AND (len(weak) = 0 OR len(context) = 0) THEN 'no_strong_road_event_term_or_weak_term_with_road_context' END AS rejection_reason FROM w""")
def text_prefilter(spark, sf):
    """Matched words, score, decision and reason for each text."""
    card = T.prefilter_card(F.col("source"), F.col("text"), ("license", "copyright"), ("rights", "released"), ("reserved", "under", "all"))
    return table(spark, sf, "documents").select("doc_id", card.alias("c")).select("doc_id", "c.*")


@query("SELECT p_partkey, ' ' || p_name || ' ' AS spaced, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS kept, lower(p_name) || ' fi x' AS plain, lower(p_brand) || 'ss' AS folded FROM part")
def clean_strings(spark, sf):
    """Blanks squeezed, blank to null, compatible characters, case folding."""
    name, k = F.col("p_name"), F.col("p_partkey")
    padded = F.concat(F.lit("\t \n"), name, F.lit("   "))
    return table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit(" "), T.squeeze(F.translate(padded, "\t\n", "  ")), F.lit(" ")).alias("spaced"), T.blank_to_null(F.when(k % 3 > 0, F.concat(F.lit(" "), name, F.lit(" \n"))).otherwise("  \t")).alias("kept"),
        T.normalised(F.concat(name, F.lit("  ﬁ X "))).alias("plain"), T.casefolded(F.concat("p_brand", F.lit("ß"))).alias("folded"),
    )


@query("SELECT o_orderkey, [o_orderstatus, o_orderpriority, (o_orderkey % 7)::VARCHAR] AS items FROM orders WHERE o_orderkey % 4 < 3 UNION ALL SELECT o_orderkey, [] FROM orders WHERE o_orderkey % 4 = 3")
def list_like_strings(spark, sf):
    """Items of lists in three spellings, and of an empty one."""
    k, parts = F.col("o_orderkey"), ("o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 7).cast("string"))
    some = lambda sep: F.concat_ws(sep, *parts)
    text = F.when(k % 4 == 0, F.concat(F.lit("['"), some("', '"), F.lit("']"))).when(k % 4 == 1, some("; ")).when(k % 4 == 2, some("|")).otherwise("[]")
    return table(spark, sf, "orders").select("o_orderkey", T.list_items(text).alias("items"))


@query("WITH a AS (SELECT unnest(['mit license', 'apache license', 'license', 'he', 'reserved']) AS alias, unnest([1, 2, 3, 9, 3]) AS p, unnest(['MIT', 'APACHE', 'ANY', 'HE', 'ALL']) AS code) SELECT d.doc_id, min_by(code, (p, alias)) AS code FROM documents d JOIN a ON contains(lower(d.text), alias) GROUP BY 1")
def alias_lookup(spark, sf):
    from ..operators.joins import alias_lookup as find

    directory = spark.createDataFrame([("mit license", 1, "MIT"), ("apache license", 2, "APACHE"), ("license", 3, "ANY"), ("he", 9, "HE"), ("reserved", 3, "ALL"), ("", 0, "NONE"), (None, 0, "NONE")], "alias string, p int, code string")
    return find(table(spark, sf, "documents"), "doc_id", F.lower("text"), directory, "alias", "p", "code")


NAMES = """SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT lower(n_name) FROM nation UNION SELECT lower(r_name) FROM region UNION SELECT lower(n_name || ' ' || r_name) FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT DISTINCT lower(r_name || ' ' || p_type) FROM region, part"""


@query(f"WITH n AS ({NAMES}) SELECT a.name, count(*) AS matches, min(b.name) AS first FROM n a JOIN n b ON contains(a.name, b.name) OR contains(b.name, a.name) GROUP BY 1")
def road_name_match(spark, sf):
    from ..operators.joins import name_match

    p, n, r = (table(spark, sf, x) for x in ("part", "nation", "region"))
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    types = p.select(F.lower("p_type").alias("t")).distinct()
    names = p.select(F.col("p_brand").alias("name")).union(types).union(n.select(F.lower("n_name"))).union(r.select(F.lower("r_name"))).union(both.select(F.lower(F.concat_ws(" ", "n_name", "r_name"))))
    names = names.union(r.crossJoin(types).select(F.concat_ws(" ", F.lower("r_name"), "t"))).distinct()  # five regions
    return name_match(names, names.select(F.col("name").alias("other")), "name", "other").groupBy("name").agg(F.count("*").alias("matches"), F.min("other").alias("first"))


# a road for each customer nation: its suppliers' keys in a chain, crossed by streets at some of them
ROAD = """e AS (SELECT 'N' || s_nationkey AS road, s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b, 1 + s_suppkey % 7 AS cost FROM supplier),
 x AS (SELECT s_nationkey, min(s_suppkey) AS lo, max(s_suppkey) AS hi FROM supplier GROUP BY 1)"""


@query(f"""WITH {ROAD}, s AS (SELECT 'N' || s_nationkey AS section, s_nationkey, lo, hi FROM x WHERE lo < hi) SELECT section, (SELECT sum(1 + s_suppkey % 7) FROM supplier p WHERE p.s_nationkey = s.s_nationkey AND s_suppkey < hi)::DOUBLE AS cost, (SELECT list(s_suppkey ORDER BY s_suppkey) FROM supplier p WHERE p.s_nationkey = s.s_nationkey) AS path FROM s""")
def section_path(spark, sf):
    from ..operators.joins import section_path as find

    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey")
    nxt = F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    chain = s.withColumn("b", nxt).where("b is not null").select(F.concat(F.lit("N"), "s_nationkey").alias("road"), F.col("s_suppkey").alias("a"), "b", (1 + F.col("s_suppkey") % 7).cast("double").alias("cost"))
    ends = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("lo"), F.max("s_suppkey").alias("hi")).where("lo < hi")
    name = lambda x: F.concat(F.lit(x), "s_nationkey")
    cross = ends.select(name("A").alias("road"), F.col("lo").alias("a"), (-F.col("lo")).alias("b"), F.lit(1.0)).union(ends.select(name("B"), "hi", -F.col("hi"), F.lit(1.0)))
    return find(chain.union(cross), ends.select(name("N").alias("section"), name("N").alias("road"), name("A").alias("from_street"), name("B").alias("to_street")))
