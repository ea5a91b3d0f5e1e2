"""Data-quality checks and reconciliations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import prior_counts
from .tables import cut


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys only in one side, only in the other, and in both; one shuffle of flagged keys."""
    both = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("a")).union(actual.select(*keys, F.lit(0), F.lit(1)))
    per = both.groupBy(*keys).agg(F.max("e").alias("e"), F.max("a").alias("a"))
    n = lambda c: F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0))
    return per.agg(n("e = 1 and a = 0").alias("only_expected"), n("e = 0 and a = 1").alias("only_actual"), n("e = 1 and a = 1").alias("both_sides"))


def column_profile(df: DataFrame, columns: list[str], approximate: bool = False, samples: int = 5) -> DataFrame:
    """(column_name, non_null, missing, missing_pct, distinct_values, samples); samples are the smallest values as texts."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    made = [x for c in columns for x in (F.count(c).alias(f"{c}__n"), distinct(c).alias(f"{c}__d"))]
    one = df.agg(F.count("*").alias("__all"), *made)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("non_null"), (F.col("__all") - F.col(f"{c}__n")).alias("missing"), F.round(100 * (F.col("__all") - F.col(f"{c}__n")) / F.col("__all"), 6).alias("missing_pct"), F.col(f"{c}__d").alias("distinct_values")) for c in columns])
    few = [df.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(samples).agg(F.lit(c).alias("column_name"), F.array_sort(F.collect_list("v")).alias("samples")) for c in columns]
    return one.select(F.inline(rows)).join(reduce(DataFrame.unionByName, few), "column_name")


def missing_rates(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column_name, missing_rate) of expressions, in one pass."""
    one = df.agg(*[F.round(F.avg(c.isNull().cast("double")), 6).alias(n) for n, c in columns.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("missing_rate")) for n in columns])))


def duplicate_report(df: DataFrame, identifiers: dict[str, list[str]], samples: int = 3) -> DataFrame:
    """(identifier, duplicated_rows, duplicated_keys, samples): for each identifier, and `full_row` for all columns.

    Rows with a null or blank part of an identifier are ignored; samples are the first repeated keys as texts.
    """

    def one(name: str, keys: list[str], whole: bool = False) -> DataFrame:
        clean = df if whole else df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "") for k in keys]))
        key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("k")
        per = clean.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select("n", key)
        first = per.orderBy("k").limit(samples).agg(F.array_sort(F.collect_list("k")).alias("samples"))
        return per.agg(F.lit(name).alias("identifier"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicated_rows"), F.count("*").alias("duplicated_keys")).crossJoin(first)  # one row each

    return reduce(DataFrame.unionByName, [one(n, k) for n, k in identifiers.items()] + [one("full_row", df.columns, True)])


def frequent_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(column_name, value, n, nth): the k most frequent values of each column, nulls included; ties by value."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])))
    per = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    by = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    return per.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k)


def check_suite(df: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """(check_name, severity, failures, status) of named conditions that a row may break; one pass over the rows.

    severity: 'error' or 'warning'. The last row, 'overall', is READY, READY WITH WARNINGS or NOT READY.
    """
    one = df.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, (_, c) in checks.items()])
    row = lambda n, s: F.struct(F.lit(n).alias("check_name"), F.lit(s).alias("severity"), F.col(n).alias("failures"), F.when(F.col(n) == 0, "pass").otherwise("fail").alias("status"))
    bad = lambda s: reduce(lambda a, b: a + b, [F.col(n) for n, (k, _) in checks.items() if k == s], F.lit(0))
    total = F.struct(F.lit("overall").alias("check_name"), F.lit("summary").alias("severity"), (bad("error") + bad("warning")).alias("failures"), F.when(bad("error") > 0, "NOT READY").when(bad("warning") > 0, "READY WITH WARNINGS").otherwise("READY").alias("status"))
    return one.select(F.inline(F.array(*[row(n, s) for n, (s, _) in checks.items()], total)))


def rank_contract(df: DataFrame, key: list[str], score: str, rank: str) -> DataFrame:
    """One row of booleans: keys unique, scores finite, ranks exactly 1 to n, none repeated."""
    per = df.groupBy(*key).agg(F.count("*").alias("n"), F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.sum(F.col(rank).cast("decimal(38,0)")).alias("s"), F.sum((F.isnan(score) | F.col(score).isNull() | (F.abs(score) == float("inf"))).cast("long")).alias("odd"))
    ranks = df.groupBy(rank).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.sum("n").alias("rows"))
    keys = per.agg((F.max("n") == 1).alias("unique_keys"), (F.sum("odd") == 0).alias("finite_scores"))
    return keys.crossJoin(ranks).select("unique_keys", "finite_scores", ((F.col("most") == 1) & (F.col("lo") == 1) & (F.col("hi") == F.col("rows"))).alias("ranks_exact"), "rows")


#: Parts of an hour counted from 1970: hour of the day, and weekday from Monday.
SEASONS = {"hour": lambda h: F.pmod(h, F.lit(24)), "weekday": lambda h: F.pmod(F.floor(h / 24) + 3, F.lit(7))}


def training_audit(data: DataFrame, counts: DataFrame, horizon: int, window: int, ratio: int, coverage: DataFrame | None = None, joined: dict[str, list[str]] | None = None, forbidden: tuple[str, ...] = (), seasonal: dict[str, list[str]] | None = None) -> DataFrame:
    """(check_name, failures, status) of a training table (entity, hour, target, prior, ...), recounted from hourly events.

    Positive keys are rebuilt from `counts` (entity, hour, n) within the table's hours and entities; `prior` is compared
    with a self-join over the `window` hours before. Joins are on the entity and the day, so no entity meets all of its
    hours at once. `coverage` (lo, hi) are the hours for which features exist; `joined` names columns that each feature
    table brought, none of which may be null; `forbidden` are columns that tell the future. Missing values are looked for
    in all columns, entities must have events. `seasonal` (column -> parts of the hour, of `SEASONS`) are counters of
    earlier events in hours that agree in those parts; all rows are recounted, by running sums in ranges of time, as a
    self-join would meet each row with its whole past. The last row says READY or FAILED. The table is written once.
    """
    data = cut(data)
    spans = data.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    ahead = counts.select("entity", F.explode(F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.col("hour") - k)).alias("hour")).distinct()
    known = data.select("entity").distinct()
    expected = ahead.join(known, "entity", "left_semi").crossJoin(F.broadcast(spans)).where("hour between lo and hi").select("entity", "hour")  # one row
    keys = data.select("entity", "hour", "target").withColumn("rows", F.lit(1)).groupBy("entity", "hour").agg(F.sum("rows").alias("rows"), F.max("target").alias("target"), F.min("target").alias("least"))
    both = keys.join(expected.withColumn("due", F.lit(True)), ["entity", "hour"], "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    due, have = F.coalesce("due", F.lit(False)), F.coalesce(F.col("target") == 1, F.lit(False))
    labels = both.agg(
        n(due & F.col("rows").isNotNull() & ~have).alias("positive_missed"), n(have & ~due).alias("positive_unfounded"), n(F.col("least").isNotNull() & (F.col("least") == 0) & due).alias("negative_not_free"),
        n(F.col("rows") > 1).alias("duplicate_keys"),
    )
    day = lambda c: F.floor(F.col(c) / 24).cast("long")
    asked = data.select("entity", "hour", "prior").withColumn("day", F.explode(F.sequence(F.floor((F.col("hour") - window) / 24).cast("long"), F.floor((F.col("hour") - 1) / 24).cast("long"))))
    seen = asked.join(counts.select("entity", F.col("hour").alias("at"), "n").withColumn("day", day("at")), ["entity", "day"]).where(f"at >= hour - {window} and at < hour")
    again = seen.groupBy("entity", "hour").agg(F.sum("n").alias("again"))
    history = data.join(again, ["entity", "hour"], "left").agg(n(F.col("prior") != F.coalesce("again", F.lit(0))).alias("history_mismatches"))
    missing = lambda some: reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in some], F.lit(False))
    edges = data.crossJoin(F.broadcast(coverage.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi")))) if coverage is not None else data.withColumns({"_lo": F.col("hour"), "_hi": F.col("hour")})  # one row
    rest = edges.agg(
        F.abs(n(F.col("target") == 0) - ratio * n(F.col("target") == 1)).alias("class_balance"), n(missing(data.columns)).alias("missing_values"), n(~F.coalesce(F.col("hour").between(F.col("_lo"), F.col("_hi")), F.lit(False))).alias("outside_coverage"),
        *[n(missing(columns) if columns else F.lit(True)).alias(f"join_{name}") for name, columns in (joined or {}).items()],
    )
    for name, parts in (seasonal or {}).items():
        season = [SEASONS[p](F.col("hour")).alias(f"_{p}") for p in parts]
        asked = data.where("entity is not null and hour is not null").select("entity", "hour", *season).distinct()
        again = prior_counts(asked, counts.select("entity", "hour", "n", *season), {"again": None}, ["entity", *[f"_{p}" for p in parts]]).select("entity", "hour", "again")
        wrong = data.select("entity", "hour", name).join(again, ["entity", "hour"], "left").agg(n(F.col(name) != F.coalesce("again", F.lit(0))).alias(f"{name}_mismatches"))
        rest = rest.crossJoin(wrong)  # one row each
    foreign = data.select("entity").distinct().join(counts.select("entity").distinct(), "entity", "left_anti").agg(F.count("*").alias("foreign_entities"))
    one = labels.crossJoin(history).crossJoin(rest).crossJoin(foreign).withColumn("leakage", F.lit(len(set(forbidden) & set(data.columns))).cast("long"))  # one row each
    checks = F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("failures"), F.when(F.col(c) == 0, "pass").otherwise("fail").alias("status")) for c in one.columns])
    bad = reduce(lambda a, b: a + b, [(F.col(c) > 0).cast("long") for c in one.columns])
    final = F.array(F.struct(F.lit("final_status").alias("check_name"), bad.alias("failures"), F.when(bad == 0, "READY").otherwise("FAILED").alias("status")))
    return one.select(F.inline(F.concat(checks, final)))


def feature_contract(df: DataFrame, keys: list[str], known: DataFrame, rows: int, windows: tuple[str, str, int], counts: list[str], shares: list[str], distances: list[str], columns: list[str]) -> DataFrame:
    """One row of booleans about a feature table; `known` holds the first key, `windows`: start, end and their distance."""
    no = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)) == 0
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    either = lambda some: reduce(lambda a, b: a | b, some, F.lit(False))
    start, end, apart = windows
    flat = df.agg(
        (F.count("*") == rows).alias("row_count"), (F.count_distinct(keys[0]) == F.count("*")).alias("unique_entities"), no(either([F.abs(c) == float("inf") for c in numbers])).alias("no_infinite_numeric"),
        no(either([F.col(c) < 0 for c in counts])).alias("nonnegative_counts"), no(either([~F.col(c).between(0, 1) for c in shares])).alias("shares_in_range"), no(either([F.col(c) < 0 for c in distances])).alias("nonnegative_distances"),
        no(F.col(end) - F.col(start) != apart).alias("window_length"), no(either([F.col(k).isNull() for k in keys])).alias("keys_known"),
    )
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(no(F.col("n") > 1).alias("unique_keys"))
    foreign = df.select(keys[0]).distinct().join(known, keys[0], "left_anti").agg((F.count("*") == 0).alias("all_known"))
    return flat.crossJoin(twice).crossJoin(foreign).withColumn("stable_schema", F.lit(df.columns == columns))  # one row each


def external_audit(calendar: DataFrame, weather: DataFrame, points: DataFrame, hour: str, values: list[str], coordinates: list[str], category: str) -> DataFrame:
    """(source, measure, value) about external tables: rows, range and repeats of hours, missing values, classes, alignment."""

    def measures(df: DataFrame, source: str, made: dict[str, Column]) -> DataFrame:
        one = df.agg(*[c.cast("long").alias(n) for n, c in made.items()])
        return one.select(F.lit(source).alias("source"), F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.coalesce(F.col(n), F.lit(0)).alias("value")) for n in made])))

    nulls = lambda c: F.sum(F.col(c).isNull().cast("long"))
    spans = lambda df, source, more: measures(df, source, {"rows": F.count("*"), "first_hour": F.min(hour), "last_hour": F.max(hour), "duplicate_hours": F.count(hour) - F.count_distinct(hour), **more})
    classes = points.groupBy(F.coalesce(F.col(category).cast("string"), F.lit("null")).alias("c")).agg(F.count("*").alias("value")).select(F.lit("points").alias("source"), F.concat(F.lit("category_"), "c").alias("measure"), "value")
    gap = reconcile(calendar.select(hour).distinct(), weather.select(hour).distinct(), [hour]).select(F.lit("alignment").alias("source"), F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(c).alias("value")) for n, c in (("calendar_only", "only_expected"), ("weather_only", "only_actual"), ("common_hours", "both_sides"))])))
    parts = [spans(calendar, "calendar", {}), spans(weather, "weather", {f"missing_{v}": nulls(v) for v in values}), measures(points, "points", {"rows": F.count("*"), "missing_coordinates": reduce(lambda a, b: a + b, map(nulls, coordinates))}), classes, gap]
    return reduce(DataFrame.unionByName, parts)


def reconstruction_audit(stored: DataFrame, rebuilt: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows of these columns are only in one of the frames, repeats counted."""
    left, right = stored.select(*columns), rebuilt.select(*columns)
    a, b = left.exceptAll(right).agg(F.count("*").alias("only_stored")), right.exceptAll(left).agg(F.count("*").alias("only_rebuilt"))
    return a.crossJoin(b).withColumn("equal", (F.col("only_stored") == 0) & (F.col("only_rebuilt") == 0))  # one row each
