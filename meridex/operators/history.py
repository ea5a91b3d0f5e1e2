"""Strict-prior counters and forward labels on entities x hours.

Features look at [t - w, t) and never at hour t itself; labels look at (t, t + h]. Events are counted per entity and
hour first, and an entity with more hours than a task should hold is dealt in ranges of time (`segments`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hours import hour_index
from .segments import Frame, with_frames

UNBOUNDED = Window.unboundedPreceding


def event_counts(events: DataFrame, entity: str, ts: str) -> DataFrame:
    """(entity, hour, n): events per entity and hour."""
    return events.groupBy(F.col(entity).alias("entity"), hour_index(ts).alias("hour")).agg(F.count("*").alias("n"))


def city_counts(counts: DataFrame) -> DataFrame:
    """(hour, n): all entities together, from counts per entity."""
    return counts.groupBy("hour").agg(F.sum("n").alias("n"))


def with_events(obs: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Observations (n null) and events in one frame, for range windows over both."""
    return obs.withColumn("n", F.lit(None).cast("long")).withColumn("is_obs", F.lit(True)).unionByName(
        counts.select(*keys, "hour", "n").withColumn("is_obs", F.lit(False)), allowMissingColumns=True
    )


def _prior(windows: dict[str, int | None], last: Column) -> dict[str, Frame]:
    return {**{name: Frame("sum", F.col("n"), None if w is None else -w, -1) for name, w in windows.items()}, "_last": Frame("max", last, None, -1)}


def _counted(df: DataFrame, windows: dict[str, int | None]) -> DataFrame:
    made = {name: F.coalesce(name, F.lit(0)) for name in windows}
    made["hours_since_prev"] = F.coalesce((F.col("hour") - F.col("_last")).cast("double"), F.lit(-1.0))
    made["has_history"] = F.col("_last").isNotNull()
    return df.withColumns(made).drop("_last")


def prior_counts(obs: DataFrame, counts: DataFrame, windows: dict[str, int | None], keys: list[str] | None = None) -> DataFrame:
    """Adds to each observation the events strictly before it: in the last w hours, or all for None.

    Also `hours_since_prev` (-1.0 without a prior event) and `has_history`.
    """
    keys = ["entity"] if keys is None else keys
    both = with_events(obs, counts, keys)
    got = _counted(with_frames(both, "hour", (keys, _prior(windows, F.when(F.col("n") > 0, F.col("hour"))))), windows)
    return got.where("is_obs").select(*obs.columns, *windows, "hours_since_prev", "has_history")


def own_prior_counts(counts: DataFrame, windows: dict[str, int | None], keys: list[str] | None = None) -> DataFrame:
    """As `prior_counts` where the observations are the hours with events: no union."""
    return _counted(with_frames(counts, "hour", (["entity"] if keys is None else keys, _prior(windows, F.col("hour")))), windows)


def seasonal_prior(counts: DataFrame, kinds: dict[str, list[str]], where: dict[str, Column] | None = None) -> DataFrame:
    """Adds for each kind the events strictly before in hours that agree in its columns, or of its condition in `where`."""
    sets = [(["entity", *columns], {name: Frame("sum", F.col("n"), None, -1)}) for name, columns in kinds.items()]
    sets += [(["entity"], {name: Frame("sum", F.when(c, F.col("n")), None, -1)}) for name, c in (where or {}).items()]
    names = [*kinds, *(where or {})]
    return with_frames(counts, "hour", *sets).withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def city_prior(hours: DataFrame, windows: dict[str, int | None]) -> DataFrame:
    """Prior counts of the whole city on its table of hours, which is small whatever the events are."""
    return own_prior_counts(hours, windows, keys=[])


def forward_label(obs: DataFrame, counts: DataFrame, horizon: int) -> DataFrame:
    """Events in (t, t + horizon]: count, first and last hour, and the target 0/1."""
    when = F.when(F.col("n") > 0, F.col("hour"))
    frames = {name: Frame(kind, value, 1, horizon) for name, kind, value in (("future_count", "sum", F.col("n")), ("first_hour", "min", when), ("last_hour", "max", when))}
    out = with_frames(with_events(obs, counts, ["entity"]), "hour", (["entity"], frames)).where("is_obs")
    out = out.withColumn("future_count", F.coalesce("future_count", F.lit(0)))
    return out.select(*obs.columns, *frames, (F.col("future_count") > 0).cast("int").alias("target"))


def asof_strict(left: DataFrame, right: DataFrame, on: str, value: str, order: str) -> DataFrame:
    """Adds the right side's last `value` strictly before each left row; null where there is none.

    One union and one pass by key and time; ties of right rows at one time take the greatest value.
    """
    r = right.groupBy(on, order).agg(F.max(value).alias("_v")).withColumn("_left", F.lit(False))
    l = left.withColumn("_left", F.lit(True))
    both = l.unionByName(r, allowMissingColumns=True)
    got = with_frames(both, order, ([on], {value + "_asof": Frame("last", F.col("_v"), None, -1)}))
    return got.where("_left").drop("_left", "_v")


def asof_bracket(points: DataFrame, wanted: DataFrame, on: list[str], order: str, value: str, category: str, max_gap: int) -> DataFrame:
    """Nearest point at or before and at or after each wanted time, linear in between, category of the nearer (earlier on ties).

    Null where a side is missing or the two are more than `max_gap` apart.
    """
    p = points.groupBy(*on, order).agg(F.max(value).alias("_v"), F.max(category).alias("_c")).withColumn("_t", F.col(order)).withColumn("_w", F.lit(False))
    both = wanted.withColumn("_w", F.lit(True)).unionByName(p, allowMissingColumns=True)
    point = F.when(F.col("_t").isNotNull(), F.struct("_t", "_v", "_c"))
    got = with_frames(both, order, (on, {"b": Frame("last", point, None, 0), "a": Frame("first", point, 0, None)}))
    gap = F.col("a._t") - F.col("b._t")
    share = F.when(gap > 0, (F.col(order) - F.col("b._t")) / gap).otherwise(F.lit(0.0))
    fine = F.col("a").isNotNull() & F.col("b").isNotNull() & (gap <= max_gap)
    got = got.where("_w").withColumn("interpolated", F.when(fine, F.col("b._v") + share * (F.col("a._v") - F.col("b._v"))))
    return got.withColumn("category", F.when(fine, F.when(share <= 0.5, F.col("b._c")).otherwise(F.col("a._c")))).drop("_w", "_t", "_v", "_c", "a", "b")


def lagged_rolling(hours: DataFrame, value: str, sizes: list[int]) -> DataFrame:
    """Sums and means of the n rows before each row of a gapless hour table; null on the first row."""
    by = Window.orderBy("hour")
    made: dict[str, Column] = {}
    for n in sizes:
        frame = by.rowsBetween(-n, -1)
        made[f"{value}_sum_{n}"], made[f"{value}_mean_{n}"] = F.sum(value).over(frame), F.avg(value).over(frame)
    return hours.withColumns(made)


def lag_diff(hours: DataFrame, value: str, steps: list[int]) -> DataFrame:
    by = Window.orderBy("hour")
    return hours.withColumns({f"{value}_diff_{k}": F.col(value) - F.lag(value, k).over(by) for k in steps})


def hours_since_condition(hours: DataFrame, condition: Column, name: str, default: float = 9999.0) -> DataFrame:
    """Hours since the condition last held, the present hour included."""
    last = F.last(F.when(condition, F.col("hour")), ignorenulls=True).over(Window.orderBy("hour").rowsBetween(UNBOUNDED, 0))
    return hours.withColumn(name, F.coalesce((F.col("hour") - last).cast("double"), F.lit(default)))


def hour_spine(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """All hours between two columns of a one-row frame."""
    return bounds.select(F.explode(F.sequence(F.col(first), F.col(last))).alias("hour"))


def run_lengths(counts: DataFrame) -> DataFrame:
    """(entity, start, length) of runs of consecutive hours."""
    by = Window.partitionBy("entity").orderBy("hour")
    return counts.withColumn("island", F.col("hour") - F.row_number().over(by)).groupBy("entity", "island").agg(F.min("hour").alias("start"), F.count("*").alias("length")).drop("island")
