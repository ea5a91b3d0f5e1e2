"""Range-framed aggregates by key and order that no single key can make slow, and exact quantiles by selection.

A window over (key, order) puts all rows of a key in one task. Here keys that hold more than a task's share of rows are
dealt in ranges of (key, order) instead. A frame that is open to one side is the frame within the row's own range and a
carry: what the ranges before (or after) hold of that key, one row for each range that a key runs over. A frame of a
bounded width is computed in a range that also has a halo, the key's rows of other ranges that lie within the width.
Other keys go by plain windows. Both ways give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

#: A key with more rows than this, and than a quarter of an even share of a task, is dealt in ranges: so few keys are.
HOT_ROWS = 200_000
_MERGED = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass
class Frame:
    """An aggregate of `value` over rows of the key whose order lies in [order + low, order + high]; None is open.

    kind: sum, min, max, or last and first (of values that aren't null; values of equal order must be equal).
    """

    kind: str
    value: Column
    low: int | None
    high: int | None

    def over(self, keys: list[str], order: str) -> Column:
        edge = lambda x, open_: open_ if x is None else x
        by = Window.partitionBy(*keys).orderBy(order).rangeBetween(edge(self.low, Window.unboundedPreceding), edge(self.high, Window.unboundedFollowing))
        return self.aggregate().over(by)

    def aggregate(self) -> Column:
        if self.kind in ("first", "last"):
            return {"first": F.first, "last": F.last}[self.kind](self.value, ignorenulls=True)
        return _MERGED[self.kind](self.value)

    @property
    def is_open(self) -> bool:
        return (self.low is None) != (self.high is None)

    def check(self) -> None:
        if self.low is None and self.high is None:
            raise ValueError("a frame of a whole key is a grouping")
        if (self.low is None and self.high > 0) or (self.high is None and self.low < 0):
            raise ValueError("an open frame must end at its row or before its other side")


def _same(keys: list[str], left: str, right: str) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys that hold too many rows for one task, at most four for each shuffle partition; None without any."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    found = per.agg(F.max("_rows").alias("most"), F.sum("_rows").alias("total")).first()
    least = max(HOT_ROWS, (found.total or 0) // (4 * n))
    return per.where(F.col("_rows") > least).select(*keys) if (found.most or 0) > least else None


def with_frames(df: DataFrame, order: str, *sets: tuple[list[str], dict[str, Frame]]) -> DataFrame:
    """Adds columns of frames to all rows: for each set its keys and its frames by name. The order is a number."""
    for _, frames in sets:
        for f in frames.values():
            f.check()
    data = cut(df.withColumn("_all", F.lit(0)))
    sets = [(keys or ["_all"], frames) for keys, frames in sets]
    coarse = [k for k in sets[0][0] if all(k in keys for keys, _ in sets)] or ["_all"]
    if hot_keys(data, coarse) is None:
        return data.withColumns({name: f.over(keys, order) for keys, frames in sets for name, f in frames.items()}).drop("_all")
    for keys, frames in sets:
        hot = hot_keys(data, keys)
        if hot is None:
            data = data.withColumns({name: f.over(keys, order) for name, f in frames.items()})
            continue
        hot = F.broadcast(hot.alias("h"))  # at most four rows for each shuffle partition
        some = data.alias("d").join(hot, _same(keys, "d", "h"), "left_semi")
        rest = data.alias("d").join(hot, _same(keys, "d", "h"), "left_anti")
        data = cut(rest.withColumns({name: f.over(keys, order) for name, f in frames.items()}).unionByName(by_ranges(some, keys, order, frames)))
    return data.drop("_all")


def by_ranges(df: DataFrame, keys: list[str], order: str, frames: dict[str, Frame]) -> DataFrame:
    """The same by ranges of (keys, order), whatever the keys hold."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, *keys, order).withColumn("_p", F.spark_partition_id()).withColumn("_mine", F.lit(True)))
    carried = {name: f for name, f in frames.items() if f.is_open}
    near = {name: f for name, f in frames.items() if not f.is_open}
    ends = parts.groupBy(*keys, "_p").agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), *[_of_range(f, order).alias(f"_c_{name}") for name, f in carried.items()])
    # keys that run over several ranges: the first and the last key of a range at most, so two rows for each range
    several = ends.withColumn("_ranges", F.count("*").over(Window.partitionBy(*keys))).where("_ranges > 1")
    out = _with_halo(parts, several, keys, order, near) if near else parts
    mine = Window.partitionBy(*keys, "_p").orderBy(order)
    inside = {name: Frame(f.kind, F.when(F.col("_mine"), f.value), f.low, f.high) if f.is_open else f for name, f in frames.items()}
    out = out.withColumns({f"_w_{name}": f.aggregate().over(mine.rangeBetween(Window.unboundedPreceding if f.low is None else f.low, Window.unboundedFollowing if f.high is None else f.high)) for name, f in inside.items()}).where("_mine")
    if carried:
        by = Window.partitionBy(*keys).orderBy("_p")
        before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
        sums = several.select(*keys, "_p", *[_merge(f, F.col(f"_c_{name}")).over(before if f.low is None else after).alias(f"_b_{name}") for name, f in carried.items()])
        out = out.alias("d").join(F.broadcast(sums.alias("s")), [*_same(keys, "d", "s"), F.col("d._p") == F.col("s._p")], "left").select("d.*", *[f"s._b_{name}" for name in carried])
    both = {name: _both(f, F.col(f"_w_{name}"), F.col(f"_b_{name}")) if f.is_open else F.col(f"_w_{name}") for name, f in frames.items()}
    return out.withColumns(both).select(*df.columns, *frames)


def _of_range(f: Frame, order: str) -> Column:
    if f.kind in ("first", "last"):
        pick = F.min_by if f.kind == "first" else F.max_by
        return pick(f.value, F.when(f.value.isNotNull(), F.col(order)))
    return _MERGED[f.kind](f.value)


def _merge(f: Frame, column: Column) -> Column:
    return Frame(f.kind, column, None, 0).aggregate()


def _both(f: Frame, own: Column, carry: Column) -> Column:
    if f.kind == "sum":
        return F.coalesce(own + carry, own, carry)
    if f.kind in ("min", "max"):
        return (F.least if f.kind == "min" else F.greatest)(own, carry)
    # the nearest value of an open frame is in the row's own range, the farthest in the carry
    near_first = (f.kind == "last") == (f.low is None)
    return F.coalesce(own, carry) if near_first else F.coalesce(carry, own)


def _with_halo(parts: DataFrame, several: DataFrame, keys: list[str], order: str, frames: dict[str, Frame]) -> DataFrame:
    low, high = min(0, *(f.low for f in frames.values())), max(0, *(f.high for f in frames.values()))
    ranges = several.select(*keys, F.col("_p").alias("_q"), "_lo", "_hi")
    near = (F.col("d._p") != F.col("r._q")) & (F.col(f"d.{order}") >= F.col("r._lo") + low) & (F.col(f"d.{order}") <= F.col("r._hi") + high)
    halo = parts.alias("d").join(F.broadcast(ranges.alias("r")), [*_same(keys, "d", "r"), near]).select("d.*", "r._q")
    return parts.unionByName(halo.withColumn("_p", F.col("_q")).withColumn("_mine", F.lit(False)).drop("_q"))


def quantiles(df: DataFrame, values: list[str], shares: list[float], groups: list[str] | None = None, suffix: str = "") -> DataFrame:
    """(groups, one array for each of `values`): exact quantiles, linear between neighbours, of values that aren't null.

    Selection instead of buffers: rows are counted per distinct value, running counts go by ranges of (group, column,
    value), and only the two neighbours of each wanted place remain. NaN counts as the largest value. Null groups are a
    group; a group without values has null; without groups there is always one row.
    """
    from .records import prefix_sums

    groups = groups or []
    pairs = F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_v")) for c in values])
    long = df.select(*groups, F.explode(pairs).alias("_x")).select(*groups, "_x._name", "_x._v")
    counted = long.groupBy(*groups, "_name", "_v").agg(F.count("*").alias("_n"))
    known = counted.where("_v is not null")
    placed = prefix_sums(known, [*groups, "_name"], [F.col("_v")], {"_to": F.col("_n")})
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares)])
    each = placed.withColumn("_q", F.explode(wanted))
    place = (F.col("all__to") - 1) * F.col("_q.s")
    at, above = F.floor(place), F.ceil(place)
    first = F.col("_to") - F.col("_n")
    hit = lambda k: (first <= k) & (k < F.col("_to"))
    each = each.where(hit(at) | hit(above))
    low, high = F.min("_v"), F.max("_v")
    one = each.groupBy(*groups, "_name", "_q.i").agg(low.alias("lo"), high.alias("hi"), F.first(place - at).alias("part"))
    one = one.withColumn("x", F.when(F.col("part") == 0, F.col("lo")).otherwise(F.col("lo") + F.col("part") * (F.col("hi") - F.col("lo"))))
    sorted_ = F.array_sort(F.collect_list(F.struct("i", "x")))  # as many as there are shares
    per = one.groupBy(*groups, "_name").agg(F.transform(sorted_, lambda e: e["x"]).alias("x"))
    wide = per.groupBy(*groups).agg(*[F.max(F.when(F.col("_name") == c, F.col("x"))).alias(c + suffix) for c in values])
    if not groups:
        return wide
    every = counted.select(*groups).distinct()
    same = [F.col(f"e.{g}").eqNullSafe(F.col(f"w.{g}")) for g in groups]
    return every.alias("e").join(wide.alias("w"), same, "left").select(*[f"e.{g}" for g in groups], *[f"w.{c}{suffix}" for c in values])
