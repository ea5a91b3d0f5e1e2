"""Row-level cleaning, deduplication, global order, top factors and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def first_failure(checks: dict[str, Column], ok: str = "kept") -> Column:
    """The name of the first condition that holds, in order; a null condition doesn't hold."""
    out = None
    for name, bad in checks.items():
        out = F.when(F.coalesce(bad, F.lit(False)), name) if out is None else out.when(F.coalesce(bad, F.lit(False)), name)
    return out.otherwise(ok)


def bin_label(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins: labels[i] holds (edges[i-1], edges[i]], the last label what is above."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for e, name in zip(edges, labels, strict=False):
        out = out.when(value <= e, name)
    return out.otherwise(labels[-1])


def risk_level(value: Column, ranges: list[tuple[float, str]]) -> Column:
    """Left-closed adjacent ranges from 0 to 1: (lower bound, level), ascending; null outside."""
    if [lo for lo, _ in ranges] != sorted({lo for lo, _ in ranges}) or ranges[0][0] != 0:
        raise ValueError("ranges must start at 0 and ascend")
    out = F.when((value < 0) | (value > 1) | value.isNull(), F.lit(None).cast("string"))
    for lo, name in reversed(ranges):
        out = out.when(value >= lo, name)
    return out


def lookup_ordered(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of the ids in the order asked for, with `position`; an unknown id is an error."""
    asked = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], f"position int, {key} {df.schema[key].dataType.simpleString()}")
    unknown = asked.join(df, key, "left_anti").select(key).limit(5).collect()
    if unknown:
        raise KeyError([r[0] for r in unknown])
    return df.join(F.broadcast(asked), key).orderBy("position")  # the request's ids


#: So many rows are ordered in one task, more in ranges.
TASK_ROWS = 200_000


def prefix_sums(df: DataFrame, groups: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums in a total order of each group's rows, the row's own value included, and totals `all_<name>`.

    No task holds more than `TASK_ROWS` rows of a group or its even share: a larger table is dealt in ranges of (groups,
    order), and what stands before a range is the sum of a few numbers for each earlier range of the group. The ranges
    are written once, so all steps see the same ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = cut(df)
    if whole.limit(TASK_ROWS + 1).count() <= TASK_ROWS:
        by = Window.partitionBy(*groups)
        upto = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return whole.withColumns({k: F.sum(c).over(upto) for k, c in sums.items()} | {f"all_{k}": F.sum(c).over(by) for k, c in sums.items()})
    parts = cut(whole.repartitionByRange(n, *groups, *order).withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy(*groups, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    per = parts.groupBy(*groups, "_p").agg(*[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()])  # a row for each range of a group
    before = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    made = {f"_b_{k}": F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)) for k in sums} | {f"all_{k}": F.sum(f"_s_{k}").over(whole) for k in sums}
    offsets = per.withColumns(made).drop(*[f"_s_{k}" for k in sums])
    named = offsets.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_p").alias("_q"), *[c for c in offsets.columns if c not in (*groups, "_p")])
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups] + [F.col("_p") == F.col("_q")]
    out = parts.withColumns({f"_r_{k}": F.sum(c).over(own) for k, c in sums.items()}).join(named, same)
    return out.withColumns({k: F.col(f"_r_{k}") + F.col(f"_b_{k}") for k in sums}).drop("_p", "_q", *[f"_g_{g}" for g in groups], *[f"_{x}_{k}" for k in sums for x in "rb"])


def global_rank(df: DataFrame, order: list[Column], name: str, groups: list[str] | None = None) -> DataFrame:
    """Ranks 1..n in a total order, within groups if given, without one task for all rows of a group."""
    return prefix_sums(df, groups or [], order, {name: F.lit(1).cast("long")}).drop(f"all_{name}")


def even_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows evenly spaced in the order, first and last included."""
    total = df.count()
    want = sorted({k * (total - 1) // max(n - 1, 1) for k in range(n)}) if total else []
    return global_rank(df, [F.col(c) for c in order], "_rank").where((F.col("_rank") - 1).isin(want)).drop("_rank")


def top_factors(names: list[str], k: int) -> dict[str, Column]:
    """Arrays of the k largest positive and most negative contributions of a row, as (name, value)."""
    pairs = F.array(*[F.struct(F.col(n).alias("value"), F.lit(n).alias("name")) for n in names])
    # ascending by value: the end holds the largest
    ordered = F.array_sort(F.filter(pairs, lambda x: x["value"].isNotNull()))
    up = F.slice(F.reverse(F.filter(ordered, lambda x: x["value"] > 0)), 1, k)
    down = F.slice(F.filter(ordered, lambda x: x["value"] < 0), 1, k)
    return {"raising": F.transform(up, lambda x: x["name"]), "lowering": F.transform(down, lambda x: x["name"])}


def content_hash(columns: list[str]) -> Column:
    """sha-256 of the columns in the order given; nulls are told from empty texts."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns]), 256)


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], hash_column: str, created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """Target after the upsert with `status`: new, updated, unchanged or kept.

    An unchanged row stays the old one; an updated row keeps its `created`. Rows that repeat a key within the batch
    count once: the one with the greatest hash.
    """
    new = dedupe_first(incoming, keys, [F.desc(hash_column)])
    t, n = target.alias("t"), new.alias("n")
    joined = t.join(n, [F.col(f"t.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    old, got = F.col(f"t.{hash_column}"), F.col(f"n.{hash_column}")
    status = F.when(old.isNull(), "new").when(got.isNull(), "kept").when(old == got, "unchanged").otherwise("updated")
    take_new = got.isNotNull() & (old.isNull() | (old != got))
    pick = lambda c: F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    columns = [F.when(old.isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"n.{c}")).alias(c) if c == created else pick(c) for c in target.columns]
    return joined.select(*columns, status.alias("status"))


def upsert_scoped(target: DataFrame, incoming: DataFrame, keys: list[str], scope: list[str], hash_column: str) -> DataFrame:
    """As `upsert`, but rows of an incoming scope that the batch no longer has get the status 'deleted'."""
    out = upsert(target, incoming, keys, hash_column)
    live = incoming.select(*scope).distinct().withColumn("_live", F.lit(True))
    gone = (F.col("status") == "kept") & F.coalesce("_live", F.lit(False))
    return out.join(live, scope, "left").withColumn("status", F.when(gone, "deleted").otherwise(F.col("status"))).drop("_live")


def frame_checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, checksum): order-free sums of hashes of each column's values."""
    value = lambda c: F.conv(F.substring(F.md5(F.coalesce(F.col(c).cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("decimal(38,0)")
    one = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(value(c)), F.lit(0)).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n"), F.col(c).cast("long").alias("checksum")) for c in columns])))


def project_contract(df: DataFrame, keep: list[str], key: list[str], required: list[str]) -> DataFrame:
    """Only the columns of `keep`; raises ValueError if one is missing, a key repeats or a required value is null."""
    missing = [c for c in keep if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = df.select(*keep)
    found = out.agg(*[F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in required]).first() if required else ()
    empty = [c for c, n in zip(required, found, strict=True) if n]
    if empty:
        raise ValueError(f"missing values in {empty}")
    if not out.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeat")
    return out


def prefix_columns(df: DataFrame, prefix: str, but: list[str]) -> DataFrame:
    """All columns but those named get the prefix."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in but})


def with_city_row(df: DataFrame, row: DataFrame, zero: list[str]) -> DataFrame:
    """Every row with the columns of a one-row frame; no row leaves them null, and those of `zero` 0."""
    one = row.limit(1).withColumn("_on", F.lit(1))
    out = df.withColumn("_on", F.lit(1)).join(F.broadcast(one), "_on", "left").drop("_on")  # one row
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType)) for c in zero})


def mask_imputed(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Null in a column where its flag (column -> flag) says that the value was filled in."""
    return df.withColumns({c: F.when(~F.coalesce(F.col(f).cast("boolean"), F.lit(False)), F.col(c)) for c, f in flags.items()})


def history_hash(df: DataFrame, identity: list[str], run_times: list[str]) -> DataFrame:
    """Adds identity_key, a text of the identity's columns, and content_hash of all columns but the run's times, by name."""
    content = sorted(c for c in df.columns if c not in run_times)
    return df.withColumns({"identity_key": F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]), "content_hash": content_hash(content)})


def public_view(df: DataFrame, keep: list[str], nested: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Only what may be shown: the columns of `keep` and, for each struct of `nested`, its fields (name -> column).

    Columns that the table doesn't have are null; numbers that aren't finite are null, also inside arrays and structs.
    """
    def safe(c: Column, kind) -> Column:
        name = kind.typeName()
        if name in ("double", "float"):
            return F.when(F.abs(c) < float("inf"), c)
        if name == "array":
            return F.transform(c, lambda x: safe(x, kind.elementType))
        if name == "struct":
            return F.when(c.isNotNull(), F.struct(*[safe(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if name == "map":
            return F.transform_values(c, lambda _, v: safe(v, kind.valueType))
        return c

    shown = lambda c: safe(F.col(f"`{c}`"), df.schema[c].dataType) if c in df.columns else F.lit(None).cast("string")
    return df.select(*[shown(c).alias(c) for c in keep], *[F.struct(*[shown(c).alias(n) for n, c in fields.items()]).alias(name) for name, fields in (nested or {}).items()])
