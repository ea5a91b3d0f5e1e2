"""Label construction, deterministic negative sampling, splits and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import global_rank
from .tables import cut, small


def hash_number(*parts: Column, digits: int = 8) -> Column:
    """A number from the md5 of the parts as text: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, digits), 16, 10).cast("long")


def positives_next(counts: DataFrame, ahead: int = 1) -> DataFrame:
    """(entity, hour): the hour `ahead` of each hour with events."""
    return counts.select("entity", (F.col("hour") - ahead).alias("hour")).distinct()


def positives_window(counts: DataFrame, horizon: int) -> DataFrame:
    """(entity, hour): all hours of the covered range whose next `horizon` hours hold an event; one scan."""
    span = counts.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    shifted = counts.select("entity", F.explode(F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.col("hour") - k)).alias("hour")).distinct()
    return shifted.crossJoin(F.broadcast(span)).where("hour between lo and hi").select("entity", "hour")  # one row


def sample_negatives(positives: DataFrame, members: DataFrame, ratio: int, seed: int = 42, fallback: bool = True) -> DataFrame:
    """(hour, entity): for each positive exactly `ratio` entities of its stratum at its hour, never a positive, never twice.

    `members`: (entity, stratum), each entity once. A stratum's members stand in a fixed order by hash, as a ring. At each
    hour the draw begins at a place given by the hash of (seed, hour, stratum) and goes round: among the next
    `ratio` * p + p members at most p are positives, p being the hour's positives, so what is needed is among them and
    nothing is drawn again. Where a stratum has too few members, `fallback` takes the rest from the ring of all
    members in the same way. Raises ValueError if the ratio can't be met. Positives of no member count to the fallback.
    """
    spot = hash_number(F.lit(seed), F.col("entity"))
    known = positives.select("entity", "hour").distinct().join(members, "entity", "left")

    def draw(asked: DataFrame, ring: DataFrame, taken: DataFrame) -> DataFrame:
        """(hour, stratum, entity) of `need` free members for each row (hour, stratum, need, busy) of `asked`."""
        placed = global_rank(ring, [spot, F.col("entity")], "place", ["stratum"]).withColumn("place", F.col("place") - 1)
        sizes = ring.groupBy("stratum").agg(F.count("*").alias("size"))
        tries = asked.join(sizes, "stratum").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("size"), F.col("need") + F.col("busy")) - 1)))
        at = F.pmod(hash_number(F.lit(seed), F.col("hour"), F.col("stratum")) + F.col("k"), F.col("size"))
        found = tries.withColumn("place", at).join(placed, ["stratum", "place"]).join(taken, ["entity", "hour"], "left_anti")
        nth = F.row_number().over(Window.partitionBy("hour", "stratum").orderBy("k"))  # what an hour needs
        return found.withColumn("nth", nth).where("nth <= need").select("hour", "stratum", "entity")

    asked = known.where("stratum is not null").groupBy("hour", "stratum").agg((F.count("*") * ratio).alias("need"), F.count("*").alias("busy"))
    first = cut(draw(asked, members, known.select("entity", "hour")))
    wanted = known.groupBy("hour").agg((F.count("*") * ratio).alias("wanted"), F.count("*").alias("p"))
    got = first.groupBy("hour").agg(F.count("*").alias("got"))
    short = cut(wanted.join(got, "hour", "left").withColumn("need", F.col("wanted") - F.coalesce("got", F.lit(0))).where("need > 0"))
    out = first.select("hour", "entity")
    if short.isEmpty():
        return out
    if fallback:
        busy = short.select("hour", F.lit("all").alias("stratum"), "need", (F.col("p") + F.coalesce("got", F.lit(0))).alias("busy"))
        more = cut(draw(busy, members.select("entity", F.lit("all").alias("stratum")), known.select("entity", "hour").union(first.select("entity", "hour"))))
        short = short.join(more.groupBy("hour").agg(F.count("*").alias("more")), "hour", "left").where("need > coalesce(more, 0)")
        out = out.union(more.select("hour", "entity"))
    lacking = short.select("hour").limit(1).collect()
    if lacking:
        raise ValueError(f"there aren't {ratio} free members for each positive at hour {lacking[0][0]}")
    return out


def chronological_split(df: DataFrame, hour: str, train: int = 70, validation: int = 85, purge: int = 0) -> DataFrame:
    """Adds `split` by cuts at these percentages of the distinct hours; `purge` hours at the end of train and validation get 'purged'."""
    hours = df.select(F.col(hour).alias("_h")).distinct()
    at = hours.withColumn("_i", F.row_number().over(Window.orderBy("_h")) - 1)  # distinct hours: small
    n = hours.count()
    cuts = at.agg(F.max(F.when(F.col("_i") == n * train // 100, F.col("_h"))).alias("_a"), F.max(F.when(F.col("_i") == n * validation // 100, F.col("_h"))).alias("_b"))
    h = F.col(hour)
    rule = F.when(h < F.col("_a") - purge, "train").when(h < F.col("_a"), "purged").when(h < F.col("_b") - purge, "validation").when(h < F.col("_b"), "purged").otherwise("test")
    return df.crossJoin(F.broadcast(cuts)).withColumn("split", rule).drop("_a", "_b")  # one row


def fixed_split(df: DataFrame, column: str, first: int, second: int) -> DataFrame:
    return df.withColumn("split", F.when(F.col(column) < first, "train").when(F.col(column) < second, "validation").otherwise("test"))


def stratified_sample(df: DataFrame, label: str, keys: list[str], n: int) -> DataFrame:
    """Exactly round(n * share) rows of each class, those with the smallest hash of their keys."""
    share = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = df.count()
    quota = share.withColumn("_q", F.round(F.col("_n") * n / F.lit(max(total, 1))).cast("long"))
    ranked = global_rank(df, [hash_number(*[F.col(k) for k in keys]), *map(F.col, keys)], "_r", [label])
    return ranked.join(small(quota), label).where("_r <= _q").drop("_r", "_q", "_n")


def first_active_window(days: DataFrame, months: list[int], horizon: int) -> DataFrame:
    """The first day of the given months whose next `horizon` days hold an event; `days`: (day, month, n), gapless."""
    ahead = F.sum("n").over(Window.orderBy("day").rangeBetween(1, horizon))
    return days.withColumn("ahead", ahead).where(F.col("month").isin(months) & (F.col("ahead") > 0)).groupBy("month").agg(F.min("day").alias("day"))
