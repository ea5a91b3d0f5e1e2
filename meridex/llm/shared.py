"""Helpers of several operators: tables in the shared folder, checked broadcasts, connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of this many rows of a few numbers may be broadcast (about 16 MB); a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one beside the warehouse where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame in the shared folder and reads it back: its lineage ends and a lost executor loses nothing."""
    at = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def large(df: DataFrame) -> DataFrame:
    """`df`, to be joined by a shuffle whatever Spark takes its size to be.

    Spark goes by the bytes of Parquet files, which hold repeated values once, and doesn't see how rows grow by `explode`
    or how long collected arrays are: a table that it takes for 10 MB may be a gigabyte in the driver.
    """
    return df.hint("merge")


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df`, to be broadcast if it has no more than `rows` rows (and `BROADCAST_ROWS`), and else never."""
    most = min(BROADCAST_ROWS if rows is None else rows, BROADCAST_ROWS)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else large(df)


def salted(left: DataFrame, right: DataFrame, on: str | list[str], salt: str, salts: int = 8, rows: int = 250_000) -> DataFrame:
    """`left` joined with `right` on columns of which one value may be very frequent in `left`.

    `right` is broadcast if it is small, and else sent `salts` times by a shuffle, so a frequent value is dealt over as
    many tasks.
    """
    most = min(rows, BROADCAST_ROWS)
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), on)
    many = right.withColumn("salt_number", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [on] if isinstance(on, str) else on
    return left.withColumn("salt_number", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int")).join(large(many), [*on, "salt_number"]).drop("salt_number")


def key_ranges(docs: DataFrame, total: int, block_bytes: int) -> np.ndarray:
    """Cuts of the integer column `key` into ranges of about `block_bytes` of the `total` bytes of the column `text`.

    One number for each block of text; block k holds keys above cut k - 1 and up to cut k, null keys are in the first.
    Keys count once for each 8 kB of their text, so long texts make short ranges; a single text stays whole.
    """
    number = max(1, -(-total // block_bytes))
    if number == 1:
        return np.zeros(0, np.float64)
    weighed = docs.select(F.explode(F.array_repeat("key", F.greatest(F.ceil(F.octet_length("text") / 8192), F.lit(1)).cast("int"))).alias("key"))
    cuts = weighed.approxQuantile("key", [k / number for k in range(1, number)], 0.1 / number)
    return np.array(sorted(set(cuts)), np.float64)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) reaches.

    Alternates large-star and small-star steps. Minima are aggregated before they are joined back, so a hub is never
    gathered in one task. The number of steps grows with the logarithm of the longest chain.
    """

    def star(e: DataFrame, large: bool, near) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(near(least), "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        return out.where("a <> b")

    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        mark = now
        near = F.broadcast if 2 * now[0] <= BROADCAST_ROWS else large  # no more minima than ends of edges
        e = stored(star(star(e, True, near), False, near).distinct(), "edges")
