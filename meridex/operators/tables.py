"""Where intermediate tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; on one machine, where that is unset, one beside the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that all executors see."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a checkpoint in the shared folder; sets one only where none is set, as in tests."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df`, to be broadcast if it has no more than so many rows of a few values, and else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of one side of a join that meet the others of their key in one group.
GROUP_ROWS = 2000


def dealt(left: DataFrame, right: DataFrame, on: list[str], rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides of an inner join with a column `_salt`: at most about `rows` rows of `left` have one key and salt."""
    blocks = left.groupBy(*on).agg(F.ceil(F.count("*") / rows).alias("_blocks"))
    some = left.join(blocks, on).withColumn("_salt", F.pmod(F.xxhash64(*left.columns), "_blocks")).drop("_blocks")
    return some, right.join(blocks, on).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")


def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join whose groups hold at most about `GROUP_ROWS` rows of `left`; hot keys of `right` are repeated for each."""
    some, spread = dealt(left, right, on)
    return some.join(spread.hint("merge"), [*on, "_salt"]).drop("_salt")
