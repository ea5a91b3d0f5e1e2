"""A commit protocol for files: attempts are written aside and made visible by rows of a manifest.

    path/attempts/_attempt=<id>/_chunk=<chunk>/part-*.parquet   written by any number of attempts, also by failed ones
    path/manifest/part-*.parquet                               one row for each batch and chunk of a finished attempt

An attempt's files count once its rows are in the manifest, which Spark adds as one file in one step. For each (batch,
chunk) the first attempt in the manifest counts, so a batch that is written again adds nothing, and readers never meet
what a failed or a running attempt left. Two batches with one chunk keep the rows of both.

Chunks are values of a column, as text; null is a chunk of its own, told from an empty text. The manifest has a row for
each batch and chunk, which readers join with the folders; Spark then lists and reads folders that count only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ATTEMPT, CHUNK = "_attempt", "_chunk"
WHOLE = "whole"
MANIFEST = "batch_id string, chunk string, attempt string, number long, rows long, checksum decimal(38,0), columns string, completed_at string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def chunk_name(by: str | None) -> F.Column:
    """The chunk of a row: 'v' and the value as text, or 'null'."""
    if by is None:
        return F.lit(WHOLE)
    return F.coalesce(F.concat(F.lit("v"), F.col(by).cast("string")), F.lit("null"))


def all_commits(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the manifest, repeated attempts included."""
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: for each batch and chunk the attempt that counts, the first one."""
    names = [f.name for f in all_commits(spark, path).schema.fields if f.name not in ("batch_id", "chunk")]
    first = F.min_by(F.struct(*names), F.struct("number", "attempt")).alias("x")
    return all_commits(spark, path).groupBy("batch_id", "chunk").agg(first).select("batch_id", "chunk", "x.*")


def write_attempt(df: DataFrame, path: str, by: str | None, batch_id: str, completed_at: str = "") -> DataFrame:
    """Writes the rows of a batch aside; returns the rows that make them visible once `commit` adds them."""
    if {ATTEMPT, CHUNK} & set(df.columns):
        raise ValueError(f"{ATTEMPT} and {CHUNK} are names of folders")
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    df.withColumn(CHUNK, chunk_name(by)).write.partitionBy(CHUNK).parquet(f"{path}/attempts/_attempt={attempt}")
    number = (all_commits(spark, path).agg(F.max("number")).first()[0] or 0) + 1
    found = spark.read.schema(StructType([*df.schema.fields, StructField(CHUNK, StringType())])).parquet(f"{path}/attempts/_attempt={attempt}")
    per = found.groupBy(CHUNK).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*(sorted(df.columns))).cast("decimal(38,0)")).alias("checksum"))
    return per.select(
        F.lit(batch_id).alias("batch_id"), F.col(CHUNK).alias("chunk"), F.lit(attempt).alias("attempt"), F.lit(number).cast("long").alias("number"), "rows", "checksum",
        F.lit(df.schema.json()).alias("columns"), F.lit(completed_at).alias("completed_at"),
    )


def commit(rows: DataFrame, path: str) -> None:
    """Adds rows of `write_attempt` to the manifest, as one file."""
    rows.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def write_batch_chunks(df: DataFrame, path: str, by: str | None, batch_id: str, completed_at: str = "") -> None:
    """Writes and commits a batch, unless all its chunks are there; a batch without rows leaves nothing."""
    spark = df.sparkSession
    done = commits(spark, path).where(F.col("batch_id") == batch_id).select(F.col("chunk").alias(CHUNK))
    left = df.withColumn(CHUNK, chunk_name(by)).join(done, CHUNK, "left_anti").select(*df.columns)
    commit(write_attempt(left, path, by, batch_id, completed_at), path)


def read_committed(spark: SparkSession, path: str, which: DataFrame | None = None, batch: str | None = None) -> DataFrame:
    """Rows of all commits, or of those in `which`; with the id of each row's batch in a column named `batch`, if any.

    Columns are those of the latest commit; rows that were written without one of them have null there.
    """
    chosen = commits(spark, path) if which is None else which
    last = chosen.agg(F.max_by("columns", F.struct("number", "attempt"))).first()[0]
    if last is None:
        raise ValueError(f"nothing is committed in {path}")
    columns = StructType.fromJson(json.loads(last))
    schema = StructType([*columns.fields, StructField(ATTEMPT, StringType()), StructField(CHUNK, StringType())])
    files = spark.read.schema(schema).parquet(f"{path}/attempts")
    named = chosen.select(F.col("attempt").alias(ATTEMPT), F.col("chunk").alias(CHUNK), "batch_id")
    got = files.select(F.struct(*columns.names).alias("row"), ATTEMPT, CHUNK).join(named, [ATTEMPT, CHUNK])
    return got.select("row.*", *([F.col("batch_id").alias(batch)] if batch else []))


def drop_leftovers(spark: SparkSession, path: str, before_ms: int) -> int:
    """Deletes attempts that don't count and were last changed before a time in epoch milliseconds; returns how many.

    The time is to leave running attempts alone. One name for each attempt comes to the driver.
    """
    if not exists(spark, f"{path}/attempts"):
        return 0
    counted = {r[0] for r in commits(spark, path).select("attempt").distinct().collect()}
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/attempts")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for status in files.listStatus(root):
        name = status.getPath().getName().removeprefix("_attempt=")
        if name not in counted and status.getModificationTime() < before_ms:
            gone += bool(files.delete(status.getPath(), True))
    return gone
