"""Writers: two formats, GeoJSON, resumable chunks, batches, snapshots, and tables kept by content hash."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import frame_checksum, risk_level, upsert, upsert_scoped
from . import commits as C
from .commits import exists


def write_dual(df: DataFrame, path: str) -> None:
    """Parquet and CSV side by side."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def geojson_features(df: DataFrame, geometry: DataFrame, key: str, properties: list[str], level: str | None = None, probability: str | None = None, ranges: list[tuple[float, str]] | None = None) -> DataFrame:
    """(value): one GeoJSON Feature for each row; a row without geometry (key, line) is an error.

    With `level`, so is a row whose level isn't the one that `ranges` (lower bound, level) give its probability.
    """
    if level is not None:
        wrong = df.where(~F.col(level).eqNullSafe(risk_level(F.col(probability), ranges))).select(key, probability, level).limit(5).collect()
        if wrong:
            raise ValueError(f"levels that don't match their probability: {[tuple(r) for r in wrong]}")
    lost = df.join(geometry, key, "left_anti").select(key).limit(5).collect()
    if lost:
        raise ValueError(f"no geometry for {[r[0] for r in lost]}")
    line = F.transform("line", lambda p: F.array(p["x"], p["y"]))
    shape = F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col(key).cast("string").alias("id"), shape.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.join(geometry.select(key, "line"), key).select(F.to_json(feature).alias("value"))


def write_chunks(df: DataFrame, path: str, by: str) -> DataFrame:
    """Writes only the chunks, by the values of `by`, that aren't committed yet; returns a manifest of all: rows, checksum.

    A null value is a chunk of its own. What a failed run left doesn't count, and a chunk that two runs wrote counts once.
    """
    C.write_batch_chunks(df, path, by, "chunks")
    done = C.commits(df.sparkSession, path)
    value = F.when(F.col("chunk") != "null", F.expr("substring(chunk, 2)")).cast(df.schema[by].dataType)
    return done.select(value.alias(by), "rows", "checksum")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed chunks."""
    return C.read_committed(spark, path)


def append_snapshot(df: DataFrame, path: str, at: str) -> None:
    df.withColumn("collected_at", F.lit(at).cast("timestamp")).write.mode("append").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: str, completed_at: str) -> None:
    """A scored batch; it counts once it is complete, and once only, however often it is written."""
    C.write_batch_chunks(df, path, None, batch_id, completed_at)


def batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, completed_at, rows, checksum) of all complete batches."""
    return C.commits(spark, path).select("batch_id", "completed_at", "rows", "checksum")


def read_batch(spark: SparkSession, path: str, batch_id: str | None = None) -> DataFrame:
    """Rows of a batch, or of the latest complete one (of several at one time the greatest id), with `batch_id`."""
    done = C.commits(spark, path)
    if batch_id is None:
        batch_id = done.agg(F.max_by("batch_id", F.struct("completed_at", "batch_id"))).first()[0]
    which = done.where(F.col("batch_id") == batch_id)
    if which.isEmpty():
        raise ValueError(f"no complete batch {batch_id}")
    return C.read_committed(spark, path, which, "batch_id")


def top_of_batch(batch: DataFrame, score: str, key: str, n: int) -> DataFrame:
    return batch.orderBy(F.desc(score), key).limit(max(1, min(n, 500)))


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Writes unless the same rows, in any order, are there; returns whether it wrote."""
    spark, columns = df.sparkSession, sorted(df.columns)
    same = lambda d: frame_checksum(d.select(F.to_json(F.struct(*columns)).alias("row")), ["row"]).first()[1:]
    if exists(spark, path) and sorted(spark.read.parquet(path).columns) == columns and same(spark.read.parquet(path)) == same(df):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


#: Parts of an upserted table; a batch rewrites those that it touches.
BUCKETS = 64


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], hash_column: str, scope: list[str] | None = None) -> dict[str, int]:
    """Applies an upsert to a table of versions and returns how many rows were new, updated, unchanged, deleted.

    Rows lie in buckets by the hash of their scope, or else of their keys. The buckets that the batch touches are written
    anew beside the old ones, and one row for each names its current version, so readers and failed writers never meet a
    half-written table. `kept` counts rows of touched buckets only.
    """
    bucket = F.pmod(F.xxhash64(*(scope or keys)), F.lit(BUCKETS)).cast("int")
    touched = {r[0] for r in incoming.select(bucket).distinct().collect()}  # at most BUCKETS numbers
    current = _read_buckets(spark, path, touched)
    if current is None:
        current = incoming.limit(0)
    done = upsert_scoped(current, incoming, keys, scope, hash_column) if scope else upsert(current, incoming, keys, hash_column)
    at, number = f"{path}/v-{uuid.uuid4().hex}", max((n for _, _, n in _latest(spark, path)), default=0) + 1
    done.withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(at)
    counts = {r.status: r["count"] for r in spark.read.parquet(at).groupBy("status").count().collect()} if touched else {}
    rows = [(b, f"{at}/_bucket={b}", number) for b in sorted(touched)]
    spark.createDataFrame(rows, "bucket int, at string, n long").coalesce(1).write.mode("append").parquet(f"{path}/pointer")
    return counts


def _latest(spark: SparkSession, path: str) -> list[tuple]:
    """(bucket, folder, number) of the current version of each bucket, at most BUCKETS of them."""
    if not exists(spark, f"{path}/pointer"):
        return []
    return [tuple(r) for r in spark.read.parquet(f"{path}/pointer").groupBy("bucket").agg(F.max_by("at", "n"), F.max("n")).collect()]


def _read_buckets(spark: SparkSession, path: str, wanted: set[int] | None = None) -> DataFrame | None:
    folders = [at for b, at, _ in _latest(spark, path) if wanted is None or b in wanted]
    return spark.read.parquet(*folders).where("status <> 'deleted'").drop("status") if folders else None


def drop_old_versions(spark: SparkSession, path: str, before_ms: int) -> int:
    """Deletes folders of an upserted table that hold no current version of a bucket and are older than a time."""
    if not exists(spark, path):
        return 0
    live = {at.rsplit("/", 2)[-2] for _, at, _ in _latest(spark, path)}
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, gone = root.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in live and status.getModificationTime() < before_ms:
            gone += bool(files.delete(status.getPath(), True))
    return gone


def current_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of an upserted table, or None before the first write."""
    return _read_buckets(spark, path)
