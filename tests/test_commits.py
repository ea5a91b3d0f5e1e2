"""Attempts, retries, null chunks and batches that share a chunk."""

import time

import pytest
from pyspark.sql import functions as F

from meridex.sources import commits as C
from meridex.sources import sinks as SK
from meridex.streaming import jobs as ST


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k string, v long")


def rows_of(df):
    return sorted((r.k is not None, r.k or "", r.v) for r in df.collect())


def test_chunks_again_with_null_and_odd_keys(spark, tmp_path):
    at = str(tmp_path / "chunks")
    df = keyed(spark, [(None, 1), ("", 2), ("null", 3), ("a/b=c", 4), ("a", 5), ("a", 5)])
    first = SK.write_chunks(df.where("v in (1, 4)"), at, "k").collect()
    assert {(r.k, r.rows) for r in first} == {(None, 1), ("a/b=c", 1)}
    for _ in range(2):
        done = SK.write_chunks(df, at, "k")
        assert {(r.k, r.rows) for r in done.collect()} == {(None, 1), ("", 1), ("null", 1), ("a/b=c", 1), ("a", 2)}
        assert rows_of(SK.read_chunks(spark, at)) == rows_of(df)
    assert done.schema["k"].dataType == df.schema["k"].dataType
    dated = df.select(F.expr("date_add(date'2024-01-01', cast(v as int))").alias("day"), "v")
    assert {str(r.day) for r in SK.write_chunks(dated, str(tmp_path / "days"), "day").collect()} == {f"2024-01-0{d}" for d in range(2, 7)}


def test_batches_with_one_chunk_keep_all_rows(spark, tmp_path):
    """Four rows in two files, one file for each micro-batch; then the last batch is written again."""
    at = str(tmp_path)
    for rows in ([("a", 1), (None, 2)], [("a", 3), (None, 4)]):
        keyed(spark, rows).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    ST.append_chunks(stream, f"{at}/out", "k", f"{at}/c", "s").awaitTermination(120)
    want = [(False, "", 2), (False, "", 4), (True, "a", 1), (True, "a", 3)]
    assert rows_of(SK.read_chunks(spark, f"{at}/out")) == want
    for n in (0, 1):
        C.write_batch_chunks(keyed(spark, [("a", 1), (None, 2)]), f"{at}/out", "k", f"s:{n}")
    assert rows_of(SK.read_chunks(spark, f"{at}/out")) == want and C.commits(spark, f"{at}/out").count() == 4


def test_retried_and_unfinished_batches(spark, tmp_path):
    at, df = str(tmp_path / "b"), keyed(spark, [("a", 1), ("b", 2)])
    with pytest.raises(ValueError, match="no complete batch"):
        SK.read_batch(spark, at)
    for _ in range(2):
        SK.write_batch(df, at, "one", "2024-01-01")
    assert SK.read_batch(spark, at).count() == 2 and [r.rows for r in SK.batches(spark, at).collect()] == [2]
    left = C.write_attempt(df.where("v = 1"), at, None, "two", "2024-01-02")
    assert {r.batch_id for r in SK.read_batch(spark, at).collect()} == {"one"}
    C.commit(left, at)
    assert [tuple(r) for r in SK.read_batch(spark, at).collect()] == [("a", 1, "two")]
    both = [C.write_attempt(df, at, None, "three", "2024-01-03") for _ in range(2)]  # two writers at once
    for rows in both:
        C.commit(rows, at)
    assert SK.read_batch(spark, at, "three").count() == 2 and C.commits(spark, at).count() == 3
    with pytest.raises(ValueError, match="four"):
        SK.read_batch(spark, at, "four")


def test_columns_may_change(spark, tmp_path):
    at = str(tmp_path / "b")
    C.write_batch_chunks(keyed(spark, [("a", 1)]), at, "k", "1")
    C.write_batch_chunks(keyed(spark, [("a", 2)]).withColumn("w", F.lit(0.5)).withColumn("_batch", F.lit("x")), at, "k", "2")
    got = {r.v: (r.w, r._batch, r.b) for r in C.read_committed(spark, at, batch="b").collect()}
    assert got == {1: (None, None, "1"), 2: (0.5, "x", "2")}
    C.write_batch_chunks(keyed(spark, []), at, "k", "3")
    assert C.commits(spark, at).count() == 2


def test_leftovers_go(spark, tmp_path):
    at, df = str(tmp_path / "b"), keyed(spark, [("a", 1)])
    SK.write_batch(df, at, "one", "2024-01-01")
    C.write_attempt(df, at, None, "two")
    assert C.drop_leftovers(spark, at, 0) == 0
    assert C.drop_leftovers(spark, at, int(time.time() * 1000) + 60_000) == 1 and C.drop_leftovers(spark, at, int(time.time() * 1000) + 60_000) == 0
    assert SK.read_batch(spark, at).count() == 1
    make = lambda v, t: spark.createDataFrame([("a", v, v, t, t)], "k string, v string, h string, created_at int, updated_at int")
    table = str(tmp_path / "t")
    for t, v in enumerate("xyz"):
        SK.upsert_table(spark, table, make(v, t), ["k"], "h")
    assert SK.drop_old_versions(spark, table, int(time.time() * 1000) + 60_000) == 2
    assert [r.v for r in SK.current_version(spark, table).collect()] == ["z"]
