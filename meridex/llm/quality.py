"""Quality classifier from positive and unlabelled texts (operator 2).

A linear model over byte, byte-pair, word and line statistics of the whole text. It minimises the non-negative
unbiased risk: with class prior p, positive risk p * E_P[l(z)] plus max(0, E_U[l(-z)] - p * E_P[l(-z)]), where P are
trusted positives and U is unlabelled text that holds both classes. The prior is the share of positives among the
labelled training rows.

The fit uses bounded samples, `max_positive` and `max_unlabelled` rows, those with the smallest hash of their key;
everything else covers all rows. Texts are reduced to `WIDTH` numbers on the executors before the driver sees them.

Defined results: null and empty texts get the model's score for a text without words; without trusted positives
every score is 0.5; repeated rows are scored alike; the columns of the input are kept and those added replace
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .textops import chunks, distinct_per_text, text_buffers, words

PAIRS = 256
WIDTH = 256 + PAIRS + 6
MAX_POSITIVE = 4000
MAX_UNLABELLED = 8000


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One float32 row of WIDTH statistics for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, WIDTH), np.float32)
    text = np.repeat(np.arange(n), size)
    per = 1 / np.maximum(size, 1)[:, None]
    out[:, :256] = np.bincount(text * 256 + data, minlength=n * 256).reshape(n, 256) * per
    if len(data) > 1:
        same = text[1:] == text[:-1]
        pair = (data[:-1].astype(np.int64) * 167 + data[1:].astype(np.int64) * 59) % PAIRS
        out[:, 256 : 256 + PAIRS] = np.bincount((text[1:] * PAIRS + pair)[same], minlength=n * PAIRS).reshape(n, PAIRS) * per
    out[:, : 256 + PAIRS] = np.sqrt(out[:, : 256 + PAIRS])
    start, end, hashes, before = words(data, offsets)
    number = np.diff(before)
    _, distinct = distinct_per_text(hashes, before)
    lengths = np.concatenate([[0], np.cumsum(end - start)])
    breaks = np.bincount(text[data == 10], minlength=n) if len(data) else np.zeros(n)
    upper = np.bincount(text[(data >= 65) & (data <= 90)], minlength=n) if len(data) else np.zeros(n)
    some = np.maximum(number, 1)
    out[:, -6:] = np.stack(
        [np.log1p(size), np.log1p(number), np.diff(distinct) / some, (lengths[before[1:]] - lengths[before[:-1]]) / some / 10, breaks / some, upper / np.maximum(size, 1)], 1
    )
    return out


@dataclass(frozen=True)
class Model:
    """score = sigmoid(x @ weight + bias); prior: the class prior of the fit."""

    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = (x.astype(np.float64) * self.weight).sum(1) + self.bias  # row by row, so equal rows have equal sums
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimises the non-negative risk with the logistic loss by full-batch Adam steps."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH), 0.0, prior)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = ((np.hstack([(x - mean) / scale, np.ones((len(x), 1), np.float32)])).clip(-8, 8).astype(np.float32) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1], np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (p, u))
        # d/dz log(1 + e^-z) = s - 1 and d/dz log(1 + e^z) = s
        as_positive = prior * p.T @ (sp - 1) / len(p)
        as_negative = u.T @ su / len(u) - prior * p.T @ sp / len(p)
        risk = -np.log1p(-np.minimum(su, 1 - 1e-6)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-6)).mean()
        g = as_positive + as_negative if risk >= 0 else -as_negative
        g += decay * np.append(w[:-1], 0).astype(np.float32)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate / (1 + t / 100) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weight = w[:-1].astype(np.float64) / scale
    return Model(weight, float(w[-1] - mean @ weight), prior)


def sampled_features(df: DataFrame, text: str) -> np.ndarray:
    """Collects the statistics of a bounded sample; never the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                x = features(*text_buffers(batch.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    rows = df.select(F.col(text).alias("text")).mapInArrow(run, "x binary").collect()
    return np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, WIDTH)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fits on trusted positives (label 1) and unlabelled rows of `docs`. Both frames hold training rows only."""
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null and y is not null")
    n, ones = known.agg(F.count("*"), F.sum(F.expr("cast(y = 1 as int)"))).first()
    prior = min(max(((ones or 0) + 1) / (n + 2), 0.05), 0.98)
    by = F.xxhash64("k")
    keys = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    chosen = [
        known.where("y = 1").select("k").distinct().orderBy(by, "k").limit(max_positive),
        keys.select("k").where("k is not null").distinct().orderBy(by, "k").limit(max_unlabelled),
    ]
    # both key lists are bounded by the parameters above
    positive, unlabelled = (sampled_features(keys.join(F.broadcast(c), "k", "left_semi"), "t") for c in chosen)
    return fit_nnpu(positive, unlabelled, prior)


def score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """Adds the model's score of each whole text to all columns of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                got = model.score(features(*text_buffers(batch.column(text))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, column])

    if column in df.columns:
        df = df.drop(column)
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(column, DoubleType())]))


def held_out(key: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def train(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> Model:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(docs.where(~held_out()), labels.where(~held_out()))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; labels of held-out documents are never learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs.select("doc_id", "text"), train(spark, sf_dir, docs))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score is at least 0.5 stay."""
    return score(docs, train(spark, sf_dir), column="__quality").where("__quality >= 0.5").drop("__quality")


__all__ = ["Model", "fit", "fit_nnpu", "features", "held_out", "keep_good", "op2_quality", "score", "train"]
