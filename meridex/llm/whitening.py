"""Embedding whitening (operator 13): principal components from pivoted Cholesky and one-sided Jacobi.

Entries are x = floor(256 * c), whole numbers; the fit list is every distinct x-vector once.

1. Tasks sum vectors around a whole-numbered centre near the mean, and the products of what is left (the scatter). Both
   are sums of whole numbers: floats only multiply blocks that can't exceed 2^53, larger ones go by Python's integers. So
   the scatter around the mean itself, n * sum(y y') - sum(y) sum(y)', is exact and rounded once, whatever the
   partitions. Tasks hand on one row for each two dimensions; the driver holds one dims x dims matrix.
2. Pivoted Cholesky A = L L' takes the largest remaining diagonal first and stops at rounding error: its columns are the
   rank. One-sided Jacobi then rotates pairs of columns of L until all are orthogonal: their squared norms are the
   eigenvalues of A, the normalised columns its eigenvectors. A is never formed again, so small eigenvalues keep their digits.
3. Rows are projected on the first components. One more pass over the fit list measures their covariance against the
   identity.

Defined results: rows whose vector is null or holds null, NaN or an infinity are dropped. Vectors have the length that
most remaining rows have (of two lengths as frequent the longer); rows of other lengths are dropped. x beyond the range
of a long is its nearest end. Components of an eigenvalue within rounding error of 0 (rank) are left out, so fewer than
asked for, or none, may come back. A deviation beyond the range of a long is null. Repeated rows get repeated results,
null ids stay; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shared import stored

SCALE = 256
COMPONENTS = 4
#: Rows whose products are summed at once in a task.
BLOCK_ROWS = 4096
#: Exact sums go from task to task in so many lanes of so many bits, enough for any table of longs.
LANES, LANE_BITS = 5, 40
_LONG = 1 << 63


@dataclass
class Whitening:
    """What tasks need: `centre` and exact sums around it, components as columns, eigenvalues of the covariance."""

    n: int
    centre: list[int]
    rest: list[int]  # sums of x - centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of x."""
        mean = np.array([r / self.n for r in self.rest])
        return (around(x, self.centre).astype(np.float64) - mean) @ self.components / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)^2, S being sums of x."""
        y = around(x, self.centre)
        bound = self.n * _largest(y) + max((abs(r) for r in self.rest), default=0)
        kind = np.int64 if bound * bound * max(x.shape[1], 1) < _LONG else object
        d = self.n * y.astype(kind) - np.array(self.rest, kind)
        return [int(v) if v < _LONG else None for v in (d * d).sum(1).tolist()]


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def around(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x - centre, as longs where these can't overflow and else as Python's integers."""
    if _largest(x) + max(map(abs, centre), default=0) < _LONG:
        return x - np.array(centre, np.int64)
    return x.astype(object) - np.array(centre, object)


def whole_numbers(df: DataFrame, vector: str, out: str) -> DataFrame:
    """Rows with finite vectors, and the column `out`: floor(SCALE * entry) as longs."""
    entry = lambda e: e.cast("double")
    infinity = F.lit(float("inf"))
    fine = F.forall(vector, lambda e: F.coalesce(~F.isnan(entry(e)) & (F.abs(entry(e)) < infinity), F.lit(False)))
    top = F.lit(float(_LONG))

    def whole(e: Column) -> Column:
        v = F.lit(float(SCALE)) * entry(e)
        least, most = F.lit(-_LONG).cast("long"), F.lit(_LONG - 1).cast("long")
        return F.when(v >= top, most).when(v <= -top, least).otherwise(F.floor(F.when(F.abs(v) < top, v)).cast("long"))

    return df.where(F.coalesce(fine, F.lit(False))).withColumn(out, F.transform(vector, whole))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1 if len(column) else 0)


def scatter(fit: DataFrame, x: str, centre: list[int]) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, sums of products) of x - centre over all rows, exact; the products as an array of Python's integers."""
    d = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            rows = _matrix(batch.column(x))
            for at in range(0, len(rows), BLOCK_ROWS):
                y = around(rows[at : at + BLOCK_ROWS], centre)
                n += len(y)
                if _largest(y) ** 2 * len(y) < 1 << 53:
                    part = y.astype(np.float64)
                    total, products = total + y.sum(0), products + (part.T @ part).astype(np.int64)
                else:
                    y = y.astype(object)
                    total, products = total + y.sum(0), products + y.T.dot(y)
        if n:
            i, j = np.triu_indices(d)
            i, j = np.concatenate([[-1], np.full(d, -1), i]), np.concatenate([[-1], np.arange(d), j])
            value = [int(v) for v in (n, *total, *products[np.triu_indices(d)])]
            lanes = [pa.array([(-1 if v < 0 else 1) * (abs(v) >> (LANE_BITS * k) & ((1 << LANE_BITS) - 1)) for v in value]) for k in range(LANES)]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *lanes], names=["i", "j", *names])

    # a sum may have more digits than a decimal holds, so numbers are added in lanes of bits
    names = [f"v{k}" for k in range(LANES)]
    parts = fit.select(x).mapInArrow(run, "i int, j int, " + ", ".join(f"{v} long" for v in names))
    summed = parts.groupBy("i", "j").agg(*(F.sum(v).alias(v) for v in names))
    n, total, products = 0, [0] * d, np.zeros((d, d), object)
    for r in summed.collect():
        value = sum(v << (LANE_BITS * k) for k, v in enumerate(r[2:]))
        if r.i >= 0:
            products[r.i, r.j] = products[r.j, r.i] = value
        elif r.j >= 0:
            total[r.j] = value
        else:
            n = value
    return n, total, products


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (rows in the order of `a`, as many columns as its rank) with L L' = a, a being symmetric and semidefinite.

    What is left of a diagonal entry is 0 if it is no more than rounding errors of that entry.
    """
    d = len(a)
    left, rest, order = np.zeros((d, d)), np.diag(a).copy(), np.arange(d)
    least = 4 * d * np.finfo(float).eps * rest
    for k in range(d):
        rest[rest <= least] = 0
        p = k + int(np.argmax(rest[order[k:]]))
        order[[k, p]] = order[[p, k]]
        at = order[k]
        if rest[at] == 0:
            return left[:, :k]
        left[at, k] = np.sqrt(rest[at])
        below = order[k + 1 :]
        left[below, k] = (a[below, at] - left[below, :k] @ left[at, :k]) / left[at, k]
        rest[below] -= left[below, k] ** 2
    return left


def one_sided_jacobi(left: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of L L', falling, and its unit eigenvectors as columns, by rotating pairs of columns of L.

    Each round of a sweep rotates disjoint pairs at once (a round-robin); a sweep without rotations ends it.
    """
    u = left.copy()
    r = u.shape[1]
    seats = np.arange(r + r % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            i, j = np.minimum(seats[:half], seats[half:][::-1]), np.maximum(seats[:half], seats[half:][::-1])
            i, j = i[j < r], j[j < r]
            a, b, c = (u[:, i] ** 2).sum(0), (u[:, j] ** 2).sum(0), (u[:, i] * u[:, j]).sum(0)
            go = np.abs(c) > 4 * np.finfo(float).eps * np.sqrt(a * b)
            if go.any():
                turned = True
                i, j, a, b, c = i[go], j[go], a[go], b[go], c[go]
                zeta = (b - a) / (2 * c)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                cos = 1 / np.sqrt(1 + t * t)
                ui, uj = u[:, i], u[:, j]
                u[:, i], u[:, j] = cos * ui - cos * t * uj, cos * t * ui + cos * uj
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    values = (u * u).sum(0)
    order = np.argsort(-values, kind="stable")
    return values[order], u[:, order] / np.sqrt(values[order])


def fit_whitening(fit: DataFrame, x: str, components: int = COMPONENTS) -> Whitening | None:
    """Components of the rows of `fit` (arrays of longs of one length), or None without rows."""
    first = fit.select(F.size(x).alias("d")).first()
    if first is None or first.d == 0:
        return None
    means = fit.select(F.posexplode(x).alias("k", "v")).groupBy("k").agg(F.avg(F.col("v").cast("double")).alias("mean")).collect()
    centre = [0] * first.d
    for r in means:
        centre[r.k] = min(max(round(r.mean), -_LONG), _LONG - 1)
    n, rest, products = scatter(fit, x, centre)
    exact = n * products - np.outer(np.array(rest, object), np.array(rest, object))  # n^2 times the covariance
    covariance = np.array([[v / n**2 for v in row] for row in exact.tolist()], np.float64)
    values, vectors = one_sided_jacobi(pivoted_cholesky(covariance))
    count = min(components, len(values))
    return Whitening(n, centre, rest, vectors[:, :count], values[:count], float(np.trace(covariance)))


def identity_error(fit: DataFrame, x: str, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list, less the identity."""
    k = model.components.shape[1]
    sent = fit.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products, n = np.zeros(k), np.zeros((k, k)), 0
        for batch in (b for b in batches if b.num_rows):
            w = sent.value.project(_matrix(batch.column(x)))
            n, total, products = n + len(w), total + w.sum(0), products + w.T @ w
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([products.ravel().tolist()])], names=["total", "products"])

    # the whitened mean is 0 but for rounding, so products around 0 are centred ones, and the sums mend the rest
    parts = fit.select(x).mapInArrow(run, "total array<double>, products array<double>")
    sums = parts.agg(F.array(*(F.sum(F.col("total")[i]) for i in range(k))).alias("total"), F.array(*(F.sum(F.col("products")[i]) for i in range(k * k))).alias("products")).first()
    mean = np.array(sums.total) / model.n
    return float(np.abs(np.array(sums.products).reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, vector: str = "embedding", column: str = "whitened", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float | None]:
    """Remaining rows of `df` with all columns, and `column`: a struct of the exact deviation and the whitened values.

    Also the fitted components (None without any) and how far the whitened fit list is from an identity covariance.
    """
    df = df.drop(column)
    whole = "whole"
    while whole in df.columns:
        whole += "_"
    known = whole_numbers(df, vector, whole)
    lengths = known.groupBy(F.size(whole).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = StructType([*df.schema.fields, StructField(column, df.sparkSession.createDataFrame([], "c struct<deviation: bigint, values: array<double>>").schema["c"].dataType)])
    if lengths is None or lengths.d == 0:
        return df.sparkSession.createDataFrame([], schema), None, None
    known = known.where(F.size(whole) == lengths.d)
    fit = stored(known.select(whole).distinct(), "fit")
    model = fit_whitening(fit, whole, components)
    if not len(model.eigenvalues):
        return df.sparkSession.createDataFrame([], schema), None, None
    error = identity_error(fit, whole, model)
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("deviation", pa.int64()), ("values", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(whole))
            kept = [n for n in batch.schema.names if n != whole]
            rows = pa.StructArray.from_arrays([pa.array(sent.value.deviation(x), pa.int64()), pa.array(list(sent.value.project(x)), pa.list_(pa.float64()))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), rows], names=[*kept, column])

    return known.mapInArrow(run, schema), model, error


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first whitened coordinates of every vector."""
    found, model, error = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    n = model.n if model else None
    explained = [float(e / model.trace) for e in model.eigenvalues] if model else []
    rows = found.select("vec_id", "whitened.deviation", F.posexplode("whitened.values").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
