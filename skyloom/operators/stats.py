"""Weighted covariance, principal components and linear regression; data give sums of products, small matrices are solved on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numeric import all_finite, finite


def covariance(df: DataFrame, dims: list[str], weight: str | None = None, ddof: int = 1) -> DataFrame:
    """(j, k, cov) for all pairs: sum w (xj - mj)(xk - mk) / (sum w - ddof) over rows with finite values and a finite weight above 0.

    Means first, then moments about them: two passes of one aggregate row each, as stable as running updates.
    """
    if ddof < 0:
        raise ValueError("ddof must not be negative")
    cols = [F.col(d).cast("double") for d in dims]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.filter(all_finite(cols) & finite(w) & (w > 0)).select(w.alias("w"), *(c.alias(f"x{k}") for k, c in enumerate(cols)))
    means = rows.agg(F.array(*(F.sum(F.col("w") * F.col(f"x{k}")) / F.sum("w") for k in range(len(dims)))).alias("m"))
    d = rows.withColumn("m", means.scalar()).select("w", *((F.col(f"x{k}") - F.col("m")[k]).alias(f"d{k}") for k in range(len(dims))))
    pairs = [(j, k) for j in range(len(dims)) for k in range(j, len(dims))]
    total = F.sum("w") - ddof
    row = d.agg(*(F.when(total > 0, F.sum(F.col("w") * F.col(f"d{j}") * F.col(f"d{k}")) / F.when(total > 0, total)).alias(f"c{j}_{k}") for j, k in pairs))
    parts = [F.struct(F.lit(a).alias("j"), F.lit(b).alias("k"), F.col(f"c{j}_{k}").alias("cov")) for j, k in pairs for a, b in {(j, k), (k, j)}]
    return row.select(F.inline(F.array(*parts)))


def covariance_of_vectors(df: DataFrame, vector: str, dim: int, weight: str | None = None, ddof: int = 1) -> np.ndarray:
    """The same for an array column of many dimensions: each task returns its sums, of means first and then of products about them."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.col(vector).cast("array<double>").alias("v"), w.alias("w")).filter(finite(F.col("w")) & (F.col("w") > 0) & F.col("v").isNotNull())

    def summed(mean: np.ndarray | None, size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                weight_ = batch.column(1).to_numpy()
                ok = np.isfinite(v).all(1)
                v, weight_ = v[ok], weight_[ok]
                out += np.concatenate([[weight_.sum()], weight_ @ v]) if mean is None else (((v - mean) * weight_[:, None]).T @ (v - mean)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(out)], names=["k", "s"])

        got = np.zeros(size)
        for r in rows.mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():  # dim or dim * dim numbers
            got[r.k] = r.s
        return got

    first = summed(None, dim + 1)
    if first[0] - ddof <= 0:
        raise ValueError("the sum of weights must exceed ddof")
    return summed(first[1:] / first[0], dim * dim).reshape(dim, dim) / (first[0] - ddof)


def as_matrix(cov: DataFrame) -> np.ndarray:
    """dim x dim numbers on the driver; raises if the weights don't suffice."""
    rows = cov.collect()
    out = np.full((1 + max(r.j for r in rows),) * 2, np.nan)
    for r in rows:
        if r["cov"] is None:
            raise ValueError("the sum of weights must exceed ddof")
        out[r.j, r.k] = r["cov"]
    return out


def diagonalize(matrix: np.ndarray, sort: bool = True, positive: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns), largest first; signs are arbitrary, or such that a vector's largest entry is positive."""
    if matrix.ndim != 2 or matrix.shape[0] != matrix.shape[1]:
        raise ValueError("the matrix is not square")
    values, vectors = np.linalg.eigh(matrix)
    if positive:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(vectors))])
    return (values[::-1], vectors[:, ::-1]) if sort else (values, vectors)


def project(df: DataFrame, dims: list[str], vectors: np.ndarray, into: str = "p") -> DataFrame:
    """Columns into0, into1, ...: the dataset times the matrix."""
    cols = [F.col(d).cast("double") for d in dims]
    out = {f"{into}{j}": sum((c * float(vectors[k, j]) for k, c in enumerate(cols)), F.lit(0.0)) for j in range(vectors.shape[1])}
    return df.withColumns(out)


@dataclass
class LinearRegression:
    """y = x . weights + intercept by normal equations, or by full-batch gradient descent on the same moments (so epochs read no data)."""

    dims: list[str]
    alpha: float = 0.01
    tolerance: float | None = None
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    intercept: float = 0.0
    error: float = float("nan")

    def moments(self, df: DataFrame, target: str) -> np.ndarray:
        """Sums of products of (1, x, y) over rows where all of them are finite: one aggregate of (d + 2)(d + 3) / 2 numbers."""
        v = [F.lit(1.0), *(F.col(d).cast("double") for d in self.dims), F.col(target).cast("double")]
        n = len(v)
        row = df.filter(all_finite(v[1:])).agg(*(F.sum(v[i] * v[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n))).first()
        if row["s0_0"] is None:
            raise ValueError("the dataset is empty")
        return np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])

    def train(self, df: DataFrame, target: str, n_epochs: int | None = None, analytic: bool = True, compute_error: bool = True) -> LinearRegression:
        s = self.moments(df, target)
        a, b, n = s[:-1, :-1], s[:-1, -1], s[0, 0]
        if analytic:
            solved = np.linalg.inv(a) @ b
        else:
            solved = np.zeros(len(b)) if not len(self.weights) else np.concatenate([[self.intercept], self.weights])
            for _ in range(n_epochs or 1000):
                step = (self.alpha or 0.01) * (b - a @ solved) / n
                solved = solved + step
                if self.tolerance is not None and np.linalg.norm(step[1:]) < self.tolerance and abs(step[0]) < self.tolerance:
                    break
        self.intercept, self.weights = float(solved[0]), solved[1:]
        if compute_error:
            self.error = self.rmse(df, target).first()[0]
        return self

    def predict(self) -> Column:
        return sum((F.col(d).cast("double") * float(w) for d, w in zip(self.dims, self.weights, strict=True)), F.lit(float(self.intercept)))

    def rmse(self, df: DataFrame, target: str, chunk: str | None = None, cv: int = 0, folds: list[int] | None = None) -> DataFrame:
        """One row ``rmse``, over rows without null or NaN; with ``chunk`` the rows whose chunk number modulo ``cv`` is in ``folds`` stay out. Infinite without rows."""
        rows = df if chunk is None else df.filter(~F.pmod(F.col(chunk), F.lit(cv)).isin(folds))
        rows = rows.filter(all_finite([F.col(c).cast("double") for c in (*self.dims, target)]))
        return rows.agg(F.coalesce(F.sqrt(F.avg(F.pow(F.col(target) - self.predict(), 2))), F.lit(float("inf"))).alias("rmse"))


def linear_fit(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, slope, intercept) of least-squares lines."""
    return points.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def correction_weight(s: Column, slope: Column, intercept: Column) -> Column:
    """1 / (slope s + intercept): NULL where that is 0."""
    d = slope * s + intercept
    return F.when(d != 0, F.lit(1.0) / F.when(d != 0, d))


def delta_chi2(points: DataFrame, lines: DataFrame, variances: DataFrame, by: str, bin_: str, x: str, y: str) -> DataFrame:
    """(by, chi2_ini, chi2_new, delta_chi2) for the hypotheses y = 1 and y = line; variances: (by, bin, var) over mocks, 0 counts for nothing."""
    rows = points.join(F.broadcast(lines), by).join(variances, [by, bin_])
    inv = F.when(F.col("var") > 0, F.lit(1.0) / F.when(F.col("var") > 0, F.col("var"))).otherwise(0.0)
    a, b = F.sum(F.pow(F.col(y) - 1, 2) * inv), F.sum(F.pow(F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept")), 2) * inv)
    return rows.groupBy(by).agg(a.alias("chi2_ini"), b.alias("chi2_new"), (a - b).alias("delta_chi2"))


def chi2_of_one(points: DataFrame, variances: DataFrame, by: str, bin_: str, y: str) -> DataFrame:
    """(by, chi2_ini) for the hypothesis y = 1, which a correction by interpolation reaches at every bin."""
    rows = points.join(variances, [by, bin_])
    inv = F.when(F.col("var") > 0, F.lit(1.0) / F.when(F.col("var") > 0, F.col("var"))).otherwise(0.0)
    return rows.groupBy(by).agg(F.sum(F.pow(F.col(y) - 1, 2) * inv).alias("chi2_ini"))


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through (xs, ys), its end pieces extended; a chain of comparisons for the few points of a bin table."""
    if len(xs) < 2:
        raise ValueError("interpolation needs two points")
    out = None
    for a, b, c, d in zip(xs[:-1], xs[1:], ys[:-1], ys[1:], strict=True):
        piece = F.lit(float(c)) + (x - float(a)) * ((d - c) / (b - a))
        out = piece if out is None else F.when(x < float(a), out).otherwise(piece)
    return out
