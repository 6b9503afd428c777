"""Element-wise algebra of aligned datasets, in place of chunk-wise generators: columns of one frame, or frames joined on a row id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.numeric import divide


def dataset(spark: SparkSession, source) -> DataFrame | None:
    """A replayable dataset: None stays None, a callable is called, a path is read as Parquet, a frame is itself."""
    if source is None or isinstance(source, DataFrame):
        return source
    return source() if callable(source) else spark.read.parquet(source)


def batch_ranges(spark: SparkSession, size: int, most: int | None) -> DataFrame:
    """(start, stop) of runs of at most ``most`` rows, the remainder last; one run without a bound."""
    step = most or max(size, 1)
    return spark.range(0, size, step).select(F.col("id").alias("start"), F.least(F.col("id") + step, F.lit(size)).alias("stop"))


def zip_join(left: DataFrame, right: DataFrame, on: str, checked: bool = True) -> DataFrame:
    """One-to-one join of aligned datasets on their row id; with ``checked`` a row without partner raises when the plan runs."""
    if not checked:
        return left.join(right, on)
    out = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), on, "full")
    aligned = F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit("the datasets are not aligned")).isNull()
    return out.filter(aligned).drop("_l", "_r")


def ds_apply(df: DataFrame, f: Callable[..., Column], *columns: str, into: str) -> DataFrame:
    """A user function of k aligned columns, as a column expression."""
    if not columns:
        raise ValueError("ds_apply needs a dataset")
    return df.withColumn(into, f(*(F.col(c) for c in columns)))


def ds_add(df: DataFrame, a: str, b: str, into: str) -> DataFrame:
    return ds_apply(df, lambda x, y: x + y, a, b, into=into)


def ds_subtract(df: DataFrame, a: str, b: str, into: str) -> DataFrame:
    return ds_apply(df, lambda x, y: x - y, a, b, into=into)


def ds_multiply(df: DataFrame, a: str, b: str, into: str) -> DataFrame:
    return ds_apply(df, lambda x, y: x * y, a, b, into=into)


def ds_divide(df: DataFrame, a: str, b: str, into: str) -> DataFrame:
    """a / b, and 0 where b is 0."""
    return ds_apply(df, lambda x, y: divide(x, y, 0.0), a, b, into=into)


def ds_vector(df: DataFrame, op: str, a: str, b: str, into: str) -> DataFrame:
    """The same four operations on array columns."""
    f = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: divide(x, y, 0.0)}[op]
    return df.withColumn(into, F.zip_with(a, b, f))
