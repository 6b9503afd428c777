"""User kernels over Arrow batches, for functions that no built-in expresses: NumPy arrays in, one array out."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_apply(df: DataFrame, f: Callable[..., np.ndarray], inputs: list[str], into: str, kind: str = "double") -> DataFrame:
    """``df`` and a column ``into`` of type ``kind``: f of the input columns, batch by batch; null numbers arrive as NaN."""
    if not inputs:
        raise ValueError("a kernel needs a column")
    out = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema) + f", `{into}` {kind}"
    at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = f(*(batch.column(i).to_numpy(zero_copy_only=False) for i in at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=[*batch.schema.names, into])

    return df.mapInArrow(run, out)


def kernel(kind: str = "double"):
    """Decorator: a NumPy function as a vectorised column function."""

    def wrap(f: Callable[..., np.ndarray]):
        def series(*columns: pd.Series) -> pd.Series:
            return pd.Series(f(*(c.to_numpy() for c in columns)))

        # pandas_udf reads the arity from the signature
        series.__signature__ = __import__("inspect").signature(f)
        series.__annotations__ = {**dict.fromkeys(__import__("inspect").signature(f).parameters, pd.Series), "return": pd.Series}
        return F.pandas_udf(series, kind)

    return wrap


def parallelism(spark: SparkSession, tasks: int | None = None) -> int:
    """Tasks of a shuffle; sets them if given."""
    if tasks is not None:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cores() -> int:
    return os.cpu_count() or 1


def array_to_string(a: np.ndarray) -> str:
    return np.array2string(np.asarray(a), separator=", ", threshold=10**9).replace("\n", "")
