"""Datasets and models in Parquet: one row a neuron, a one-row header that also keeps the type and the components; whole pipelines with their sky."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.som import Som
from skyloom.plans.cleaning import SkyCleaner

_HEADER = "m int, n int, dim int, topology string, dtype string, mode string, alpha double, sigma double, quantization_errors array<double>, topographic_errors array<double>, cov_matrix array<array<double>>, eigenvalues array<double>, eigenvectors array<array<double>>"


def save_som(spark: SparkSession, som: Som, path: str) -> None:
    som.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/neurons")
    row = (som.m, som.n, som.dim, som.topology, np.dtype(som.dtype).name, som.mode, float(som.alpha), float(som.sigma), [float(x) for x in som.quantization_errors], [float(x) for x in som.topographic_errors])
    row += tuple(None if x is None else np.asarray(x, float).tolist() for x in (som.cov_matrix, som.eigenvalues, som.eigenvectors))
    spark.createDataFrame([row], _HEADER).coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def load_som(spark: SparkSession, path: str) -> Som:
    h = spark.read.parquet(f"{path}/header").first()
    rows = spark.read.parquet(f"{path}/neurons").orderBy("neuron").collect()  # a row a neuron
    dtype = np.dtype(h.dtype).type
    som = Som(h.m, h.n, h.dim, h.topology, dtype, h.mode, h.alpha, h.sigma, np.array([r.w for r in rows], dtype))
    som.quantization_errors, som.topographic_errors = list(h.quantization_errors), list(h.topographic_errors)
    som.cov_matrix, som.eigenvalues, som.eigenvectors = (None if h[c] is None else np.array(h[c]) for c in ("cov_matrix", "eigenvalues", "eigenvectors"))
    return som


def save_sky(won: DataFrame, path: str) -> None:
    """Pixels with their best neuron, partitioned by coarse sky cell so that a region is read alone."""
    won.withColumn("cell", F.shiftright(F.col("pix").cast("long"), 12)).write.mode("overwrite").partitionBy("cell").parquet(path)


def load_sky(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("cell")


def save_cleaner(cleaner: SkyCleaner, path: str) -> None:
    """The map with its components, and the sky: pixels, systematics, density, coverage and best neuron."""
    if cleaner.som is None or cleaner.won is None:
        raise ValueError("train or use a map first")
    spark = cleaner.df.sparkSession
    save_som(spark, cleaner.som, f"{path}/som")
    spark.createDataFrame([(cleaner.nside, cleaner.vector, cleaner.density, cleaner.coverage)], "nside int, vector string, density string, coverage string").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")
    save_sky(cleaner.won, f"{path}/sky")


def load_cleaner(spark: SparkSession, path: str) -> SkyCleaner:
    """The same pipeline with its winners; densities by neuron are computed anew."""
    names = spark.read.parquet(f"{path}/names").first()
    sky = load_sky(spark, f"{path}/sky")
    out = SkyCleaner(sky.drop("corrected", "neuron"), names.nside, names.vector, names.density, names.coverage)
    out.som, out.won = load_som(spark, f"{path}/som"), sky
    return out.compute_gndm()


def from_chunks(spark: SparkSession, builder: Callable[[], Callable[[], Iterable[np.ndarray]]], path: str) -> DataFrame:
    """(row_id, v): the arrays of a replayable chunk generator, written one at a time as Arrow tables, so that one chunk is in memory.

    What stood at ``path`` before is replaced.
    """
    start = 0
    for chunk in builder()():
        x = np.atleast_2d(np.asarray(chunk, np.float64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        table = pa.Table.from_arrays([pa.array(np.arange(start, start + len(x))), lists], names=["row_id", "v"])
        spark.createDataFrame(table).write.mode("append" if start else "overwrite").parquet(path)
        start += len(x)
    return spark.read.schema("row_id long, v array<double>").parquet(path)
