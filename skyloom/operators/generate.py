"""Random catalogs: Poisson counts in pixels, objects uniform within their pixel, the same for a seed however the rows are partitioned."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import healpix as hp


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") / float(1 << 53)


def poisson_counts(df: DataFrame, rate: str, key: str, seed: int, into: str = "n_objects") -> DataFrame:
    """``df`` and a Poisson number of mean ``rate`` (0 where that isn't a positive number), drawn from a stream of its own for each key."""
    few = df.select(F.col(key).cast("long").alias("key"), F.col(rate).cast("double").alias("rate"), F.struct(*df.columns).alias("row"))
    kind = f"row {few.schema['row'].dataType.simpleString()}, {into} long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rates = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            out = [int(np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), int(k) & (2**64 - 1)])).poisson(r)) if r > 0 and math.isfinite(r) else 0 for k, r in zip(keys, rates, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.int64())], names=["row", into])

    return few.filter("key is not null").mapInArrow(run, kind).select("row.*", into)


def number_density(density: DataFrame, nside: int, mult_factor: float = 1.0, seed: int = 0, pix: str = "pix", value: str = "value") -> DataFrame:
    """(pix, lon, lat): Poisson(value * mult_factor) objects a pixel."""
    counts = poisson_counts(density.select(F.col(pix).alias("pix"), (F.col(value) * mult_factor).alias("rate")), "rate", "pix", seed)
    each = counts.filter("n_objects > 0").select("pix", F.explode(F.sequence(F.lit(1), F.col("n_objects"))).alias("k"))
    lon, lat = hp.pix2ang(nside, F.col("pix"), uniform(seed, F.col("pix"), F.col("k"), F.lit(1)), uniform(seed, F.col("pix"), F.col("k"), F.lit(2)))
    return each.select("pix", lon.alias("lon"), lat.alias("lat"))


def uniform_catalog(footprint: DataFrame, nside: int, mean_density: float, seed: int = 0) -> DataFrame:
    return number_density(footprint.select("pix", F.lit(float(mean_density)).alias("value")), nside, 1.0, seed)


def fullsky_uniform(spark: SparkSession, nside: int, mean_density: float, seed: int = 0) -> DataFrame:
    """(lon, lat): Poisson(floor(mean_density * npix)) objects uniform on the sphere."""
    n = int(np.random.default_rng(seed).poisson(int(mean_density * hp.nside2npix(nside))))
    return spark.range(n).select((uniform(seed, F.col("id"), F.lit(1)) * 360 - 180).alias("lon"), F.degrees(F.asin(uniform(seed, F.col("id"), F.lit(2)) * 2 - 1)).alias("lat"))


def catalog(objects: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(ra FLOAT, dec FLOAT)."""
    return objects.select(F.col(lon).cast("float").alias("ra"), F.col(lat).cast("float").alias("dec"))


def batches(counts: list[int], most: int | None) -> Iterator[tuple[int, int]]:
    """(start, stop) runs of pixels of at most ``most`` objects together; one pixel may exceed it."""
    start, total = 0, 0
    for i, c in enumerate(counts):
        if most is not None and i > start and total + c > most:
            yield start, i
            start, total = i, 0
        total += c
    if start < len(counts):
        yield start, len(counts)


def sequential(nside: int, footprint: list[int], density: list[float], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Driver-side draw from one NumPy stream (small maps, reproducible against published numbers): lon, lat in degrees."""
    rng = np.random.default_rng(seed)
    pix = np.repeat(np.asarray(footprint), rng.poisson(np.asarray(density, float)))
    u, v = rng.random((len(pix), 2)).T
    inside, f = pix % (nside * nside), pix // (nside * nside)
    x, y = np.zeros_like(pix), np.zeros_like(pix)
    for b in range(nside.bit_length()):
        x |= (inside >> (2 * b) & 1) << b
        y |= (inside >> (2 * b + 1) & 1) << b
    X, Y = (x + u) / nside, (y + v) / nside
    r = 1 - f // 4
    h = r - 1 + X + Y
    m = 2.0 - r * h
    c = np.array(hp.FACE_PHI)[f]
    with np.errstate(invalid="ignore", divide="ignore"):
        z = np.where(m > 1, 2 * h / 3, r * (1 - m * m / 3))
        phi = np.where(m > 1, c + X - Y, c + (X - Y) / m) * (math.pi / 4)
    s = np.where(m > 1, np.sqrt(np.maximum(1 - z * z, 0)), m * np.sqrt(np.maximum(2 / 3 - (m * m) / 9, 0)) * 1.0)
    return np.degrees(phi), 90 - np.degrees(np.arctan2(s, z))


def sequential_fullsky(nside: int, mean_density: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for fullsky_uniform(): lon, lat in degrees."""
    rng = np.random.default_rng(seed)
    n = rng.poisson(int(mean_density * hp.nside2npix(nside)))
    lon = rng.uniform(-180.0, 180.0, n)
    return lon, np.degrees(np.arcsin(rng.uniform(-1.0, 1.0, n)))
