"""Sky maps as sparse (pix, value) frames: degrading, multi-order cells, densities of catalogs, boxes, joins onto footprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import healpix as hp
from skyloom.functions.numeric import UNSEEN, UNSEEN_FLOAT

MODES = ("sum", "cov", "logquad", "log", "quad", "arith")


def full_sky(spark: SparkSession, nside: int, fill: float | None = None) -> DataFrame:
    return spark.range(hp.nside2npix(nside)).select(F.col("id").alias("pix"), F.lit(fill).cast("double").alias("value"))


def on_footprint(footprint: DataFrame, values: DataFrame, pix: str = "pix") -> DataFrame:
    """Gather: the footprint's rows, order and repeats included, with the map's value or NULL."""
    return footprint.join(values, pix, "left")


def scatter(base: DataFrame, update: DataFrame) -> DataFrame:
    """(pix, value) of ``base`` with the values of ``update`` where it has some."""
    return base.join(update.withColumnRenamed("value", "_new"), "pix", "left").select("pix", F.coalesce("_new", "value").alias("value"))


def ud_grade(df: DataFrame, nside_in: int, nside_out: int, mode: str = "arith", log_factor: float = 1.0, ignore_zeros: bool = False, pix: str = "pix", value: str = "value") -> DataFrame:
    """A NESTED map at a lower resolution, (pix, value). A parent has its index, so one shuffle on pix >> 2k with partial sums does.

    NULL, NaN and the sentinel are no values; ``ignore_zeros`` holds for the averages logquad, log, quad and arith alone.
    """
    if nside_out > nside_in:
        raise NotImplementedError("only degrading is possible")
    if nside_out == nside_in:
        return df
    w, factor = F.col(value).cast("double"), nside_in // nside_out
    valid = w.isNotNull() & ~F.isnan(w) & ~w.isin(UNSEEN, UNSEEN_FLOAT)
    if ignore_zeros and mode not in ("sum", "cov"):
        valid = valid & (w != 0)
    p = F.pow(F.lit(10.0), w / log_factor)
    out: Column = {
        "sum": F.sum(w) * float(factor * factor) / F.count(w),
        "cov": F.avg(w),
        "logquad": F.log10(F.sqrt(F.avg(p * p))) * log_factor,
        "log": F.log10(F.avg(p)) * log_factor,
        "quad": F.sqrt(F.avg(w * w)),
    }.get(mode, F.avg(w))
    parent = F.shiftright(F.col(pix).cast("long"), 2 * (hp.order_of(nside_in) - hp.order_of(nside_out)))
    return df.filter(valid).groupBy(parent.alias("pix")).agg(out.alias("value"))


def moc_expand(cells: DataFrame, order_new: int, order: str = "ord", index: str = "idx") -> DataFrame:
    """Cells of any order to pixels of order ``order_new``; overlapping cells repeat pixels. A finer cell raises when the plan runs."""
    deeper = F.lit(order_new) - F.col(order)
    ok = F.assert_true(deeper >= 0, F.lit("a cell is finer than the new order")).isNull()
    n = F.pow(F.lit(4.0), deeper).cast("long")
    return cells.filter(ok).withColumn("pix", F.explode(F.sequence(F.col(index) * n, F.col(index) * n + n - 1)))


def density_map(catalog: DataFrame, footprint: DataFrame, nside: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(pix, n): objects of the catalog in each pixel of the footprint, 0 included."""
    counts = catalog.groupBy(hp.ang2pix(nside, F.col(lon), F.col(lat)).alias("pix")).agg(F.count(F.lit(1)).alias("n"))
    return footprint.select("pix").join(counts, "pix", "left").select("pix", F.coalesce("n", F.lit(0)).alias("n"))


def bounding_box(footprint: DataFrame, nside: int, pix: str = "pix") -> DataFrame:
    """lon_center (circular mean), lon_min, lon_max (offsets wrapped around it), lat_center, lat_min, lat_max of pixel centers."""
    lon, lat = hp.pix2ang(nside, F.col(pix))
    p = footprint.select(F.radians(lon).alias("l"), F.radians(lat).alias("b"))
    mid = p.agg(F.atan2(F.avg(F.cos("b") * F.sin("l")), F.avg(F.cos("b") * F.cos("l"))).alias("c"))
    wrap = F.atan2(F.sin(F.col("l") - F.col("c")), F.cos(F.col("l") - F.col("c")))
    d = p.withColumn("c", mid.scalar()).select("c", "b", wrap.alias("d"))
    out = d.agg(F.max("c").alias("c"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    deg = lambda c: F.degrees(c)
    return out.select(deg("c").alias("lon_center"), deg(F.col("c") + F.col("lo")).alias("lon_min"), deg(F.col("c") + F.col("hi")).alias("lon_max"), deg((F.col("b0") + F.col("b1")) / 2).alias("lat_center"), deg("b0").alias("lat_min"), deg("b1").alias("lat_max"))


def color_limits(df: DataFrame, value: str, n_sigma: float | None = None, log: bool = False, assume_positive: bool = True) -> DataFrame:
    """(lo, hi): mean -+ n_sigma deviations (population), or min and max; log scales use positive values alone."""
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v) & ~v.isin(UNSEEN, UNSEEN_FLOAT))
    if log:
        rows = rows.filter(v > 0)
    if n_sigma is None:
        return rows.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    lo = F.avg(v) - F.stddev_pop(v) * n_sigma
    return rows.agg((F.greatest(lo, F.lit(0.0)) if assume_positive else lo).alias("lo"), (F.avg(v) + F.stddev_pop(v) * n_sigma).alias("hi"))


def raster(spark: SparkSession, values: DataFrame, nside: int, box: tuple[float, float, float, float], size: tuple[int, int]) -> DataFrame:
    """(x, y, pix, value) of a plate carree image of the box (lon_min, lon_max, lat_min, lat_max); values is (pix, value)."""
    w, h = size
    cells = spark.range(w * h).select(F.pmod("id", F.lit(w)).alias("x"), F.floor(F.col("id") / w).alias("y"))
    lon = F.lit(box[0]) + (F.col("x") + 0.5) * ((box[1] - box[0]) / w)
    lat = F.lit(box[2]) + (F.col("y") + 0.5) * ((box[3] - box[2]) / h)
    return cells.withColumn("pix", hp.ang2pix(nside, lon, lat)).join(values, "pix", "left").select("x", "y", "pix", "value")


__all__ = ["MODES", "bounding_box", "color_limits", "density_map", "full_sky", "moc_expand", "on_footprint", "raster", "scatter", "ud_grade"]
