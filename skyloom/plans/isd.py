"""Iterative decontamination: one systematic at a time is corrected by the model of its trend, until no trend is left."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators import binning, stats


class Model(Enum):
    """How a bin's correlation is modelled over its systematic."""

    LINEAR = "linear"
    INTERPOLATION = "interpolation"


@dataclass
class Isd:
    """Rows hold systematics ``dims``, a density and the number ``mock`` of the realisation (for variances over realisations)."""

    df: DataFrame
    dims: list[str]
    density: str
    mock: str
    n_bins: int = 10

    def __post_init__(self):
        bins = binning.exact_bins(self.df, self.dims, self.n_bins).select("dim", "bin", "lo", "hi").orderBy("dim", "bin").collect()  # dimensions x bins
        by = {d: [b for b in bins if b.dim == d] for d in range(len(self.dims))}
        self.edges = [[b.lo for b in by[d]] + [by[d][-1].hi] for d in range(len(self.dims))]
        centers = binning.bin_centers(self.df, self.dims, self.edges).filter("not isnan(center)")
        correlation = binning.equal_area_correlation(self.df, self.dims, self.density, self.edges)
        self.points = centers.join(correlation, ["dim", "bin"]).filter("not isnan(correlation)")
        rows = binning.binned(self.df, self.dims, self.edges, F.col(self.density).alias("d"), F.col(self.mock).alias("g")).groupBy("g", "dim", "bin").agg(F.avg("d").alias("m"))
        mean = self.df.groupBy(F.col(self.mock).alias("g")).agg(F.avg(self.density).alias("a"))
        self.variances = rows.join(mean, "g").groupBy("dim", "bin").agg(F.var_samp(F.col("m") / F.col("a")).alias("var"))

    def chi2(self, model: Model) -> DataFrame:
        """(dim, chi2): the gain of a line over no trend, or for interpolation the whole chi-square of no trend."""
        if model is Model.INTERPOLATION:
            return stats.chi2_of_one(self.points, self.variances, "dim", "bin", "correlation").withColumnRenamed("chi2_ini", "chi2")
        lines = stats.linear_fit(self.points, "dim", "center", "correlation")
        return stats.delta_chi2(self.points, lines, self.variances, "dim", "bin", "center", "correlation").select("dim", F.col("delta_chi2").alias("chi2"))

    def weight(self, dim: int, model: Model) -> Column:
        """The correction of a row by the systematic ``dim``."""
        points = self.points.filter(F.col("dim") == dim)
        if model is Model.LINEAR:
            slope, intercept = stats.linear_fit(points, "dim", "center", "correlation").select("slope", "intercept").first()
            return stats.correction_weight(F.col(self.dims[dim]), F.lit(slope), F.lit(intercept))
        p = points.orderBy("bin").select("center", "correlation").collect()  # a row a bin
        return F.lit(1.0) / stats.interpolate(F.col(self.dims[dim]), [x.center for x in p], [x.correlation for x in p])

    def most(self, model: Model) -> int:
        """The systematic with the strongest trend."""
        return self.chi2(model).orderBy(F.desc("chi2"), "dim").first()["dim"]
