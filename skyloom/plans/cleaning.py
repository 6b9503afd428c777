"""The cleaning pipeline: corrected densities, a map of systematics, densities by neuron, contrasts, visibilities and random catalogs."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numeric import divide
from skyloom.operators import binning, generate
from skyloom.operators.cluster import clusterize
from skyloom.operators.som import Som


def neuron_densities(won: DataFrame, neuron: str, catalog: Column, footprint: Column) -> DataFrame:
    """(neuron, cat, foot, gnd): sums by best neuron and their quotient, NULL without footprint."""
    sums = won.groupBy(neuron).agg(F.sum(catalog).alias("cat"), F.sum(footprint).alias("foot"))
    return sums.withColumn("gnd", F.when(F.col("foot") > 0, F.col("cat") / F.when(F.col("foot") > 0, F.col("foot"))))


def contrast(x: Column, mean: Column) -> Column:
    return (x - mean) / mean


def visibility(contrast_: Column, coverage: Column) -> Column:
    return (F.lit(1.0) + contrast_) * coverage


@dataclass
class SkyCleaner:
    """Rows are pixels: ``pix``, a vector of systematics, a density of objects and the covered share of the pixel."""

    df: DataFrame
    nside: int
    vector: str = "v"
    density: str = "density"
    coverage: str = "coverage"
    som: Som | None = None
    won: DataFrame | None = None
    table: DataFrame | None = None
    clustered: DataFrame | None = None
    clusters: np.ndarray | None = field(default=None)

    def __post_init__(self):
        self.df = self.df.withColumn("corrected", divide(F.col(self.density), F.col(self.coverage), 0.0))

    def binning(self, dims: list[str], n_bins: int, **how) -> binning.Binning:
        return binning.equal_area_binning(self.df, dims, n_bins, **how)

    def correlation(self, dims: list[str], edges: list[list[float]]) -> DataFrame:
        return binning.equal_area_correlation(self.df, dims, "corrected", edges)

    def train(self, m: int, n: int, dim: int, topology: str | None = "hexagonal", mode: str = "batch", cov: np.ndarray | None = None, **how) -> SkyCleaner:
        """Principal components (weighted by the corrected density, or from a given matrix) start the map; then epochs; then winners."""
        start = Som(m, n, dim, topology)
        start = start.train_from_cov(cov) if cov is not None else start.train_pca(self.df, self.vector, "corrected")
        self.som = Som(m, n, dim, topology, mode=mode).init_from(start).train(self.df, self.vector, "corrected", **how)
        return self.use(self.som)

    def use(self, som: Som) -> SkyCleaner:
        self.som, self.won = som, som.winners(self.df, self.vector)
        return self

    def compute_gndm(self) -> SkyCleaner:
        if self.won is None:
            raise ValueError("train or use a map first")
        self.table = neuron_densities(self.won, "neuron", F.col("corrected"), F.lit(1.0))
        return self

    def compute_clustered_gndm(self, n_clusters: int) -> SkyCleaner:
        """Neurons without rows stay out; the others' sums become those of their complete-linkage cluster."""
        if self.table is None:
            self.compute_gndm()
        spark = self.df.sparkSession
        active = {r.neuron for r in self.table.filter("foot > 0").select("neuron").collect()}  # a row a neuron
        w = self.som.weights.astype(float).copy()
        w[[k for k in range(len(w)) if k not in active]] = np.nan
        self.clusters = clusterize(w, n_clusters)
        ids = spark.createDataFrame([(k, int(c)) for k, c in enumerate(self.clusters)], "neuron int, cluster int")
        by = self.table.join(ids, "neuron").groupBy("cluster").agg(F.avg("cat").alias("cat"), F.avg("foot").alias("foot"))
        self.clustered = ids.join(by, "cluster").select("neuron", "cat", "foot", F.when(F.col("foot") > 0, F.col("cat") / F.when(F.col("foot") > 0, F.col("foot"))).alias("gnd"))
        return self

    def maps(self, clustered: bool = False) -> DataFrame:
        """The rows with neuron, gndm (of neurons, or of their clusters), gndc (contrast of the corrected density), gndcm (of gndm) and visibility."""
        table = self.clustered if clustered else self.table
        if table is None:
            raise ValueError("compute the densities first")
        mean = self.df.agg((F.sum("corrected") / F.count(F.lit(1))).alias("m")).scalar()
        out = self.won.join(F.broadcast(table.select("neuron", F.col("gnd").alias("gndm"))), "neuron", "left").withColumn("_m", mean)  # a row a neuron
        out = out.withColumn("gndc", contrast(F.col("corrected"), F.col("_m"))).withColumn("gndcm", contrast(F.col("gndm"), F.col("_m")))
        return out.withColumn("visibility", visibility(F.col("gndcm"), F.col(self.coverage))).drop("_m")

    def rates(self, kind: str, mean_density: float) -> DataFrame:
        """(pix, value): expected objects a pixel. data: the density scaled to a mean of ``mean_density``; uniform, visibility and
        clustered: ``mean_density`` times the coverage, the visibility or that by clusters."""
        if kind not in ("data", "uniform", "visibility", "clustered"):
            raise ValueError(f"unknown kind {kind!r}")
        if kind in ("visibility", "clustered"):
            return self.maps(kind == "clustered").select("pix", (F.col("visibility") * float(mean_density)).alias("value"))
        rows = self.df.select("pix", F.col(self.density if kind == "data" else self.coverage).cast("double").alias("value"))
        if kind == "uniform":
            return rows.select("pix", (F.col("value") * float(mean_density)).alias("value"))
        scale = rows.agg((F.lit(float(mean_density)) / F.avg("value")).alias("s")).scalar()
        return rows.withColumn("_s", scale).select("pix", (F.col("value") * F.col("_s")).alias("value"))

    def rates_by_row(self, kinds: tuple[str, ...], mean_density: float) -> DataFrame:
        """The rows with one column of rates() a kind: no join, so rows that share a pixel or an id stay apart."""
        if unknown := [k for k in kinds if k not in ("data", "uniform", "visibility", "clustered")]:
            raise ValueError(f"unknown kind {unknown[0]!r}")
        out, columns = (self.df if self.won is None else self.won), list(self.df.columns)
        cover, mean = F.col(self.coverage).cast("double"), float(mean_density)
        stats = self.df.agg(F.struct((F.sum("corrected") / F.count(F.lit(1))).alias("m"), (F.lit(mean) / F.avg(F.col(self.density).cast("double"))).alias("s")).alias("t")).scalar()
        out = out.withColumn("_t", stats)
        made = {"data": F.col(self.density).cast("double") * F.col("_t.s"), "uniform": cover * mean}
        for kind, table in (("visibility", self.table), ("clustered", self.clustered)):
            if kind in kinds:
                if table is None:
                    raise ValueError("compute the densities first")
                out = out.join(F.broadcast(table.select("neuron", F.col("gnd").alias(f"_{kind}"))), "neuron", "left")  # a row a neuron
                made[kind] = visibility(contrast(F.col(f"_{kind}"), F.col("_t.m")), F.col(self.coverage)) * mean
        return out.select(*columns, *(made[k].alias(k) for k in kinds))

    def generate(self, kind: str, mean_density: float, seed: int = 0) -> DataFrame:
        """(ra, dec) of a random catalog of that kind."""
        return generate.catalog(generate.number_density(self.rates(kind, mean_density), self.nside, 1.0, seed))
