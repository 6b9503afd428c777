"""Equal-area (equal-frequency) binning, global statistics, histograms and density against bins; each pass shuffles partial sums alone."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.numeric import all_finite, divide, finite

RANK_BUCKETS = 1024


def long_form(df: DataFrame, dims: list[str], *carry: str) -> DataFrame:
    """(carry..., dim, x) of the rows in which every dimension is finite."""
    cols = [F.col(d).cast("double") for d in dims]
    return df.filter(all_finite(cols)).select(*carry, F.posexplode(F.array(*cols)).alias("dim", "x"))


def global_stats(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, n, minimum, maximum, mean, rms, std) in one aggregate; std has n - 1 in its denominator and is NaN for one row."""
    cols = [F.col(d).cast("double") for d in dims]
    aggs = []
    for k, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{k}"), F.min(c).alias(f"lo{k}"), F.max(c).alias(f"hi{k}"), F.avg(c).alias(f"m{k}"), F.sqrt(F.avg(c * c)).alias(f"r{k}"), F.coalesce(F.stddev_samp(c), F.lit(float("nan"))).alias(f"s{k}")]
    row = df.filter(all_finite(cols)).agg(*aggs)
    parts = [F.struct(F.lit(k).alias("dim"), F.col(f"n{k}").alias("n"), F.col(f"lo{k}").alias("minimum"), F.col(f"hi{k}").alias("maximum"), F.col(f"m{k}").alias("mean"), F.col(f"r{k}").alias("rms"), F.col(f"s{k}").alias("std")) for k in range(len(dims))]
    return row.select(F.inline(F.array(*parts)))


def estimate_n_temp_bins(n_bins: int, n: int) -> int:
    return max(32 * n_bins, 1) if n <= 0 else int(max(32 * n_bins, min(256 * n_bins, 2 * math.sqrt(n))))


def histogram(df: DataFrame, value: str, n_bins: int, log: bool = False) -> DataFrame:
    """(bin, lo, hi, n) of equal (or equally log-spaced) bins between the extremes, the last one closed; empty bins are rows too."""
    x = F.col(value).cast("double")
    rows = df.filter(finite(x) & (x > 0 if log else F.lit(True))).select((F.ln(x) if log else x).alias("x"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    t = divide(F.col("x") - F.col("e.lo"), F.col("e.hi") - F.col("e.lo"), 0.0) * n_bins
    binned = rows.withColumn("e", ends.select(F.struct("lo", "hi")).scalar()).select(F.least(F.floor(t), F.lit(n_bins - 1)).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("hi") - F.col("lo")) / n_bins
    back = (lambda c: F.exp(c)) if log else (lambda c: c)
    skeleton = ends.select("lo", step.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return skeleton.join(counts, "bin", "left").select("bin", back(F.col("lo") + F.col("w") * F.col("bin")).alias("lo"), back(F.col("lo") + F.col("w") * (F.col("bin") + 1)).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def exact_bins(df: DataFrame, dims: list[str], n_bins: int) -> DataFrame:
    """(dim, bin, lo, hi, center, n): bins of equal counts, the first ones one longer, by exact ranks; center is a bin's mean.

    Equal values are counted before they are ranked, and ranks come from RANK_BUCKETS value ranges a dimension, so neither a frequent value
    nor a dimension is one task.
    """
    counts = long_form(df, dims).groupBy("dim", "x").agg(F.count(F.lit(1)).alias("c"))
    span = counts.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("c").alias("n"))
    place = F.least(F.floor(divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo"), 0.0) * RANK_BUCKETS), F.lit(RANK_BUCKETS - 1))
    put = counts.join(F.broadcast(span), "dim").withColumn("bucket", place)  # a row a dimension
    below = put.groupBy("dim", "bucket").agg(F.sum("c").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("dim").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = below.select("dim", "bucket", before.alias("offset"))
    inner = F.coalesce(F.sum("c").over(Window.partitionBy("dim", "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = put.join(F.broadcast(offsets), ["dim", "bucket"]).withColumn("start", F.col("offset") + inner)  # RANK_BUCKETS rows a dimension
    q, r = F.expr(f"n div {n_bins}"), F.expr(f"n % {n_bins}")
    tile = lambda rank: F.expr(f"case when {rank} < (n % {n_bins}) * (n div {n_bins} + 1) then {rank} div (n div {n_bins} + 1) else (n % {n_bins}) + ({rank} - (n % {n_bins}) * (n div {n_bins} + 1)) div greatest(n div {n_bins}, 1) end")
    spread = ranked.withColumn("bin", F.explode(F.sequence(tile("start"), tile("(start + c - 1)"))))
    first = F.col("bin") * q + F.least(F.col("bin"), r)
    last = (F.col("bin") + 1) * q + F.least(F.col("bin") + 1, r)
    part = (F.least(F.col("start") + F.col("c"), last) - F.greatest(F.col("start"), first)).cast("double")
    tiles = spread.groupBy("dim", "bin").agg(F.min("x").alias("lo"), (F.sum(F.col("x") * part) / F.sum(part)).alias("center"), F.sum(part).cast("long").alias("n"), F.max("hi").alias("top"))
    hi = F.coalesce(F.lead("lo").over(Window.partitionBy("dim").orderBy("bin")), F.col("top"))
    return tiles.select("dim", F.col("bin").cast("int").alias("bin"), "lo", hi.alias("hi"), "center", "n")


def temp_histogram(df: DataFrame, dims: list[str], n_temp: int, stats: DataFrame | None = None) -> DataFrame:
    """(dim, t, c): equi-width counts between each dimension's extremes; constant dimensions have none."""
    stats = (stats if stats is not None else global_stats(df, dims)).select("dim", "minimum", "maximum")
    x = long_form(df, dims).join(F.broadcast(stats), "dim").filter("maximum > minimum")  # a row a dimension
    t = F.least(F.floor((F.col("x") - F.col("minimum")) / (F.col("maximum") - F.col("minimum")) * n_temp), F.lit(n_temp - 1)).cast("int")
    return x.groupBy("dim", t.alias("t")).agg(F.count(F.lit(1)).alias("c"))


def approximate_edges(df: DataFrame, dims: list[str], n_bins: int, n_temp: int) -> DataFrame:
    """(dim, k, edge), k = 0 to n_bins: the histogram's cumulative counts, inverted linearly within a temporary bin."""
    stats = global_stats(df, dims)
    h = temp_histogram(df, dims, n_temp, stats)
    cum = F.sum("c").over(Window.partitionBy("dim").orderBy("t"))
    run = h.withColumn("cum", cum).join(F.broadcast(stats.select("dim", "n", "minimum", "maximum")), "dim")
    target = F.col("k") * F.col("n") / n_bins
    hit = run.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n_bins - 1)))).filter((F.col("cum") >= target) & (F.col("cum") - F.col("c") < target)) if n_bins > 1 else None
    edge = F.col("minimum") + (F.col("maximum") - F.col("minimum")) * (F.col("t") + (target - (F.col("cum") - F.col("c"))) / F.col("c")) / n_temp
    ks = stats.select("dim", "minimum", "maximum", F.explode(F.sequence(F.lit(0), F.lit(n_bins))).alias("k"))
    found = hit.select("dim", "k", edge.alias("e")) if hit is not None else ks.select("dim", "k", F.lit(None).cast("double").alias("e")).limit(0)
    return ks.join(found, ["dim", "k"], "left").select("dim", "k", F.when(F.col("k") == 0, F.col("minimum")).when(F.col("k") == n_bins, F.col("maximum")).otherwise(F.coalesce("e", F.when(F.col("minimum") == F.col("maximum"), F.col("minimum")).otherwise(F.col("maximum")))).alias("edge"))


def collected_edges(edges: DataFrame) -> list[list[float]]:
    """Edges of all dimensions on the driver: dimensions x (bins + 1) numbers."""
    out: dict[int, list[float]] = {}
    for r in edges.orderBy("dim", "k").collect():
        out.setdefault(r.dim, []).append(r.edge)
    return [out[d] for d in sorted(out)]


def bin_of(x: Column, edges: list[float]) -> Column:
    """The bin of x, clamped to the first and last one; a sum of comparisons, which stays in generated code."""
    out = F.lit(0)
    for e in edges[1:-1]:
        out = out + (x >= F.lit(float(e))).cast("int")
    return out


def binned(df: DataFrame, dims: list[str], edges: list[list[float]], *carry: Column) -> DataFrame:
    """(dim, bin, x, carry...): each finite row once a dimension."""
    cols = [F.col(d).cast("double") for d in dims]
    rows = F.array(*(F.struct(F.lit(k).alias("dim"), bin_of(c, edges[k]).alias("bin"), c.alias("x")) for k, c in enumerate(cols)))
    return df.filter(all_finite(cols)).select(*carry, F.inline(rows))


def skeleton(df: DataFrame, n_dims: int, n_bins: int) -> DataFrame:
    return df.sparkSession.range(n_dims * n_bins).select((F.col("id") / n_bins).cast("int").alias("dim"), F.pmod("id", F.lit(n_bins)).cast("int").alias("bin"))


def bin_centers(df: DataFrame, dims: list[str], edges: list[list[float]]) -> DataFrame:
    """(dim, bin, center): means in bins, NaN for empty ones; a constant dimension has its mean in every bin."""
    n_bins = len(edges[0]) - 1
    means = binned(df, dims, edges).groupBy("dim", "bin").agg(F.avg("x").alias("center"))
    constant = [k for k, e in enumerate(edges) if e[0] == e[-1]]
    whole = F.max("center").over(Window.partitionBy("dim"))
    out = skeleton(df, len(dims), n_bins).join(means, ["dim", "bin"], "left").withColumn("w", whole)
    return out.select("dim", "bin", F.when(F.col("dim").isin(constant), F.col("w")).otherwise(F.coalesce("center", F.lit(float("nan")))).alias("center"))


@dataclass
class Binning:
    edges: DataFrame
    centers: DataFrame
    stats: DataFrame


def equal_area_binning(df: DataFrame, dims: list[str], n_bins: int, n_temp_bins: int | None = None, exact: bool = False) -> Binning:
    """Edges (dim, k, edge), centers (dim, bin, center) and statistics of equal-area bins, exact or from a temporary histogram."""
    if n_bins <= 0:
        raise ValueError("n_bins must be positive")
    stats = global_stats(df, dims)
    n = stats.agg(F.max("n")).first()[0]
    if not n:
        raise ValueError("no row has finite values alone")
    if exact:
        if n_bins > n:
            raise ValueError("more bins than rows")
        bins = exact_bins(df, dims, n_bins)
        edges = bins.select("dim", F.col("bin").alias("k"), F.col("lo").alias("edge")).union(bins.filter(F.col("bin") == n_bins - 1).select("dim", F.lit(n_bins), "hi"))
        return Binning(edges, bins.select("dim", "bin", "center"), stats)
    n_temp = n_temp_bins or estimate_n_temp_bins(n_bins, n)
    if n_temp < n_bins:
        raise ValueError("fewer temporary bins than bins")
    edges = approximate_edges(df, dims, n_bins, n_temp)
    return Binning(edges, bin_centers(df, dims, collected_edges(edges)), stats)


def equal_area_correlation(df: DataFrame, dims: list[str], density: str, edges: list[list[float]]) -> DataFrame:
    """(dim, bin, correlation): mean density in the bin over the mean density; NaN where there is none."""
    d = F.col(density).cast("double")
    n_bins = len(edges[0]) - 1
    sums = binned(df.filter(finite(d)), dims, edges, d.alias("d")).groupBy("dim", "bin").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("dim")
    mean = F.sum("s").over(every) / F.sum("n").over(every)
    ratio = sums.withColumn("g", mean).select("dim", "bin", F.when(F.col("g") != 0, F.col("s") / F.col("n") / F.when(F.col("g") == 0, 1.0).otherwise(F.col("g"))).alias("c"))
    return skeleton(df, len(dims), n_bins).join(ratio, ["dim", "bin"], "left").select("dim", "bin", F.coalesce("c", F.lit(float("nan"))).alias("correlation"))
