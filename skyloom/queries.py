"""The library's queries over the driver tables, and the DuckDB SQL that says the same.

Systematics are four columns of lineitem, sky positions spread by the golden angle over keys of customer and supplier, vectors are embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import healpix as hp
from skyloom.functions import kernels, scalars
from skyloom.operators import binning, cluster, dataset, generate, maps, pairs, stats
from skyloom.operators.som import Som, find_hyperparameters
from skyloom.plans import cleaning, isd, selection
from skyloom.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# ---- selections ------------------------------------------------------------------------------------------------------------

_LINE = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
_SELECT = "select " + ", ".join(_LINE) + " from lineitem where "
for _name, _text, _where in (
    ("selection_compound", "l_quantity >= 10 && (l_discount < 0.05 || l_tax == 0.02)", "l_quantity >= 10 and (l_discount < 0.05 or l_tax = 0.02)"),
    ("selection_not", "~(l_quantity >= 10 && l_discount < 0.05)", "not (l_quantity >= 10 and l_discount < 0.05)"),
    ("selection_chain", "l_linenumber < 3 == 1 and l_tax", "l_linenumber < 3 and l_tax <> 0"),
):
    query(_name, _SELECT + _where)(lambda spark, sf, e=_text: selection.select(table(spark, sf, "lineitem"), e).select(*_LINE))


@query("selection_bitwise", "select p_partkey, (p_size & 4) = 0 as mask, (p_size | 3) > 40 as high from part")
def selection_bitwise(spark, sf):
    part = selection.with_mask(table(spark, sf, "part"), "(p_size & 0b100) == 0")
    return selection.with_mask(part, "p_size | 0x3 > 40", "high").select("p_partkey", "mask", "high")


@query("selection_isfinite", "select l_orderkey, l_linenumber, l_partkey, l_discount, l_discount <> 0 and l_discount <> 0.05 as mask, l_discount = 0 as unseen from lineitem")
def selection_isfinite(spark, sf):
    x = F.when(F.col("l_discount") == 0, F.when(F.col("l_linenumber") % 2 == 0, float("nan")).otherwise(-1.6375e30)).otherwise(F.col("l_discount"))
    line = selection.with_mask(table(spark, sf, "lineitem").withColumn("x", x), "isfinite x && x != 0.05")
    return selection.with_mask(line, "~isfinite x", "unseen").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "mask", "unseen")


@query("selection_bigint", "select o_orderkey, o_orderkey = 5 as same, o_orderkey > 5 as above from orders")
def selection_bigint(spark, sf):
    """Integers beyond 2**53 are told apart."""
    o = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey") + 9007199254740993 - 5)
    return selection.with_mask(selection.with_mask(o, "k == 9007199254740993", "same"), "k > 9007199254740993", "above").select("o_orderkey", "same", "above")


@query("selection_masked_column", _SELECT + "l_quantity < 5")
def selection_masked_column(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("empty", F.lit(None).cast("double"))
    return selection.select(line, "empty == 1 && l_quantity < 5", ignore_masked_columns=True).select(*_LINE)


# ---- dataset algebra -------------------------------------------------------------------------------------------------------

for _name, _f, _expr in (
    ("ds_add", dataset.ds_add, "l_extendedprice + l_discount"),
    ("ds_subtract", dataset.ds_subtract, "l_extendedprice - l_discount"),
    ("ds_multiply", dataset.ds_multiply, "l_extendedprice * l_discount"),
    ("ds_divide", dataset.ds_divide, "case when l_discount = 0 then 0 else l_extendedprice / l_discount end"),
):
    query(_name, f"select l_orderkey, l_linenumber, l_partkey, {_expr} as result from lineitem")(lambda spark, sf, f=_f: f(table(spark, sf, "lineitem"), "l_extendedprice", "l_discount", "result").select("l_orderkey", "l_linenumber", "l_partkey", "result"))


@query("ds_apply", "select l_orderkey, l_linenumber, l_partkey, l_quantity * (1 - l_discount) * (1 + l_tax) as result from lineitem")
def ds_apply(spark, sf):
    return dataset.ds_apply(table(spark, sf, "lineitem"), lambda q, d, t: q * (1 - d) * (1 + t), "l_quantity", "l_discount", "l_tax", into="result").select("l_orderkey", "l_linenumber", "l_partkey", "result")


@query("ds_vector", "select vec_id, list_transform(embedding, lambda x: x::double * 2)::double[] as doubled from embeddings")
def ds_vector(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return dataset.ds_vector(e, "+", "v", "v", "doubled").select("vec_id", "doubled")


@query("zip_join", "select o_orderkey, o_totalprice * 2 - o_custkey as result from orders")
def zip_join(spark, sf):
    o = table(spark, sf, "orders")
    both = dataset.zip_join(o.select("o_orderkey", (F.col("o_totalprice") * 2).alias("a")), o.select("o_orderkey", "o_custkey"), "o_orderkey")
    return both.select("o_orderkey", (F.col("a") - F.col("o_custkey")).alias("result"))


@query("batch_ranges", "select i as start, least(i + 7, 100) as stop from range(0, 100, 7) t(i)")
def batch_ranges(spark, sf):
    return dataset.batch_ranges(spark, 100, 7)


# ---- statistics and bins -----------------------------------------------------------------------------------------------------

DIMS = ["s0", "s1", "s2", "s3"]
_SYS = "sys as (select l_orderkey, l_linenumber, l_quantity as s0, l_extendedprice / 1000 as s1, l_discount as s2, l_tax as s3 from lineitem)"
_LONG = "long as (" + " union all ".join(f"select {k} as dim, s{k} as x, s0 as d, l_linenumber as g from sys" for k in range(4)) + ")"


def systematics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("s0"), (F.col("l_extendedprice") / 1000).alias("s1"), F.col("l_discount").alias("s2"), F.col("l_tax").alias("s3"))


@query("global_stats", f"with {_SYS}, {_LONG} select dim, count(*) as n, min(x) as minimum, max(x) as maximum, round(avg(x), 6) as mean, round(sqrt(avg(x * x)), 6) as rms, round(stddev_samp(x), 6) as std from long group by dim")
def global_stats(spark, sf):
    return binning.global_stats(systematics(spark, sf), DIMS).select("dim", "n", "minimum", "maximum", r("mean").alias("mean"), r("rms").alias("rms"), r("std").alias("std"))


N_BINS = 10
_TILES = f"tiles as (select dim, ntile({N_BINS}) over (partition by dim order by x) - 1 as bin, x from long)"
_EXACT = "bins as (select dim, bin, min(x) as lo, max(x) as mx, avg(x) as center, count(*) as n from tiles group by dim, bin), edges as (select dim, bin, lo, coalesce(lead(lo) over (partition by dim order by bin), mx) as hi, center, n from bins)"


@query("equal_area_exact", f"with {_SYS}, {_LONG}, {_TILES}, {_EXACT} select dim, bin::int as bin, lo, hi, round(center, 6) as center, n from edges")
def equal_area_exact(spark, sf):
    return binning.exact_bins(systematics(spark, sf), DIMS, N_BINS).select("dim", "bin", "lo", "hi", r("center").alias("center"), "n")


N_TEMP = 32 * N_BINS
_APPROX = f"""st as (select dim, count(*) as n, min(x) as mn, max(x) as mx from long group by dim),
h as (select dim, least(floor((x - mn) / (mx - mn) * {N_TEMP}), {N_TEMP - 1})::int as t, count(*) as c from long join st using (dim) where mx > mn group by all),
cum as (select dim, t, c, sum(c) over (partition by dim order by t) as cum from h),
k as (select dim, n, mn, mx, unnest(range(0, {N_BINS + 1})) as k from st),
hit as (select k.dim, k.k, min(t) as t from k join cum on k.dim = cum.dim and cum.cum >= k.k * k.n / {N_BINS} group by all),
e as (select k.dim, k.k, case when k.k = 0 then mn when k.k = {N_BINS} then mx else mn + (mx - mn) * (hit.t + (k.k * n / {N_BINS} - (cum - c)) / c) / {N_TEMP} end as edge
  from k join hit on hit.dim = k.dim and hit.k = k.k join cum on cum.dim = hit.dim and cum.t = hit.t)"""


@query("temp_histogram", f"with {_SYS}, {_LONG}, {_APPROX} select dim, t, c from h")
def temp_histogram(spark, sf):
    return binning.temp_histogram(systematics(spark, sf), DIMS, N_TEMP)


@query("equal_area_approx", f"with {_SYS}, {_LONG}, {_APPROX} select dim, k::int as k, round(edge, 6) as edge from e")
def equal_area_approx(spark, sf):
    return binning.approximate_edges(systematics(spark, sf), DIMS, N_BINS, N_TEMP).select("dim", "k", r("edge").alias("edge"))


@query("bin_centers", f"with {_SYS}, {_LONG}, {_TILES}, {_EXACT}, put as (select l.dim, max(e.bin) as bin, any_value(l.x) as x, count(*) as m from (select dim, x, row_number() over () as i from long) l join edges e on l.dim = e.dim and (l.x >= e.lo or e.bin = 0) group by l.dim, l.i) select dim, bin::int as bin, round(avg(x), 6) as center from put group by all")
def bin_centers(spark, sf):
    s = systematics(spark, sf)
    edges = binning.collected_edges(binning.equal_area_binning(s, DIMS, N_BINS, exact=True).edges)
    return binning.bin_centers(s, DIMS, edges).filter("not isnan(center)").select("dim", "bin", r("center").alias("center"))


_CORR = f"""{_SYS}, {_LONG}, {_TILES}, {_EXACT}, cuts as (select dim, list(lo order by bin) as los from edges group by dim),
put as (select long.dim, greatest(len(list_filter(los, lambda e: x >= e)) - 1, 0) as bin, d, x, g from long join cuts on long.dim = cuts.dim),
corr as (select dim, bin, avg(d) / (select avg(s0) from sys) as c from put group by dim, bin)"""


def _edges(spark: SparkSession, sf: str) -> tuple[DataFrame, list[list[float]]]:
    s = systematics(spark, sf)
    bins = binning.exact_bins(s, DIMS, N_BINS).select("dim", "bin", "lo", "hi").orderBy("dim", "bin").collect()  # dimensions x bins
    return s, [[b.lo for b in bins if b.dim == d] + [[b.hi for b in bins if b.dim == d][-1]] for d in range(len(DIMS))]


@query("equal_area_correlation", f"with {_CORR}, sk as (select dim, bin from edges) select sk.dim, sk.bin::int as bin, round(c, 6) as correlation from sk left join corr on sk.dim = corr.dim and sk.bin = corr.bin")
def equal_area_correlation(spark, sf):
    s, edges = _edges(spark, sf)
    out = binning.equal_area_correlation(s, DIMS, "s0", edges)
    return out.select("dim", "bin", r(F.when(~F.isnan("correlation"), F.col("correlation"))).alias("correlation"))


@query("colorbar_histogram", "with e as (select min(value) as lo, max(value) as hi from events where isfinite(value)), h as (select least(floor((value - lo) / (hi - lo) * 20), 19)::int as bin, count(*) as n from events, e where isfinite(value) group by 1) select b::int as bin, round(lo + (hi - lo) / 20 * b, 6) as lo, round(lo + (hi - lo) / 20 * (b + 1), 6) as hi, coalesce(n, 0) as n from range(20) t(b) cross join e left join h on h.bin = b")
def colorbar_histogram(spark, sf):
    return binning.histogram(table(spark, sf, "events"), "value", 20).select("bin", r("lo").alias("lo"), r("hi").alias("hi"), "n")


@query("color_limits", "select round(greatest(avg(value) - 2 * stddev_pop(value), 0), 6) as lo, round(avg(value) + 2 * stddev_pop(value), 6) as hi from events where isfinite(value)")
def color_limits(spark, sf):
    return maps.color_limits(table(spark, sf, "events"), "value", 2.0).select(r("lo").alias("lo"), r("hi").alias("hi"))


_PAIRS = [(j, k) for j in range(4) for k in range(4)]


@query("covariance", f"with {_SYS} " + " union all ".join(f"select {j} as j, {k} as k, round(covar_samp(s{j}, s{k}), 6) as cov from sys" for j, k in _PAIRS))
def covariance(spark, sf):
    return stats.covariance(systematics(spark, sf), DIMS).select("j", "k", r("cov").alias("cov"))


@query("covariance_weighted", f"with {_SYS}, m as (select sum(s0) as w, " + ", ".join(f"sum(s0 * s{k}) / sum(s0) as m{k}" for k in range(4)) + " from sys) " + " union all ".join(f"select {j} as j, {k} as k, round(sum(s0 * (s{j} - m{j}) * (s{k} - m{k})) / (any_value(w) - 1), 6) as cov from sys, m" for j, k in _PAIRS))
def covariance_weighted(spark, sf):
    return stats.covariance(systematics(spark, sf), DIMS, "s0").select("j", "k", r("cov").alias("cov"))


def _leading(name: str, source: str, squarings: int = 14) -> str:
    """CTEs to v{name} (k, x): the leading eigenvector of the symmetric matrix source (j, k, c), by powers of it; its largest entry is positive."""
    steps = [f"{name}_0 as materialized (select j, k, c / sqrt(sum(c * c) over ()) as c from {source})"]
    for i in range(squarings):
        steps.append(f"{name}_{i + 1} as materialized (select j, k, c / sqrt(sum(c * c) over ()) as c from (select a.j, b.k, sum(a.c * b.c) as c from {name}_{i} a join {name}_{i} b on a.k = b.j group by a.j, b.k))")
    top = f"(select j, c from {name}_{squarings} where k = (select k from {name}_{squarings} group by k order by sum(c * c) desc, k limit 1))"
    steps.append(f"v{name} as materialized (select j as k, c * (select sign(c) from {top} order by abs(c) desc limit 1) / (select sqrt(sum(c * c)) from {top}) as x from {top})")
    return ", ".join(steps)


_COV = "cov as materialized (" + " union all ".join(f"select {j} as j, {k} as k, covar_samp(s{j}, s{k}) as c from sys" for j, k in _PAIRS) + ")"
_COMPONENTS = f"""{_COV}, {_leading("a", "cov")}, ev as materialized (select sum(l.x * c * m.x) as e from cov join va l on l.k = cov.j join va m on m.k = cov.k),
rest as materialized (select j, cov.k, c - e * l.x * m.x as c from ev, cov join va l on l.k = cov.j join va m on m.k = cov.k), {_leading("b", "rest")}"""


@query("pca_projection", f"with {_SYS}, {_COMPONENTS} select l_orderkey, l_linenumber, " + ", ".join(f"round({' + '.join(f's{k} * (select x from v{v} where k = {k})' for k in range(4))}, 4) + 0::double as p{i}" for i, v in enumerate("ab")) + " from sys")
def pca_projection(spark, sf):
    s = systematics(spark, sf)
    _, vectors = stats.diagonalize(stats.as_matrix(stats.covariance(s, DIMS)), positive=True)
    return stats.project(s, DIMS, vectors[:, :2]).select("l_orderkey", "l_linenumber", r("p0", 4).alias("p0"), r("p1", 4).alias("p1"))


@query("regression_analytic", f"with {_SYS} select round(regr_slope(s1, s0), 6) as weight, round(regr_intercept(s1, s0), 6) as intercept, round(sqrt(avg(power(s1 - a - b * s0, 2))), 6) as rmse from sys, (select regr_slope(s1, s0) as b, regr_intercept(s1, s0) as a from sys)")
def regression_analytic(spark, sf):
    model = stats.LinearRegression(["s0"]).train(systematics(spark, sf), "s1")
    return spark.createDataFrame([(round(float(model.weights[0]), 6), round(model.intercept, 6), round(model.error, 6))], "weight double, intercept double, rmse double")


@query("regression_predict", f"with {_SYS} select l_orderkey, l_linenumber, s0, round(a + b * s0, 6) as predicted from sys, (select regr_slope(s1, s0) as b, regr_intercept(s1, s0) as a from sys)")
def regression_predict(spark, sf):
    s = systematics(spark, sf)
    model = stats.LinearRegression(["s0"]).train(s, "s1", compute_error=False)
    return s.select("l_orderkey", "l_linenumber", "s0", r(model.predict()).alias("predicted"))


@query("regression_cv_error", f"with {_SYS} select round(sqrt(avg(power(s1 - a - b * s0, 2))), 6) as rmse from sys, (select regr_slope(s1, s0) as b, regr_intercept(s1, s0) as a from sys) where l_orderkey % 5 not in (1, 3)")
def regression_cv_error(spark, sf):
    s = systematics(spark, sf)
    return stats.LinearRegression(["s0"]).train(s, "s1", compute_error=False).rmse(s, "s1", "l_orderkey", 5, [1, 3]).select(r("rmse").alias("rmse"))


_MOMENTS = "mo as materialized (select count(*)::double as n, sum(s2) as a, sum(s3) as b, sum(s2 * s2) as aa, sum(s2 * s3) as ab, sum(s3 * s3) as bb, sum(s0) as y, sum(s2 * s0) as ay, sum(s3 * s0) as by_ from sys)"


@query("regression_gd", f"""with recursive {_SYS}, {_MOMENTS}, gd as (select 0 as t, 0::double as c, 0::double as w0, 0::double as w1, 1::double as d0, 1::double as d1, 1::double as d2 from mo union all
  select t + 1, c + d_0, w0 + d_1, w1 + d_2, d_0, d_1, d_2 from (select gd.*, 0.5 * (y - n * c - a * w0 - b * w1) / n as d_0, 0.5 * (ay - a * c - aa * w0 - ab * w1) / n as d_1, 0.5 * (by_ - b * c - ab * w0 - bb * w1) / n as d_2 from gd, mo)
  where t < 2000 and not (sqrt(d1 * d1 + d2 * d2) < 1e-9 and abs(d0) < 1e-9)),
last as (select * from gd order by t desc limit 1)
select round(w0, 6) as w0, round(w1, 6) as w1, round(c, 6) as intercept, (select round(sqrt(avg(power(s0 - c - w0 * s2 - w1 * s3, 2))), 6) from sys, last) as rmse from last""")
def regression_gd(spark, sf):
    model = stats.LinearRegression(["s2", "s3"], alpha=0.5, tolerance=1e-9).train(systematics(spark, sf), "s0", n_epochs=2000, analytic=False)
    return spark.createDataFrame([tuple(round(float(x), 6) for x in (*model.weights, model.intercept, model.error))], "w0 double, w1 double, intercept double, rmse double")


@query("regression_null", f"with {_SYS} select round(regr_slope(s1, s0), 6) as weight, round(regr_intercept(s1, s0), 6) as intercept, round(sqrt(avg(power(s1 - a - b * s0, 2))), 6) as rmse from sys, (select regr_slope(s1, s0) as b, regr_intercept(s1, s0) as a from sys where l_linenumber > 2) where l_linenumber > 2")
def regression_null(spark, sf):
    """Rows with a null or NaN feature or target teach nothing."""
    odd = F.when(F.col("l_linenumber") > 2, F.col("s0")).when(F.col("l_linenumber") == 2, F.lit(float("nan")))
    model = stats.LinearRegression(["s0"]).train(systematics(spark, sf).withColumn("s0", odd), "s1")
    return spark.createDataFrame([(round(float(model.weights[0]), 6), round(model.intercept, 6), round(model.error, 6))], "weight double, intercept double, rmse double")


def _isd(spark: SparkSession, sf: str) -> tuple[DataFrame, list[list[float]], DataFrame]:
    s, edges = _edges(spark, sf)
    centers = binning.bin_centers(s, DIMS, edges).filter("not isnan(center)")
    return s, edges, centers.join(binning.equal_area_correlation(s, DIMS, "s0", edges), ["dim", "bin"]).filter("not isnan(correlation)")


_POINTS = f"{_CORR}, pts as (select dim, bin, avg(x) as center, avg(d) / (select avg(s0) from sys) as correlation from put group by dim, bin), fit as (select dim, regr_slope(correlation, center) as slope, regr_intercept(correlation, center) as intercept from pts group by dim)"


@query("isd_linear_fit", f"with {_POINTS} select dim, round(slope, 6) + 0::double as slope, round(intercept, 6) + 0::double as intercept from fit")
def isd_linear_fit(spark, sf):
    return stats.linear_fit(_isd(spark, sf)[2], "dim", "center", "correlation").select("dim", r("slope").alias("slope"), r("intercept").alias("intercept"))


@query("isd_weights", f"with {_POINTS} select l_orderkey, l_linenumber, s1, round(1 / (slope * s1 + intercept), 6) as weight from sys, fit where fit.dim = 1")
def isd_weights(spark, sf):
    s, _, points = _isd(spark, sf)
    slope, intercept = stats.linear_fit(points.filter("dim = 1"), "dim", "center", "correlation").select("slope", "intercept").first()
    return s.select("l_orderkey", "l_linenumber", "s1", r(stats.correction_weight(F.col("s1"), F.lit(slope), F.lit(intercept))).alias("weight"))


@query("isd_linear_interp", f"with {_POINTS}, seg as (select center as a, correlation as c, lead(center) over (order by bin) as b, lead(correlation) over (order by bin) as d, row_number() over (order by bin) as i, count(*) over () as m from pts where dim = 1) select l_orderkey, l_linenumber, s1, round(1 / (c + (s1 - a) * (d - c) / (b - a)), 6) as weight from sys join seg on i < m and (s1 >= a or i = 1) and (s1 < b or i = m - 1)")
def isd_linear_interp(spark, sf):
    s, _, points = _isd(spark, sf)
    p = points.filter("dim = 1").orderBy("bin").select("center", "correlation").collect()  # a row a bin
    return s.select("l_orderkey", "l_linenumber", "s1", r(F.lit(1.0) / stats.interpolate(F.col("s1"), [x.center for x in p], [x.correlation for x in p])).alias("weight"))


@query("isd_delta_chi2", f"with {_POINTS}, mock as (select g, dim, bin, avg(d) as m from put group by all), mm as (select l_linenumber as g, avg(s0) as a from sys group by 1), v as (select dim, bin, var_samp(m / a) as var from mock join mm using (g) group by all) select dim, round(sum(power(correlation - 1, 2) / var) - sum(power(correlation - slope * center - intercept, 2) / var), 4) as delta_chi2 from pts join fit using (dim) join v using (dim, bin) where dim > 0 group by dim")
def isd_delta_chi2(spark, sf):
    s, edges, points = _isd(spark, sf)
    rows = binning.binned(s, DIMS, edges, F.col("s0").alias("d"), F.col("l_linenumber").alias("g")).groupBy("g", "dim", "bin").agg(F.avg("d").alias("m"))
    mean = s.groupBy(F.col("l_linenumber").alias("g")).agg(F.avg("s0").alias("a"))
    var = rows.join(mean, "g").groupBy("dim", "bin").agg(F.var_samp(F.col("m") / F.col("a")).alias("var"))
    lines = stats.linear_fit(points, "dim", "center", "correlation")
    return stats.delta_chi2(points, lines, var, "dim", "bin", "center", "correlation").filter("dim > 0").select("dim", r("delta_chi2", 4).alias("delta_chi2"))


@query("isd_chi2_interp", f"with {_POINTS}, mock as (select g, dim, bin, avg(d) as m from put group by all), mm as (select l_linenumber as g, avg(s0) as a from sys group by 1), v as (select dim, bin, var_samp(m / a) as var from mock join mm using (g) group by all) select dim, round(sum(power(correlation - 1, 2) / var), 4) as chi2 from pts join v using (dim, bin) where dim > 0 group by dim")
def isd_chi2_interp(spark, sf):
    chi2 = isd.Isd(systematics(spark, sf), DIMS, "s0", "l_linenumber", N_BINS).chi2(isd.Model.INTERPOLATION)
    return chi2.filter("dim > 0").select("dim", r("chi2", 4).alias("chi2"))


# ---- HEALPix and maps ----------------------------------------------------------------------------------------------------------

NSIDE = 32


def position(key: Column) -> tuple[Column, Column]:
    a, b = key * 137.50776405, key * 0.61803398875
    return a - F.floor(a / 360) * 360, F.degrees(F.asin((b - F.floor(b)) * 2 - 1))


def _sql_position(key: str) -> str:
    a, b = f"({key} * 137.50776405::double)", f"({key} * 0.61803398875::double)"
    return f"{a} - floor({a} / 360) * 360 as lon, degrees(asin(2 * ({b} - floor({b})) - 1)) as lat"


def _sql_spread(x: str, order: int) -> str:
    return f"list_sum(list_transform(range(0, {order + 1}), lambda b: (({x} >> b::int) & 1) << (2 * b)::int))::bigint"


def _sql_compress(x: str, order: int) -> str:
    return f"list_sum(list_transform(range(0, {order + 1}), lambda b: (({x} >> (2 * b)::int) & 1) << b::int))::bigint"


def _sql_ang2pix(source: str, nside: int, keep: str, name: str = "pixels") -> str:
    """CTEs from ``source`` (lon, lat) to ``name`` (keep, pix)."""
    o, n = hp.order_of(nside), nside
    return f"""{name}_a as (select *, sin(radians(lat)) as z, fmod(fmod(radians(lon), 2 * pi()) + 2 * pi(), 2 * pi()) * (2 / pi()) as t from {source}),
{name}_b as (select *, floor((t + 0.5) * {n} - z * {0.75 * n}::double)::bigint as jp, floor((t + 0.5) * {n} + z * {0.75 * n}::double)::bigint as jm, least(floor(t), 3)::bigint as q, sqrt((1 - abs(z)) * 3) * {n} as rr from {name}_a),
{name}_c as (select *, jp // {n} as ip, jm // {n} as im, least(floor((t - q) * rr), {n - 1})::bigint as up, least(floor((1 - (t - q)) * rr), {n - 1})::bigint as um from {name}_b),
{name}_d as (select *, case when abs(z) <= 2 / 3::double then jm % {n} when z > 0 then {n - 1} - um else up end as x, case when abs(z) <= 2 / 3::double then {n - 1} - jp % {n} when z > 0 then {n - 1} - up else um end as y,
  case when abs(z) <= 2 / 3::double then (case when ip = im then (case when ip = 4 then 4 else ip + 4 end) when ip < im then ip else im + 8 end) when z > 0 then q else q + 8 end as f from {name}_c),
{name} as (select {keep}, {_sql_spread("x", o)} + 2 * {_sql_spread("y", o)} + f * {n * n} as pix from {name}_d)"""


def _sql_xyf(nside: int, pix: str = "pix") -> str:
    o = hp.order_of(nside)
    return f"{_sql_compress(f'({pix} % {nside * nside})', o)} as x, {_sql_compress(f'(({pix} % {nside * nside}) >> 1)', o)} as y, {pix} // {nside * nside} as f"


def _sql_center(source: str, nside: int, keep: str) -> str:
    """CTEs from ``source`` (pix) to ``centers`` (keep, lon, lat)."""
    phi = "[" + ", ".join(map(str, hp.FACE_PHI)) + "]"
    return f"""ca as (select {keep}, {_sql_xyf(nside)} from {source}),
cb as (select *, (x + 0.5::double) / {nside} as xx, (y + 0.5::double) / {nside} as yy, 1 - f // 4 as r from ca),
cc as (select *, r - 1 + xx + yy as h, 2 - r * (r - 1 + xx + yy) as m, ({phi})[f + 1] as c from cb),
cd as (select *, case when m > 1 then h * 2 / 3 else r * (1 - m * m / 3) end as z, (case when m > 1 then c + xx - yy else c + (xx - yy) / m end) * pi() / 4 as p from cc),
centers as (select {keep}, degrees(p) as lon, degrees(atan2(z, sqrt(greatest((1 - z) * (1 + z), 0)))) as lat from cd)"""


def customers(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = position(F.col("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal", lon.alias("lon"), lat.alias("lat"))


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = position(F.col("s_suppkey"))
    return table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", lon.alias("lon"), lat.alias("lat"))


_CUST = f"cust as (select c_custkey, c_acctbal, {_sql_position('c_custkey')} from customer)"
_SUPP = f"supp as (select s_suppkey, s_acctbal, {_sql_position('s_suppkey')} from supplier)"


@query("hp_ang2pix", f"with {_CUST}, {_sql_ang2pix('cust', NSIDE, 'c_custkey')} select c_custkey, pix from pixels")
def hp_ang2pix(spark, sf):
    return customers(spark, sf).select("c_custkey", hp.ang2pix(NSIDE, F.col("lon"), F.col("lat")).alias("pix"))


def part_map(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.pmod("p_partkey", F.lit(hp.nside2npix(NSIDE))).alias("pix"), F.col("p_retailprice").alias("value"))


_MAP = f"map as (select p_partkey, p_partkey % {12 * NSIDE * NSIDE} as pix, p_retailprice as value from part)"


@query("hp_nest2xyf", f"with {_MAP} select p_partkey, pix, {_sql_xyf(NSIDE)} from map")
def hp_nest2xyf(spark, sf):
    x, y, f = hp.nest2xyf(NSIDE, F.col("pix"))
    return part_map(spark, sf).select("p_partkey", "pix", x.alias("x"), y.alias("y"), f.alias("f"))


@query("hp_xyf2nest", f"select p_partkey, {_sql_spread(f'(p_partkey % {NSIDE})', 5)} + 2 * {_sql_spread(f'(p_partkey * 7 % {NSIDE})', 5)} + p_partkey % 12 * {NSIDE * NSIDE} as pix from part")
def hp_xyf2nest(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", hp.xyf2nest(NSIDE, k % NSIDE, k * 7 % NSIDE, k % 12).alias("pix"))


@query("hp_pix2global", f"with {_MAP}, g as (select p_partkey, {_sql_xyf(NSIDE)} from map) select p_partkey, x + f % 4 * {NSIDE} as gx, y + f // 4 * {NSIDE} as gy from g")
def hp_pix2global(spark, sf):
    x, y = hp.pix2global(NSIDE, F.col("pix"))
    return part_map(spark, sf).select("p_partkey", x.alias("gx"), y.alias("gy"))


@query("hp_pixel_center", f"with {_MAP}, {_sql_center('map', NSIDE, 'p_partkey')} select p_partkey, round(lon, 6) as lon, round(lat, 6) as lat from centers")
def hp_pixel_center(spark, sf):
    lon, lat = hp.pix2ang(NSIDE, F.col("pix"))
    return part_map(spark, sf).select("p_partkey", r(lon).alias("lon"), r(lat).alias("lat"))


@query("hp_resolution", "select k::int as k, 12 * (1 << k::int)::bigint * (1 << k::int) as npix, round(degrees(degrees(pi() / 3 / pow(4, k))), 6) as area, round(degrees(sqrt(pi() / 3) / pow(2, k)) * 60, 6) as resol from range(0, 11) t(k)")
def hp_resolution(spark, sf):
    rows = [(k, hp.nside2npix(1 << k), round(hp.nside2pixarea(1 << k, True), 6), round(hp.nside2resol(1 << k, True), 6)) for k in range(11)]
    return spark.createDataFrame(rows, "k int, npix long, area double, resol double")


@query("hp_ring2nest", f"with map as (select i as pix, i from range(0, 3072) t(i)), {_sql_center('map', 16, 'i')} select row_number() over (order by round(lat, 9) desc, fmod(lon + 360, 360)) - 1 as ring, i as nest from centers")
def hp_ring2nest(spark, sf):
    return spark.range(hp.nside2npix(16)).select(F.col("id").alias("ring"), hp.ring2nest(16, F.col("id")).alias("nest"))


@query("moc_nuniq", "select n_nationkey, (64 + n_nationkey)::bigint as nuniq, 2 as ord, n_nationkey::bigint as idx from nation")
def moc_nuniq(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", hp.order_index2nuniq(F.lit(2), F.col("n_nationkey")).alias("nuniq"))
    order, index = hp.nuniq2order_index(F.col("nuniq"))
    return n.select("n_nationkey", "nuniq", order.alias("ord"), index.alias("idx"))


@query("moc_expand", "select n_nationkey, unnest(range(n_nationkey * 16::bigint, n_nationkey * 16::bigint + 16)) as pix from nation")
def moc_expand(spark, sf):
    cells = table(spark, sf, "nation").select("n_nationkey", F.lit(2).alias("ord"), F.col("n_nationkey").cast("long").alias("idx"))
    return maps.moc_expand(cells, 4).select("n_nationkey", "pix")


@query("wmoc_expand", "select n_regionkey * 0.5::double as weight, unnest(range(n_nationkey * pow(4, 2 - n_nationkey % 3)::bigint, (n_nationkey + 1) * pow(4, 2 - n_nationkey % 3)::bigint)) as pix from nation")
def wmoc_expand(spark, sf):
    cells = table(spark, sf, "nation").select((F.col("n_regionkey") * 0.5).alias("weight"), (F.col("n_nationkey") % 3 + 2).alias("ord"), F.col("n_nationkey").cast("long").alias("idx"))
    return maps.moc_expand(cells, 4).select("weight", "pix")


for _mode, _sql in (
    ("sum", "sum(value) * 16 / count(*)"),
    ("cov", "avg(value)"),
    ("logquad", "1000 * log10(sqrt(avg(power(power(10, value / 1000), 2))))"),
    ("log", "1000 * log10(avg(power(10, value / 1000)))"),
    ("quad", "sqrt(avg(value * value))"),
    ("arith", "avg(value)"),
):
    query(f"ud_grade_{_mode}", f"with {_MAP} select pix // 16 as pix, round({_sql}, 6) as value from map group by 1")(lambda spark, sf, m=_mode: maps.ud_grade(part_map(spark, sf), NSIDE, NSIDE // 4, m, 1000.0).select("pix", r("value").alias("value")))


@query("density_map", f"with {_CUST}, {_sql_ang2pix('cust', 8, 'c_custkey')} select i as pix, count(c_custkey) as n from range(0, 768, 2) t(i) left join pixels on pix = i group by 1")
def density_map(spark, sf):
    return maps.density_map(customers(spark, sf), spark.range(0, 768, 2).withColumnRenamed("id", "pix"), 8)


_BOX = _sql_center("foot", 16, "pix")


@query("bounding_box", f"with foot as (select i as pix from range(100, 300) t(i)), {_BOX}, p as (select radians(lon) as l, radians(lat) as b from centers), c as (select atan2(avg(cos(b) * sin(l)), avg(cos(b) * cos(l))) as c from p), d as (select c, b, atan2(sin(l - c), cos(l - c)) as d from p, c) select round(degrees(max(c)), 6) as lon_center, round(degrees(max(c) + min(d)), 6) as lon_min, round(degrees(max(c) + max(d)), 6) as lon_max, round(degrees((min(b) + max(b)) / 2), 6) as lat_center, round(degrees(min(b)), 6) as lat_min, round(degrees(max(b)), 6) as lat_max from d")
def bounding_box(spark, sf):
    box = maps.bounding_box(spark.range(100, 300).withColumnRenamed("id", "pix"), 16)
    return box.select(*(r(c).alias(c) for c in box.columns))


@query("full_sky", "select i as pix, 0.5::double as value from range(0, 768) t(i)")
def full_sky(spark, sf):
    return maps.full_sky(spark, 8, 0.5)


@query("scatter", f"with {_MAP}, up as (select pix, max(value) as v from map group by pix) select i as pix, coalesce(v, 0::double) as value from range(0, {12 * NSIDE * NSIDE}) t(i) left join up on up.pix = i")
def scatter(spark, sf):
    return maps.scatter(maps.full_sky(spark, NSIDE, 0.0), part_map(spark, sf).groupBy("pix").agg(F.max("value").alias("value")))


@query("on_footprint", f"with {_MAP}, f as (select i // 2 * 3 as pix from range(0, 3000) t(i)), up as (select pix, max(value) as value from map group by pix) select f.pix, value from f left join up using (pix)")
def on_footprint(spark, sf):
    """Gather: a footprint with repeats and pixels without a value."""
    foot = spark.range(3000).select((F.floor(F.col("id") / 2) * 3).alias("pix"))
    return maps.on_footprint(foot, part_map(spark, sf).groupBy("pix").agg(F.max("value").alias("value")))


@query("footprint_sets", f"with {_MAP}, a as (select distinct pix from map), b as (select i as pix from range(0, 12288, 3) t(i)) select * from (select pix, 'union' as kind from (select * from a union select * from b)) union all select pix, 'both' from (select * from a intersect select * from b) union all select pix, 'less' from (select * from a except select * from b)")
def footprint_sets(spark, sf):
    a, b = part_map(spark, sf).select("pix").distinct(), spark.range(0, hp.nside2npix(NSIDE), 3).withColumnRenamed("id", "pix")
    kinds = (("union", a.union(b).distinct()), ("both", a.intersect(b)), ("less", a.subtract(b)))
    out = None
    for kind, x in kinds:
        x = x.withColumn("kind", F.lit(kind))
        out = x if out is None else out.unionAll(x)
    return out


@query("raster", f"with {_CUST}, {_sql_ang2pix('cust', 8, 'c_custkey')}, n as (select i as pix, count(c_custkey) as value from range(0, 768) t(i) left join pixels on pix = i group by 1), cells as (select i % 90 as cx, i // 90 as cy, -180 + (i % 90 + 0.5::double) * 4 as lon, -90 + (i // 90 + 0.5::double) * 4 as lat from range(0, 4050) t(i)), {_sql_ang2pix('cells', 8, 'cx, cy', 'image')} select cx as x, cy as y, pix, value from image join n using (pix)")
def raster(spark, sf):
    density = maps.density_map(customers(spark, sf), maps.full_sky(spark, 8), 8)
    return maps.raster(spark, density.withColumnRenamed("n", "value"), 8, (-180.0, 180.0, -90.0, 90.0), (90, 45))


# ---- self-organizing maps ------------------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def fixed_map(spark: SparkSession, sf: str) -> Som:
    """A 4 x 4 square map whose neurons are the vectors of the 16 smallest ids."""
    rows = vectors(spark, sf).orderBy("vec_id").limit(16).collect()
    return Som(4, 4, len(rows[0].v), "square", np.float64, weights=np.array([x.v for x in rows]))


_BOOK = "v as (select vec_id, label, embedding::double[] as v from embeddings), book as (select (row_number() over (order by vec_id) - 1)::int as neuron, v as w from v order by vec_id limit 16)"
_DIST = f"{_BOOK}, dist as (select vec_id, label, v, neuron, list_distance(v, w) as d from v, book), best as (select vec_id, any_value(label) as label, any_value(v) as v, min({{'d': d, 'k': neuron}}) as m from dist group by vec_id), won as (select vec_id, label, v, m.k as neuron, m.d as d from best)"
_TOP2 = f"{_DIST}, second as (select dist.vec_id, min({{'d': dist.d, 'k': dist.neuron}}) as m from dist join won on dist.vec_id = won.vec_id and dist.neuron <> won.neuron group by 1), two as (select won.vec_id, won.neuron as bmu1, m.k as bmu2, won.d as d1, m.d as d2 from won join second on won.vec_id = second.vec_id)"


@query("som_winners", f"with {_DIST} select vec_id, neuron, round(d, 6) as dist from won")
def som_winners(spark, sf):
    return fixed_map(spark, sf).winners(vectors(spark, sf).select("vec_id", "v"), "v", "neuron", "dist").select("vec_id", "neuron", r("dist").alias("dist"))


@query("som_top2", f"with {_TOP2} select vec_id, bmu1, bmu2, round(d1, 6) as dist1, round(d2, 6) as dist2 from two")
def som_top2(spark, sf):
    return fixed_map(spark, sf).top2(vectors(spark, sf), "v", "vec_id").select("vec_id", "bmu1", "bmu2", r("dist1").alias("dist1"), r("dist2").alias("dist2"))


@query("som_activation", f"with {_DIST} select k::int as neuron, coalesce(sum(label), 0)::double as activation from range(16) t(k) left join won on neuron = k group by k")
def som_activation(spark, sf):
    return fixed_map(spark, sf).activation(vectors(spark, sf), "v", "label")


@query("som_errors", f"with {_TOP2} select round(avg(d1), 6) as quantization_error, round(avg(case when power(bmu1 // 4 - bmu2 // 4, 2) + power(bmu1 % 4 - bmu2 % 4, 2) > 2 then 1 else 0 end), 6) as topographic_error from two")
def som_errors(spark, sf):
    return fixed_map(spark, sf).errors(vectors(spark, sf), "v").select(r("quantization_error").alias("quantization_error"), r("topographic_error").alias("topographic_error"))


@query("som_batch_epoch", f"with {_DIST}, comp as (select neuron, unnest(range(1, len(v) + 1)) as k, unnest(v) as x from won), sums as (select neuron, k, sum(x) as x, count(*) as c from comp group by all), th as (select a.i as neuron, b.i as other, exp(-(power(a.i // 4 - b.i // 4, 2) + power(a.i % 4 - b.i % 4, 2)) / 8) as t from range(16) a(i), range(16) b(i)) select th.neuron::int as neuron, k::int as k, round(sum(t * x) / sum(t * c), 6) as w from th join sums on sums.neuron = other group by all")
def som_batch_epoch(spark, sf):
    som = fixed_map(spark, sf)
    som._batch_epoch(0, 1, vectors(spark, sf), "v", None)
    return spark.createDataFrame([(k, d + 1, round(float(x), 6)) for k, w in enumerate(som.weights) for d, x in enumerate(w)], "neuron int, k int, w double")


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).withColumn("i", F.col("vec_id"))


def _weights(spark: SparkSession, som: Som, digits: int = 6) -> DataFrame:
    return spark.createDataFrame([(k, d + 1, round(float(x), digits) + 0.0) for k, w in enumerate(som.weights) for d, x in enumerate(w)], "neuron int, k int, w double")


_GRID2 = "(power(a.i // 4 - b.i // 4, 2) + power(a.i % 4 - b.i % 4, 2))"


def _sql_epochs(n: int) -> str:
    """CTEs b0 to bn (neuron, w): the map after each epoch of batch training."""
    out = ["b0 as materialized (select neuron, w from book)"]
    for e in range(n):
        sigma = 2.0 / (1 + 2.0 * e / n)
        out.append(
            f"w{e} as (select vec_id, any_value(v) as v, min({{'d': list_distance(v, w), 'k': neuron}}).k as neuron from v, b{e} group by vec_id), "
            f"c{e} as (select neuron, k, sum(x) as x, count(*) as c from (select neuron, unnest(range(1, len(v) + 1)) as k, unnest(v) as x from w{e}) group by all), "
            f"b{e + 1} as materialized (select neuron, list(w order by k) as w from (select a.i::int as neuron, k, sum(exp(-{_GRID2} / {2 * sigma**2}) * x) / sum(exp(-{_GRID2} / {2 * sigma**2}) * c) as w from range(16) a(i), range(16) b(i) join c{e} on c{e}.neuron = b.i group by a.i, k) group by neuron)"
        )
    return ", ".join(out)


@query("som_batch_train", f"with {_BOOK}, {_sql_epochs(3)} select neuron, unnest(range(1, len(w) + 1))::int as k, round(unnest(w), 6) + 0::double as w from b3")
def som_batch_train(spark, sf):
    return _weights(spark, fixed_map(spark, sf).train(vectors(spark, sf), "v", n_epochs=3))


@query("som_batch_iter", f"with {_DIST}, rows as (select vec_id, neuron as best, 2 / (1 + 2 * vec_id / 200.0::double) as s, unnest(range(1, len(v) + 1)) as k, unnest(v) as x from won where vec_id < 200) select a.i::int as neuron, k::int as k, round(sum(exp(-{_GRID2.replace('b.i', 'best')} / (2 * s * s)) * x) / sum(exp(-{_GRID2.replace('b.i', 'best')} / (2 * s * s))), 6) + 0::double as w from range(16) a(i), rows group by a.i, k")
def som_batch_iter(spark, sf):
    return _weights(spark, fixed_map(spark, sf).train(_numbered(spark, sf), "v", n_vectors=200, order="i"))


@query("som_online", f"""with recursive {_BOOK}, numbered as materialized (select row_number() over (order by vec_id) as i, v from v), run as (select 0::bigint as i, (select list(w order by neuron) from book) as ws union all
  select i, list_transform(range(0, 16), lambda a: list_transform(range(1, len(v) + 1), lambda k: ws[a + 1][k] + 0.3 * exp(-(power(a // 4 - best // 4, 2) + power(a % 4 - best % 4, 2)) / 8) * (v[k] - ws[a + 1][k]))) as ws
  from (select n.i, n.v, run.ws, list_position(list_transform(run.ws, lambda w: list_distance(w, n.v)), list_min(list_transform(run.ws, lambda w: list_distance(w, n.v)))) - 1 as best from run join numbered n on n.i = run.i + 1)),
last as (select ws from run order by i desc limit 1), each as (select unnest(range(0, 16))::int as neuron, unnest(ws) as w from last)
select neuron, unnest(range(1, len(w) + 1))::int as k, round(unnest(w), 6) + 0::double as w from each""")
def som_online(spark, sf):
    som = fixed_map(spark, sf)
    som.mode = "online"
    return _weights(spark, som.train(_numbered(spark, sf), "v", n_epochs=1, order="i"))


@query("som_pca", f"with {_SYS}, {_COMPONENTS} select (i * 5 + j)::int as neuron, (va.k + 1)::int as k, round(i / 4.0::double * va.x + j / 4.0::double * vb.x, 6) + 0::double as w from range(5) a(i), range(5) b(j), va join vb using (k)")
def som_pca(spark, sf):
    """Signs of the components are free; here their largest entries are positive."""
    s = systematics(spark, sf).withColumn("v", F.array(*DIMS))
    return _weights(spark, Som(5, 5, 4, "hexagonal", np.float64).train_pca(s, "v", positive=True))


@query("som_hyperparams")
def som_hyperparams(spark, sf):
    best = find_hyperparameters(vectors(spark, sf), "v", 64, 1, topology="square", steps=2)
    return spark.createDataFrame([(best["m"], best["sigma"], best["quantization_error"])], "m int, sigma double, quantization_error double")


@query("som_distance_map", f"with {_BOOK}, e as (select a.neuron, sum(list_distance(a.w, b.w)) as s from book a join book b on a.neuron <> b.neuron and abs(a.neuron // 4 - b.neuron // 4) <= 1 and abs(a.neuron % 4 - b.neuron % 4) <= 1 group by 1) select neuron, round(s / (select max(s) from e), 6) as value from e")
def som_distance_map(spark, sf):
    u = fixed_map(spark, sf).distance_map().ravel()
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(u)], "neuron int, value double")


def _sql_clusters(source: str, n: int, rows: int) -> str:
    """CTEs from ``source`` (neuron, w) to clusters (neuron, cluster): complete linkage, one merge a step."""
    steps = [f"far as materialized (select a.neuron as p, b.neuron as q, list_distance(a.w, b.w) as d from {source} a, {source} b)", f"l0 as materialized (select neuron, neuron as g from {source})"]
    for i in range(rows - n):
        steps.append(f"m{i} as materialized (select a.g as keep, b.g as gone from far join l{i} a on a.neuron = p join l{i} b on b.neuron = q where a.g < b.g group by 1, 2 order by max(d), 1, 2 limit 1)")
        steps.append(f"l{i + 1} as materialized (select neuron, case when g = gone then keep else g end as g from l{i}, m{i})")
    return ", ".join([*steps, f"clusters as materialized (select neuron, (dense_rank() over (order by f) - 1)::int as cluster from (select neuron, min(neuron) over (partition by g) as f from l{rows - n}))"])


@query("cluster_ids", f"with {_BOOK}, {_sql_clusters('book', 5, 16)} select neuron, cluster from clusters")
def cluster_ids(spark, sf):
    som = fixed_map(spark, sf)
    return spark.createDataFrame([(k, int(c)) for k, c in enumerate(cluster.clusterize(som.weights, 5))], "neuron int, cluster int")


@query("cluster_average", "select vec_id, label, round(case when label = 0 then embedding[1]::double else avg(embedding[1]::double) over (partition by label) end, 6) as x from embeddings")
def cluster_average(spark, sf):
    e = vectors(spark, sf).select("vec_id", "label", F.col("v")[0].alias("x"), F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("c"))
    return cluster.average(e, "c", ["x"]).select("vec_id", "label", r("x").alias("x"))


@query("cluster_relabel", "with f as (select label, row_number() over (order by min(vec_id)) - 1 as id from embeddings group by label) select vec_id, id::int as id from embeddings join f using (label)")
def cluster_relabel(spark, sf):
    return cluster.relabel(vectors(spark, sf), "label", "vec_id").select("vec_id", F.col("id").cast("int").alias("id"))


def sky(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("vec_id")
    return vectors(spark, sf).select("vec_id", F.pmod("vec_id", F.lit(12 * 32 * 32)).alias("pix"), "v", (k % 7 + 1).cast("double").alias("density"), F.when(k % 5 == 0, 0.0).otherwise((k % 5 + 5) / 10.0).alias("coverage"))


_GND = f"{_DIST}, sky as (select vec_id, neuron, (vec_id % 7 + 1)::double as density, case when vec_id % 5 = 0 then 0 else (vec_id % 5 + 5) / 10.0::double end as coverage from won), fix as (select *, case when coverage = 0 then 0 else density / coverage end as corrected from sky), g as (select neuron, sum(corrected) as cat, count(*)::double as foot, sum(corrected) / count(*) as gnd from fix group by 1), nb as (select avg(corrected) as m from fix)"


@query("gnd", f"with {_GND} select neuron, round(cat, 6) as cat, foot, round(gnd, 6) as gnd from g")
def gnd(spark, sf):
    c = cleaning.SkyCleaner(sky(spark, sf), 32).use(fixed_map(spark, sf)).compute_gndm()
    return c.table.select("neuron", r("cat").alias("cat"), "foot", r("gnd").alias("gnd"))


@query("gndm_visibility", f"with {_GND} select vec_id, neuron, round(gnd, 6) as gndm, round((corrected - m) / m, 6) as gndc, round((gnd - m) / m, 6) as gndcm, round((1 + (gnd - m) / m) * coverage, 6) as visibility from fix join g using (neuron), nb")
def gndm_visibility(spark, sf):
    out = cleaning.SkyCleaner(sky(spark, sf), 32).use(fixed_map(spark, sf)).compute_gndm().maps()
    return out.select("vec_id", "neuron", *(r(c).alias(c) for c in ("gndm", "gndc", "gndcm", "visibility")))


_BY_CLUSTER = f"{_GND}, {_sql_clusters('book', 4, 16)}, gc as (select cluster, avg(cat) / avg(foot) as gnd from g join clusters using (neuron) group by 1), cmap as (select fix.*, gc.gnd as gndm, (gc.gnd - m) / m as gndcm, (1 + (gc.gnd - m) / m) * coverage as visibility from nb, fix join clusters using (neuron) join gc using (cluster))"


@query("gnd_clustered", f"with {_BY_CLUSTER} select vec_id, neuron, round(gndm, 6) as gndm, round(gndcm, 6) as gndcm, round(visibility, 6) + 0::double as visibility from cmap")
def gnd_clustered(spark, sf):
    """Every neuron of this map has rows, since each is one of the vectors."""
    out = cleaning.SkyCleaner(sky(spark, sf), 32).use(fixed_map(spark, sf)).compute_clustered_gndm(4).maps(clustered=True)
    return out.select("vec_id", "neuron", *(r(c).alias(c) for c in ("gndm", "gndcm", "visibility")))


@query("catalog_rates", f"with {_BY_CLUSTER}, vis as (select fix.vec_id, (1 + (g.gnd - m) / m) * coverage as visibility from nb, fix join g using (neuron)) select fix.vec_id % 12288 as pix, round(2 * fix.density / (select avg(density) from fix), 6) as data, round(2 * fix.coverage, 6) as uniform, round(2 * vis.visibility, 6) + 0::double as visibility, round(2 * cmap.visibility, 6) + 0::double as clustered from fix join vis using (vec_id) join cmap using (vec_id)")
def catalog_rates(spark, sf):
    """Expected objects a pixel of the four kinds of random catalogs."""
    c = cleaning.SkyCleaner(sky(spark, sf), 32).use(fixed_map(spark, sf)).compute_gndm().compute_clustered_gndm(4)
    kinds = ("data", "uniform", "visibility", "clustered")
    return c.rates_by_row(kinds, 2.0).select("pix", *(r(k).alias(k) for k in kinds))


@query("sky_clean")
def sky_clean(spark, sf):
    return cleaning.SkyCleaner(sky(spark, sf), 32).train(3, 3, 64, "square", n_epochs=2).compute_gndm().generate("visibility", 2.0, 5)


# ---- two-point functions -------------------------------------------------------------------------------------------------------

SEP = (30.0, 600.0, 6)


def _points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = pairs.points(customers(spark, sf), F.col("lon"), F.col("lat"), F.col("c_custkey") % 3 + 1, F.col("c_acctbal") / 1000, F.col("c_custkey"))
    s = pairs.points(suppliers(spark, sf), F.col("lon"), F.col("lat"), None, F.col("s_acctbal") / 1000, F.col("s_suppkey"))
    return d, s


def _sql_points(name: str, source: str, key: str, w: str, k: str) -> str:
    return f"{name} as (select {key} as id, cos(radians(lat)) * cos(radians(lon)) as x, cos(radians(lat)) * sin(radians(lon)) as y, sin(radians(lat)) as z, ({w})::double as w, {k} / 1000 as k from {source})"


_P = f"{_CUST}, {_SUPP}, {_sql_points('dd_', 'cust', 'c_custkey', 'c_custkey % 3 + 1', 'c_acctbal')}, {_sql_points('rr_', 'supp', 's_suppkey', '1', 's_acctbal')}"


def _sql_pairs(name: str, a: str, b: str, auto: bool) -> str:
    lo, hi, n = SEP
    return (
        f"{name}s as (select degrees(2 * asin(least(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) / 2, 1))) * 60 as s, a.w * b.w as w, a.w * b.w * a.k * b.k as kk from {a} a join {b} b on abs(a.z - b.z) < 0.2" + (" and a.id < b.id" if auto else "") + "), "
        f"{name} as (select least(floor((ln(s) - ln({lo})) * ({n} / (ln({hi}) - ln({lo})))), {n - 1})::int as bin, count(*) as c, sum(w) as w, sum(w * s) as ws, sum(kk) as kk, sum(w * ln(s)) as wl from {name}s where s >= {lo} and s <= {hi} group by 1)"
    )


_BINS = f"range({SEP[2]}) t(i)"
for _name, _a, _b, _auto in (("dd", "dd_", "dd_", True), ("rr", "rr_", "rr_", True), ("dr", "dd_", "rr_", False), ("rd", "rr_", "dd_", False)):
    query(f"pair_count_{_name}", f"with {_P}, {_sql_pairs('p', _a, _b, _auto)} select i::int as bin, coalesce(c, 0) as npairs, coalesce(w, 0)::double as weight, round(ws / w, 6) as meansep from {_BINS} left join p on bin = i")(
        lambda spark, sf, e=_name: (lambda d, s: pairs.correlation(d, s, *SEP, e).select("bin", "npairs", "weight", r("meansep").alias("meansep")))(*_points(spark, sf))
    )

_XI = f"with {_P}, {_sql_pairs('dd', 'dd_', 'dd_', True)}, {_sql_pairs('rr', 'rr_', 'rr_', True)}, {_sql_pairs('dr', 'dd_', 'rr_', False)}, {_sql_pairs('rd', 'rr_', 'dd_', False)}, n as (select (select 0.5 * (sum(w) * sum(w) - sum(w * w)) from dd_) as d, (select 0.5 * (sum(w) * sum(w) - sum(w * w)) from rr_) as r, (select sum(w) from dd_) * (select sum(w) from rr_) as x), j as (select i, coalesce(dd.w, 0) / n.d as dd, coalesce(rr.w, 0) / n.r as rr, coalesce(dr.w, 0) / x as dr, coalesce(rd.w, 0) / x as rd, dd.ws / dd.w as theta from {_BINS} cross join n left join dd on dd.bin = i left join rr on rr.bin = i left join dr on dr.bin = i left join rd on rd.bin = i) select i::int as bin, round(theta, 6) as theta, 0::double as sigma, round(case when rr <> 0 then ({{}}) / rr end, 6) as xi from j"
for _name, _top in (("peebles_hauser", "dd - rr"), ("landy_szalay_1", "dd - 2 * dr + rr"), ("landy_szalay_2", "dd - dr - rd + rr")):
    query(f"xi_{_name}", _XI.format(_top))(lambda spark, sf, e=_name: pairs.correlation(*_points(spark, sf), *SEP, e).select("bin", r("theta").alias("theta"), "sigma", r("xi").alias("xi")))

for _name, _b, _auto in (("kk_auto", "dd_", True), ("kk_cross", "rr_", False)):
    query(_name, f"with {_P}, {_sql_pairs('p', 'dd_', _b, _auto)} select i::int as bin, round(case when w > 0 then exp(wl / w) else exp(ln({SEP[0]}) + (i + 0.5) * (ln({SEP[1]}) - ln({SEP[0]})) / {SEP[2]}) end, 6) as theta, round(coalesce(kk / w, 0), 6) as xi, 0::double as sigma from {_BINS} left join p on bin = i")(
        lambda spark, sf, a=_auto: (lambda d, s: pairs.scalar_correlation(d, None if a else s, *SEP).select("bin", r("theta").alias("theta"), r("xi").alias("xi"), "sigma"))(*_points(spark, sf))
    )


# ---- random catalogs -------------------------------------------------------------------------------------------------------------


@query("gen_density")
def gen_density(spark, sf):
    ship(spark)
    return generate.catalog(generate.number_density(part_map(spark, sf).groupBy("pix").agg(F.sum("value").alias("value")), NSIDE, 0.002, 7))


@query("gen_uniform")
def gen_uniform(spark, sf):
    ship(spark)
    return generate.catalog(generate.uniform_catalog(part_map(spark, sf).select("pix").distinct(), NSIDE, 2.0, 7))


@query("gen_fullsky")
def gen_fullsky(spark, sf):
    return generate.fullsky_uniform(spark, 16, 2.0, 7)


@query("kernel_add", "select l_orderkey, l_linenumber, l_partkey, l_quantity + l_tax as batch, l_quantity * l_tax as series from lineitem")
def kernel_add(spark, sf):
    """The same kind of kernel in both forms: over whole batches and as a column function."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    product = kernels.kernel("double")(lambda a, b: a * b)
    return kernels.batch_apply(line, lambda a, b: a + b, ["l_quantity", "l_tax"], "batch").select("l_orderkey", "l_linenumber", "l_partkey", "batch", product("l_quantity", "l_tax").alias("series"))


@query("scalar_functions", f"with {_CUST} select c_custkey, round(1 / (1 + 2 * (c_custkey % 10)::double / 10), 6) as decay, round(exp(-(c_custkey % 9)::double / 8), 6) as near, round(1 - power(1 - 0.3::double, c_custkey % 4), 6) as step, round(degrees(acos(greatest(-1, least(1, sin(radians(lat)) * sin(radians(10)) + cos(radians(lat)) * cos(radians(10)) * cos(radians(lon - 20)))))), 4) as sep from cust")
def scalar_functions(spark, sf):
    k = F.col("c_custkey")
    sep = scalars.separation(F.col("lon"), F.col("lat"), F.lit(20.0), F.lit(10.0))
    return customers(spark, sf).select("c_custkey", r(scalars.decay(k % 10, F.lit(10.0))).alias("decay"), r(scalars.neighbourhood((k % 9).cast("double"), F.lit(2.0))).alias("near"), r(scalars.density_step(F.lit(0.3), (k % 4).cast("double"))).alias("step"), r(sep, 4).alias("sep"))


@query("stream_stats", "select event_type as key, count(value) as n, round(avg(value), 6) as mean, round(sqrt(avg(value * value)), 6) as rms, round(stddev_samp(value), 6) as std, min(value) as minimum, max(value) as maximum from events where isfinite(value) group by 1")
def stream_stats(spark, sf):
    """The events table as a stream of files, with sums of each micro-batch kept in the shared folder."""
    import uuid

    from skyloom.streaming.running import RunningStats

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = f"{(shared or '/tmp/checkpoints').rstrip('/')}/skyloom-stream-{uuid.uuid4().hex}"
    rows = table(spark, sf, "events")
    source = spark.readStream.schema(rows.schema)
    a_folder = any("/events.parquet/" in f for f in rows.inputFiles()[:1])
    events = source.parquet(f"{sf}/events.parquet") if a_folder else source.option("pathGlobFilter", "events.parquet").parquet(sf)
    stats_ = RunningStats(spark, f"{base}/state")
    stats_.start(events, "value", f"{base}/checkpoint", "event_type").awaitTermination()
    out = stats_.result()
    return out.select("key", "n", r("mean").alias("mean"), r("rms").alias("rms"), r("std").alias("std"), "minimum", "maximum")


__all__ = ["QUERIES", "SQL"]
