import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import binning, dataset, stats


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3))
    x[:, 2] = np.round(x[:, 2])
    x[100:200, 0] = np.nan
    return x


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(data)], "i long, s0 double, s1 double, s2 double").repartition(5)


DIMS = ["s0", "s1", "s2"]


def test_global_stats_skip_rows_with_nan(frame, data):
    ok = data[np.isfinite(data).all(1)]
    for r in binning.global_stats(frame, DIMS).collect():
        x = ok[:, r.dim]
        assert r.n == 2900 and np.allclose((r.minimum, r.maximum, r.mean, r.rms, r["std"]), (x.min(), x.max(), x.mean(), np.sqrt((x**2).mean()), x.std(ddof=1)))


def test_exact_bins_are_array_split(frame, data):
    ok = data[np.isfinite(data).all(1)]
    rows = binning.exact_bins(frame, DIMS, 7).orderBy("dim", "bin").collect()
    for d in range(3):
        parts = np.array_split(np.sort(ok[:, d]), 7)
        own = [r for r in rows if r.dim == d]
        assert [r.n for r in own] == [len(p) for p in parts]
        assert np.allclose([r.center for r in own], [p.mean() for p in parts])
        assert np.allclose([r.lo for r in own], [p[0] for p in parts])


def test_exact_and_approximate_edges_agree(frame):
    a = binning.collected_edges(binning.equal_area_binning(frame, ["s1"], 10, exact=True).edges)
    b = binning.collected_edges(binning.equal_area_binning(frame, ["s1"], 10, n_temp_bins=4000).edges)
    assert np.allclose(a, b, atol=2e-2) and (np.diff(b[0]) >= 0).all()


def test_binning_errors(frame, spark):
    for kw in ({"n_bins": 0}, {"n_bins": 5000, "exact": True}, {"n_bins": 10, "n_temp_bins": 3}):
        with pytest.raises(ValueError):
            binning.equal_area_binning(frame, DIMS, **kw)
    with pytest.raises(ValueError):
        binning.equal_area_binning(frame.limit(0), DIMS, 3)


def test_constant_dimension(spark):
    df = spark.range(20).select(F.lit(3.0).alias("c"), F.col("id").cast("double").alias("x"))
    b = binning.equal_area_binning(df, ["c", "x"], 4, n_temp_bins=64)
    assert binning.collected_edges(b.edges)[0] == [3.0] * 5
    assert {r.center for r in b.centers.filter("dim = 0").collect()} == {3.0}


def test_covariance(frame, data, spark):
    ok = data[np.isfinite(data).all(1)]
    assert np.allclose(stats.as_matrix(stats.covariance(frame, DIMS)), np.cov(ok.T))
    w = (np.arange(len(data)) % 4).astype(float)
    keep = np.isfinite(data).all(1) & (w > 0)
    weighted = frame.withColumn("w", (F.col("i") % 4).cast("double"))
    assert np.allclose(stats.as_matrix(stats.covariance(weighted, DIMS, "w", 0)), np.cov(data[keep].T, fweights=w[keep].astype(int), ddof=0))
    arrays = weighted.withColumn("v", F.array(*DIMS))
    assert np.allclose(stats.covariance_of_vectors(arrays, "v", 3, "w", 1), np.cov(data[keep].T, fweights=w[keep].astype(int), ddof=1))
    with pytest.raises(ValueError):
        stats.covariance(frame, DIMS, ddof=-1)


def test_regression(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = 2 * x[:, 0] - x[:, 1] + 0.5 + 0.1 * rng.normal(size=400)
    df = spark.createDataFrame([(i % 5, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "c int, a double, b double, y double")
    model = stats.LinearRegression(["a", "b"]).train(df, "y")
    want = np.linalg.lstsq(np.c_[np.ones(400), x], y, rcond=None)[0]
    assert np.allclose([model.intercept, *model.weights], want)
    gd = stats.LinearRegression(["a", "b"], alpha=0.3, tolerance=1e-12).train(df, "y", n_epochs=3000, analytic=False)
    assert np.allclose(gd.weights, model.weights, atol=1e-6)
    keep = ~np.isin(np.arange(400) % 5, [1, 2])
    assert np.isclose(model.rmse(df, "y", "c", 5, [1, 2]).first()[0], np.sqrt(((y - np.c_[np.ones(400), x] @ want)[keep] ** 2).mean()))
    assert model.rmse(df.limit(0), "y").first()[0] == float("inf")


def test_interpolation_extends(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (1.5,), (9.0,)], "x double").coalesce(1)
    got = [r[0] for r in df.select(stats.interpolate(F.col("x"), [0.0, 1.0, 2.0], [0.0, 2.0, 3.0])).collect()]
    assert np.allclose(got, [-2.0, 1.0, 2.5, 10.0])


def test_dataset_algebra(spark):
    df = spark.createDataFrame([(1, 4.0, 2.0), (2, 1.0, 0.0)], "i int, a double, b double").coalesce(1)
    assert [r.q for r in dataset.ds_divide(df, "a", "b", "q").collect()] == [2.0, 0.0]
    assert [r.q for r in dataset.ds_vector(df.selectExpr("array(a, b) as u", "array(b, a) as v"), "/", "u", "v", "q").collect()] == [[2.0, 0.5], [0.0, 0.0]]
    assert dataset.zip_join(df.select("i", "a"), df.select("i", "b"), "i").count() == 2
    with pytest.raises(Exception, match="aligned"):
        dataset.zip_join(df.select("i", "a"), df.filter("i = 1").select("i", "b"), "i").collect()
    assert [tuple(r) for r in dataset.batch_ranges(spark, 10, 4).orderBy("start").collect()] == [(0, 4), (4, 8), (8, 10)]
