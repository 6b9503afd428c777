import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import healpix as hp
from skyloom.operators import generate, maps, pairs


@pytest.mark.parametrize("nside", [1, 2, 4, 32, 256])
def test_centers_and_inner_points_come_back(spark, nside):
    n = hp.nside2npix(nside)
    df = spark.range(0, n, max(1, n // 3000)).withColumnRenamed("id", "p")
    for u, v in ((0.5, 0.5), (0.1, 0.83)):
        lon, lat = hp.pix2ang(nside, F.col("p"), u, v)
        assert df.select("p", hp.ang2pix(nside, lon, lat).alias("q"), hp.ang2pix(nside, lon - 360, lat).alias("s")).filter("p != q or p != s").count() == 0
    x, y, f = hp.nest2xyf(nside, F.col("p"))
    assert df.select("p", hp.xyf2nest(nside, x, y, f).alias("q")).filter("p != q").count() == 0


def test_mosaic_of_faces(spark):
    x, y = hp.pix2global(1, F.col("id"))
    rows = spark.range(12).coalesce(1).select(x, y).collect()
    assert [tuple(r) for r in rows] == [(k % 4, k // 4) for k in range(12)]


@pytest.mark.parametrize("nside", [1, 2, 8])
def test_ring_order_is_a_permutation_by_rings(spark, nside):
    n = hp.nside2npix(nside)
    nest = spark.range(n).select(F.col("id").alias("ring"), hp.ring2nest(nside, F.col("id")).alias("p"))
    lon, lat = hp.pix2ang(nside, F.col("p"))
    rows = nest.select("ring", "p", F.round(lat, 9).alias("lat"), F.pmod(lon, F.lit(360.0)).alias("lon")).orderBy("ring").collect()
    assert sorted(r.p for r in rows) == list(range(n))
    assert [(-r.lat, r.lon) for r in rows] == sorted((-r.lat, r.lon) for r in rows)


def test_numbers():
    assert hp.nside2npix(4) == 192 and hp.npix2nside(192) == 4
    assert math.isclose(hp.nside2pixarea(2) * 48, 4 * math.pi)
    assert math.isclose(hp.nside2resol(8), math.sqrt(hp.nside2pixarea(8)))


def test_nuniq_at_every_order(spark):
    rows = [(o, i) for o in range(20) for i in (0, 12 * 4**o - 1)]
    df = spark.createDataFrame(rows, "o int, i long").withColumn("u", hp.order_index2nuniq(F.col("o"), F.col("i")))
    o, i = hp.nuniq2order_index(F.col("u"))
    assert df.filter((o != F.col("o")) | (i != F.col("i"))).count() == 0


def test_moc(spark):
    cells = spark.createDataFrame([(0, 3, 0.5), (2, 1, 1.0)], "ord int, idx long, w double")
    got = maps.moc_expand(cells, 2).select("w", "pix").collect()
    assert sorted((r.w, r.pix) for r in got) == [(0.5, p) for p in range(48, 64)] + [(1.0, 1)]
    with pytest.raises(Exception, match="finer"):
        maps.moc_expand(cells, 1).collect()


def test_ud_grade(spark):
    nan, unseen = math.nan, -1.6375e30
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, nan), (3, unseen), (4, 0.0), (5, 2.0)], "pix long, value double")
    got = lambda **k: {r.pix: r.value for r in maps.ud_grade(df, 2, 1, **k).collect()}
    assert got(mode="arith") == {0: 2.0, 1: 1.0}
    assert got(mode="arith", ignore_zeros=True) == {0: 2.0, 1: 2.0}
    assert got(mode="sum", ignore_zeros=True) == {0: 8.0, 1: 4.0}
    assert np.isclose(got(mode="quad")[0], math.sqrt(5))
    assert np.isclose(got(mode="log")[0], math.log10((10 + 1000) / 2))
    assert np.isclose(got(mode="logquad")[0], math.log10(math.sqrt((100 + 1e6) / 2)))
    assert maps.ud_grade(df, 2, 2) is df
    with pytest.raises(NotImplementedError):
        maps.ud_grade(df, 2, 4)


def test_box_across_the_meridian(spark):
    near = spark.createDataFrame([(0,)], "pix long")
    lon, lat = hp.pix2ang(16, F.col("pix"))
    foot = spark.range(hp.nside2npix(16)).withColumnRenamed("id", "pix").filter((F.abs(lat) < 5) & ((F.pmod(lon, F.lit(360.0)) > 350) | (F.pmod(lon, F.lit(360.0)) < 10)))
    box = maps.bounding_box(foot, 16).first()
    assert abs(box.lon_center) < 1 and -11 < box.lon_min < -5 and 5 < box.lon_max < 11 and near.count() == 1


def test_pairs_match_brute_force(spark):
    rng = np.random.default_rng(2)
    lon, lat = rng.uniform(0, 40, 700), np.degrees(np.arcsin(rng.uniform(-0.9, 1, 700)))
    w = rng.uniform(0.5, 2, 700)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(lon, lat, w, strict=True))], "i long, lon double, lat double, w double")
    p = pairs.points(df, F.col("lon"), F.col("lat"), F.col("w"), F.col("w"), F.col("i"))
    a, b = np.radians(lon), np.radians(lat)
    v = np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], 1)
    sep = np.degrees(2 * np.arcsin(np.minimum(np.linalg.norm(v[:, None] - v[None], axis=-1) / 2, 1))) * 60
    i, j = np.triu_indices(700, 1)
    keep = (sep[i, j] >= 20) & (sep[i, j] <= 500)
    k = np.minimum(np.floor(np.log(sep[i, j][keep] / 20) * 5 / np.log(25)), 4).astype(int)
    got = pairs.pair_counts(p, None, 20, 500, 5).orderBy("bin").collect()
    assert [r.npairs for r in got] == np.bincount(k, minlength=5).tolist()
    kk = pairs.scalar_correlation(p, None, 20, 500, 5).orderBy("bin").collect()
    ww = (w[i] * w[j])[keep]
    assert np.allclose([r.xi for r in kk], np.bincount(k, ww * ww, 5) / np.bincount(k, ww, 5))
    assert "NestedLoop" not in pairs.pairs(p, None, 20, 500)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        pairs.correlation(p, None, 20, 500, 5, "peebles_hauser")
    # a pair of catalogs: every kind of count in one join, against one count each
    q = pairs.points(df.filter("i % 3 = 0"), F.col("lon") + 1, F.col("lat") * 0.9, F.col("w"), None, F.col("i"))
    dd, rr, dr = (pairs.pair_counts(*x, 20, 500, 5).orderBy("bin").collect() for x in ((p, None), (q, None), (p, q)))
    sums = [(sum(r.w for r in x.collect()), sum(r.w**2 for r in x.collect())) for x in (p, q)]
    own = [0.5 * (s * s - s2) for s, s2 in sums]
    cross = sums[0][0] * sums[1][0]
    for name, form in (("peebles_hauser", lambda a, b, c: (a - b) / b), ("landy_szalay_1", lambda a, b, c: (a - 2 * c + b) / b), ("landy_szalay_2", lambda a, b, c: (a - 2 * c + b) / b)):
        got_ = pairs.correlation(p, q, 20, 500, 5, name).orderBy("bin").collect()
        assert np.allclose([r.xi for r in got_], [form(a.weight / own[0], b.weight / own[1], c.weight / cross) for a, b, c in zip(dd, rr, dr, strict=True)])
    assert [r.npairs for r in pairs.pair_counts(q, p, 20, 500, 5).orderBy("bin").collect()] == [r.npairs for r in dr]
    assert pairs.on_sky(4, spark.range(192), "id").count() == 192


def test_published_draws(golden):
    for name, got in (("density", generate.sequential(1, list(range(12)), [float(k) for k in range(12)], 0)), ("uniform", generate.sequential(1, list(range(12)), [2.0] * 12, 0)), ("full_sky", generate.sequential_fullsky(1, 2, 0))):
        assert np.asarray(got).shape == golden[name].shape and np.allclose(got, golden[name], atol=2e-6), name


def test_catalogs_don_t_depend_on_partitions(spark):
    m = spark.range(48).select(F.col("id").alias("pix"), F.lit(3.0).alias("value"))
    rows = [sorted(map(tuple, generate.number_density(m.repartition(n), 2, 2.0, 9).collect())) for n in (1, 7)]
    assert rows[0] == rows[1] and 180 < len(rows[0]) < 400
    back = generate.number_density(m, 2, 2.0, 9).filter(hp.ang2pix(2, F.col("lon"), F.col("lat")) != F.col("pix"))
    assert back.count() == 0
    assert list(generate.batches([3, 4, 9, 1], 7)) == [(0, 2), (2, 3), (3, 4)]
