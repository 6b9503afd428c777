import numpy as np
import pytest

from skyloom.operators.cluster import average, clusterize, label_centroids
from skyloom.operators.som import Som
from skyloom.plans.cleaning import SkyCleaner
from skyloom.sources import models


def frame(spark, x):
    return spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "i long, v array<double>").repartition(3)


@pytest.fixture(scope="module")
def thousand(spark):
    return frame(spark, np.random.default_rng(0).random((1000, 4), np.float32)).cache()


def square():
    return Som(4, 4, 4, "square").init_rand(0)


def test_distance_map():
    want = [[0.26441127, 0.61138950, 0.52692540, 0.22971392], [0.52755773, 0.72621530, 0.66814790, 0.47758296], [0.48859516, 0.66861326, 1.0, 0.47632787], [0.22816606, 0.53763765, 0.40897673, 0.29011133]]
    assert np.allclose(square().distance_map(), want)
    with pytest.raises(ValueError):
        square().distance_map("median")


def test_activation(spark):
    x = np.random.default_rng(0).random((25000, 4), np.float32)
    got = [r.activation for r in square().activation(frame(spark, x), "v").orderBy("neuron").collect()]
    assert got == [3494, 526, 911, 1281, 4331, 565, 1083, 1088, 1642, 3369, 1300, 963, 1898, 378, 625, 1546]


def test_winners(spark):
    x = np.random.default_rng(0).random((8, 4), np.float32)
    assert [r.neuron for r in square().winners(frame(spark, x), "v").orderBy("i").collect()] == list(range(8))
    nan = frame(spark, [[np.nan] * 4])
    assert square().winners(nan, "v").first().neuron == 0


def test_published_maps(thousand, golden):
    for mode in ("batch", "online"):
        for name, how in (("epoch", {"n_epochs": 1}), ("rows", {"n_vectors": 1000})):
            som = square()
            som.mode = mode
            som.train(thousand, "v", order="i", **how)
            assert np.allclose(som.centroids, golden[f"{mode}_{name}"], rtol=1e-4, atol=2e-6), (mode, name)
            assert len(som.quantization_errors) == 1


def test_online_matches_plain_loop(spark):
    x = np.random.default_rng(1).random((60, 3))
    som = Som(3, 2, 3, "hexagonal", np.float64, "online").init_rand(4)
    w, t = som.weights.copy(), som.topography
    for i, v in enumerate(x):
        k = 1 / (1 + 2 * i / 60)
        best = ((w - v) ** 2).sum(1).argmin()
        w += 0.3 * k * np.exp(-((t - t[best]) ** 2).sum(1) / (2 * (1.5 * k) ** 2))[:, None] * (v - w)
    assert np.allclose(som.train(frame(spark, x), "v", n_vectors=60, order="i").weights, w)
    with pytest.raises(ValueError):
        som.train(frame(spark, x), "v")


def test_pca(spark, golden):
    som = Som(4, 4, 4, "square").train_pca(frame(spark, np.random.default_rng(0).random((25000, 4), np.float32)), "v", min_weight=-1.0, max_weight=1.0, scale_by_variance=False)
    assert np.allclose(som.cov_matrix, golden["covariance"], atol=1e-6)

    def same(got, want):
        """Up to the signs of the two components, which are free: a sign turns the grid around."""
        return any(np.allclose(x, want, atol=1e-5) for x in (got, got[::-1], got[:, ::-1], got[::-1, ::-1]))

    assert same(som.centroids, golden["pca"])
    assert same(Som(4, 4, 4, "square").train_from_cov(som.cov_matrix, -1.0, 1.0, True, True).centroids, golden["pca_cdf"])
    assert np.allclose(Som(2, 2, 4).train_from_cov(som.cov_matrix, positive=True).weights[3], Som(2, 2, 4).train_from_cov(som.cov_matrix, scale_by_variance=False, positive=True).weights[3])
    cdf = Som(4, 4, 4, "square").train_from_cov(som.cov_matrix, apply_cdf=True)
    assert 0 < cdf.weights.min() < cdf.weights.max() < 1


def test_save_and_load(spark, tmp_path):
    som = square()
    som.quantization_errors = [0.5]
    models.save_som(spark, som, str(tmp_path / "som"))
    back = models.load_som(spark, str(tmp_path / "som"))
    assert np.array_equal(back.weights, som.weights) and (back.topology, back.dtype, back.sigma) == (som.topology, som.dtype, som.sigma)
    chunks = models.from_chunks(spark, lambda: lambda: iter([np.ones((2, 3)), np.zeros((1, 3))]), str(tmp_path / "chunks"))
    assert [(r.row_id, r.v[0]) for r in chunks.orderBy("row_id").collect()] == [(0, 1.0), (1, 1.0), (2, 0.0)]
    again = models.from_chunks(spark, lambda: lambda: iter([np.ones((2, 3)), np.zeros((1, 3))]), str(tmp_path / "chunks"))
    assert again.count() == 3  # a second run replaces the first one


def test_clusters(spark):
    x = np.random.default_rng(0).random((10, 10))
    assert clusterize(x, 10).tolist() == list(range(10))
    x = np.array([[0.0], [10.0], [0.2], [np.nan], [10.1], [5.0]])
    assert clusterize(x, 3).tolist() == [0, 1, 0, -1, 1, 2]
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (-1, 7.0)], "c int, x double")
    assert sorted(r.x for r in average(df, "c", ["x"]).collect()) == [2.0, 2.0, 7.0]
    assert label_centroids(2, 2, np.array([0, 0, 1, 0])) == [(0, pytest.approx(1 / 3), pytest.approx(2 / 3)), (1, 1.0, 0.0)]


def test_cleaning(spark):
    rng = np.random.default_rng(8)
    rows = [(p, [float(t) for t in rng.random(2)], float(p % 3 + 1), 0.0 if p == 5 else 0.5) for p in range(192)]
    df = spark.createDataFrame(rows, "pix long, v array<double>, density double, coverage double")
    c = SkyCleaner(df, 4).train(2, 2, 2, "square", n_epochs=2).compute_gndm()
    out = c.maps().collect()
    cat = {r.neuron: r.gnd for r in c.table.collect()}
    assert len(out) == 192 and all(abs(r.gndm - cat[r.neuron]) < 1e-9 for r in out)
    total = sum(r.corrected for r in out)
    mean = total / 192
    assert all(abs(r.visibility - (1 + (r.gndm - mean) / mean) * r.coverage) < 1e-9 for r in out)
    visible = {r.pix: r.visibility for r in out}
    assert c.compute_clustered_gndm(2).maps(clustered=True).count() == 192 and c.maps().count() == 192
    want = {"uniform": {r.pix: 2 * r.coverage for r in out}, "visibility": {p: 2 * v for p, v in visible.items()}, "data": {r.pix: 2 * r.density / np.mean([x.density for x in out]) for r in out}}
    for kind, rates in want.items():
        assert all(abs(r.value - rates[r.pix]) < 1e-9 for r in c.rates(kind, 2.0).collect()), kind
        n, mean = c.generate(kind, 2.0, 1).count(), sum(max(x, 0) for x in rates.values())
        assert abs(n - mean) < 5 * mean**0.5, kind
    assert c.generate("clustered", 2.0, 1).columns == ["ra", "dec"]
    with pytest.raises(ValueError):
        c.rates("other", 2.0)


def test_a_pipeline_comes_back(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(p, [float(t) for t in rng.random(3)], float(p % 3 + 1), 0.5) for p in range(192)]
    df = spark.createDataFrame(rows, "pix long, sys array<double>, n double, cover double")
    c = SkyCleaner(df, 4, "sys", "n", "cover").train(2, 2, 3, "square", n_epochs=1).compute_gndm()
    c.som.cov_matrix, c.som.eigenvalues, c.som.eigenvectors = np.eye(3), np.ones(3), np.eye(3)
    models.save_cleaner(c, str(tmp_path / "sky"))
    back = models.load_cleaner(spark, str(tmp_path / "sky"))
    key = lambda rows: sorted((r.pix, r.neuron, round(r.visibility, 9), tuple(r.sys)) for r in rows)
    assert key(back.maps().collect()) == key(c.maps().collect()) and back.nside == 4
    assert np.array_equal(back.som.weights, c.som.weights) and np.array_equal(back.som.eigenvectors, np.eye(3))
    with pytest.raises(ValueError):
        models.save_cleaner(SkyCleaner(df, 4, "sys", "n", "cover"), str(tmp_path / "none"))


def test_cells_and_borders():
    from skyloom.operators.cluster import borders

    for topology in ("square", "hexagonal"):
        cells = Som(3, 2, 2, topology).cells()
        assert [k for k, *_ in cells] == list(range(6)) and all(len(c) == (4 if topology == "square" else 6) for *_, c in cells)
        assert all(abs(np.mean([y for y, _ in c]) - y0) < 1e-9 and abs(np.mean([x for _, x in c]) - x0) < 1e-9 for _, y0, x0, c in cells)
        ids = np.array([0, 0, 0, 1, 1, 1])
        around = Som(3, 2, 2, topology).neighbours()
        assert borders(3, 2, ids, topology) == [(a, b) for a, b in around if a < b and ids[a] != ids[b]] != []
