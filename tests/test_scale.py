"""Faults that show on larger tables only, on small ones made like them."""

import math
import math
import os
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skyloom import queries
from skyloom.operators import pairs
from skyloom.operators.som import Som, distances, nearest

SF = "/root/testdata/sf0.001"


def plain(rows):
    return Counter(tuple(f"{x:.8g}" for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_catalog_rates_keep_rows_that_share_a_pixel(spark, tmp_path):
    t = pq.read_table(f"{SF}/embeddings.parquet").slice(0, 40)
    ids = t["vec_id"].to_numpy()
    both = pa.concat_tables([t, t.set_column(t.column_names.index("vec_id"), "vec_id", pa.array(ids + 12 * 32 * 32))])
    pq.write_table(both, tmp_path / "embeddings.parquet")
    df = queries.QUERIES["catalog_rates"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    rel = con.execute(queries.SQL["catalog_rates"])
    names = [d[0] for d in rel.description]
    got = plain(df.select(*names).collect())
    assert sum(got.values()) == 80 and got == plain(rel.fetchall())


def test_pair_sums_of_whole_blocks_and_many_passes(spark):
    """Dense points on a curve, so that most blocks are far away; ids that are repeated or missing are no pair with their like."""
    rng = np.random.default_rng(4)
    n = 2400
    lon, lat = np.sort(rng.uniform(0, 25, n)), rng.normal(0, 1e-3, n)
    w, v, ids = rng.integers(1, 4, n).astype(float), rng.uniform(-1, 9, n), [int(i) for i in range(n)]
    a, b = np.radians(lon), np.radians(lat)
    xyz = np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], 1)
    i, j = np.triu_indices(n, 1)
    sep = np.degrees(2 * np.arcsin(np.sqrt(((xyz[i] - xyz[j]) ** 2).sum(1)) / 2)) * 60
    for some in (ids, [None if k == 5 else 7 if k in (9, n - 9) else k for k in ids]):
        df = spark.createDataFrame([(k, *map(float, x), float(p), float(q)) for k, x, p, q in zip(some, xyz, w, v, strict=True)], "id long, px double, py double, pz double, w double, k double")
        one = np.array([k is not None for k in some])
        name = np.array([-1 if k is None else k for k in some])
        keep = (sep >= 30) & (sep <= 600) & one[i] & one[j] & (name[i] != name[j])
        bins = np.floor(np.log(sep[keep] / 30) * (6 / np.log(20))).astype(int)
        ww = (w[i] * w[j])[keep]
        for log, f in ((False, sep), (True, np.log(sep))):
            got = pairs.binned(df, None, 30.0, 600.0, 6, log=log, pass_bytes=600 * pairs.POINT_BYTES).orderBy("bin").collect()
            assert [r.npairs for r in got] == np.bincount(bins, minlength=6).tolist()
            assert [r.weight for r in got] == np.bincount(bins, ww, 6).tolist()
            assert np.allclose([r.kk for r in got], np.bincount(bins, ww * (v[i] * v[j])[keep], 6), rtol=1e-11)
            assert np.allclose([r.ws for r in got], np.bincount(bins, ww * f[keep], 6), rtol=1e-12)
    dr = pairs.pair_counts(df, df, 30.0, 600.0, 6).orderBy("bin").collect()  # between catalogs ids don't matter
    every = (sep >= 30) & (sep <= 600)
    assert sum(r.npairs for r in dr) == 2 * int(every.sum())


@pytest.mark.parametrize("topology", ["square", "hexagonal"])
def test_large_maps_need_no_matrix_of_neurons(spark, topology):
    rng = np.random.default_rng(6)
    som = Som(7, 10, 3, topology)
    t, sums = som.topography, rng.normal(size=(70, 4))
    theta = np.exp(-((t[:, None] - t[None]) ** 2).sum(-1) / (2 * 1.7**2))
    assert np.allclose(som._spread(sums, 1.7), theta @ sums, rtol=1e-12, atol=1e-12)
    # more than SMALL_BOOK neurons, with equal ones, rows that are neurons, and rows of NaN
    book = rng.normal(size=(70, 3)).round(1)
    book[40], book[63] = book[3], book[3]
    v = np.concatenate([book, rng.normal(size=(500, 3)), [[math.nan, 0, 0]]])
    d = distances(v, book)
    want = np.argsort(d, 1, kind="stable")[:, :2]
    for k in (1, 2):
        order, near = nearest(v, book, k)
        assert (order == want[:, :k]).all() and np.allclose(near, np.take_along_axis(d, order, 1), rtol=1e-14, atol=0)
    som.weights = book.astype(np.float32)
    rows = spark.createDataFrame([(x.tolist(),) for x in v], "v array<double>")
    far = ((t[:, None] - t[None]) ** 2).sum(-1) > (2 if topology == "square" else 1) + 1e-6
    d = distances(v, som.weights.astype(float))
    two = np.argsort(d, 1, kind="stable")[:-1, :2]
    assert np.isclose(som.errors(rows, "v").first().topographic_error, far[two[:, 0], two[:, 1]].mean())
    # an epoch of 3,600 neurons; a matrix of them has 104 MB
    large = Som(60, 60, 3, topology).init_rand(1)
    tracemalloc.start()
    large._batch_epoch(0, 1, rows, "v", None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20 and np.isfinite(large.weights).all()
