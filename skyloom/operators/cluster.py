"""Complete-linkage clusters of the few vectors of a map (driver), and cluster means of any number of rows (window)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clusterize(vectors: np.ndarray, n_clusters: int) -> np.ndarray:
    """Cluster ids by first appearance, -1 for rows with NaN; merges the two clusters of least diameter until ``n_clusters`` are left."""
    v = np.asarray(vectors, float).reshape(len(vectors), -1)
    ids = np.full(len(v), -1)
    rows = np.flatnonzero(~np.isnan(v).any(1))
    if not len(rows):
        return ids
    d = np.sqrt(((v[rows][:, None] - v[rows][None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    group, alive = np.arange(len(rows)), len(rows)
    while alive > max(1, min(n_clusters, len(rows))):
        a, b = sorted(divmod(int(d.argmin()), len(rows)))
        far = np.maximum(d[a], d[b])
        d[a], d[:, a] = far, far
        d[b], d[:, b] = np.inf, np.inf
        d[a, a] = np.inf
        group[group == b] = a
        alive -= 1
    seen: dict[int, int] = {}
    ids[rows] = [seen.setdefault(int(g), len(seen)) for g in group]
    return ids


def average(df: DataFrame, cluster: str, values: list[str]) -> DataFrame:
    """Each value replaced by its cluster's mean; rows of cluster -1 stay. Means come from partial sums and a join, not from a window."""
    means = df.filter(F.col(cluster) >= 0).groupBy(cluster).agg(*(F.avg(v).alias(f"_m{k}") for k, v in enumerate(values)))
    out = df.join(means, cluster, "left")
    return out.select(*(F.coalesce(f"_m{values.index(c)}", c).alias(c) if c in values else c for c in df.columns))


def relabel(df: DataFrame, cluster: str, row: str, into: str = "id") -> DataFrame:
    """Ids 0, 1, ... by the first row of each cluster; -1 stays."""
    firsts = df.filter(F.col(cluster) >= 0).groupBy(cluster).agg(F.min(row).alias("_f"))
    ranks = firsts.select(cluster, (F.row_number().over(Window.orderBy("_f")) - 1).alias(into))  # a row a cluster
    return df.join(ranks, cluster, "left").withColumn(into, F.coalesce(into, F.lit(-1)))


def borders(m: int, n: int, ids: np.ndarray, topology: str = "square") -> list[tuple[int, int]]:
    """Pairs of adjacent neurons in different clusters."""
    from skyloom.operators.som import Som

    return [(a, b) for a, b in Som(m, n, 2, topology).neighbours() if a < b and ids[a] != ids[b]]


def label_centroids(m: int, n: int, ids: np.ndarray) -> list[tuple[int, float, float]]:
    """(cluster, mean i, mean j) of each connected region of the m x n grid."""
    grid, out, seen = np.asarray(ids).reshape(m, n), [], np.zeros((m, n), bool)
    for i, j in np.ndindex(m, n):
        if seen[i, j]:
            continue
        line, seen[i, j] = [(i, j)], True
        for a, b in line:
            for x, y in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= x < m and 0 <= y < n and not seen[x, y] and grid[x, y] == grid[i, j]:
                    seen[x, y] = True
                    line.append((x, y))
        mean = np.mean(line, 0)
        out.append((int(grid[i, j]), float(mean[0]), float(mean[1])))
    return out
