"""Self-organizing maps. Data stay in Spark: a pass broadcasts the codebook (its size is checked) and each task returns sums per neuron.

Within an epoch the neighbourhood depends on a row's best neuron alone, so rows are summed by best neuron and the neighbourhood matrix is applied
to these sums on the driver: an epoch shuffles neurons x (dim + 1) numbers a task, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import stats
from skyloom.shipping import ship

EPS = 1e-12
MOST_CODEBOOK_BYTES = 64 << 20
#: Neurons up to which all distances are computed one neuron after the other, and numbers of a block of distances beyond.
SMALL_BOOK, BLOCK_NUMBERS = 64, 1 << 20
#: Neurons whose sums are one row of an epoch.
ROWS = 1024
_HEX = {0: ((1, 0), (-1, 0), (0, 1), (0, -1), (-1, 1), (-1, -1)), 1: ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1))}
#: The stencil that the reference uses on hexagonal lattices: by its published row parity, not by the lattice's offsets.
_HEX_PARITY = {0: ((1, 1), (1, 0), (1, -1), (0, -1), (-1, 0), (0, 1)), 1: ((0, 1), (1, 0), (0, -1), (-1, -1), (-1, 0), (-1, 1))}
_SQUARE = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)


def decay(e: float, n: float) -> float:
    return 1.0 / (1.0 + 2.0 * e / n)


def lattice(m: int, n: int, topology: str | None) -> np.ndarray:
    """Places of neurons: (i, j) on squares, columns shifted by half a step and sqrt(3)/2 apart on hexagons."""
    i, j = np.divmod(np.arange(m * n), n)
    if topology == "square":
        return np.stack([i, j], 1).astype(float)
    return np.stack([i + 0.5 * (j & 1), j * math.sqrt(3) / 2], 1)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    if column.null_count:
        column = pa.array([x if x is not None else [math.nan] * dim for x in column.to_pylist()], pa.list_(pa.float64()))
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return v


def distances(v: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Squared distances rows x neurons in blocks of rows; NaN becomes infinite, so that the first neuron wins where all are."""
    out = np.empty((len(v), len(codebook)))
    for k, c in enumerate(codebook):
        out[:, k] = ((v - c) ** 2).sum(1)
    out[np.isnan(out)] = np.inf
    return out


def nearest(v: np.ndarray, codebook: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k (1 or 2) neurons of least squared distance for each row, lowest numbers first among equals, and these distances. Large codebooks go by
    blocks of rows through a matrix product; all neurons that its rounding leaves in question are compared as distances() does."""
    if len(codebook) <= SMALL_BOOK:
        d = distances(v, codebook)
        order = d.argmin(1)[:, None] if k == 1 else np.argsort(d, 1, kind="stable")[:, :k]
        return order, np.take_along_axis(d, order, 1)
    order, near = np.empty((len(v), k), np.int64), np.empty((len(v), k))
    norm = (codebook**2).sum(1)
    step = max(1, BLOCK_NUMBERS // len(codebook))
    for lo in range(0, len(v), step):
        x = v[lo : lo + step]
        d = x @ (codebook * -2).T
        d += norm
        kth = np.partition(d, k - 1, 1)[:, k - 1]
        slack = 1e-12 * ((x**2).sum(1) + norm.max())
        row, col = np.nonzero(d <= (kth + slack)[:, None])
        exact = ((x[row] - codebook[col]) ** 2).sum(1)
        by = np.lexsort((col, exact, row))
        first = np.searchsorted(row[by], np.arange(len(x)))
        odd = ~np.isfinite(kth) | (np.diff(np.append(first, len(row))) < k)
        for i in range(k):
            at = by[np.minimum(first + i, max(0, len(by) - 1))] if len(by) else np.zeros(len(x), int)
            order[lo : lo + step, i] = col[at] if len(by) else 0
            near[lo : lo + step, i] = exact[at] if len(by) else np.inf
        for i in np.flatnonzero(odd).tolist():  # NaN or infinite numbers
            one = distances(x[i : i + 1], codebook)[0]
            order[lo + i] = np.argsort(one, kind="stable")[:k]
            near[lo + i] = one[order[lo + i]]
    return order, near


@dataclass
class Som:
    """m x n neurons of ``dim`` weights; ``mode`` "batch" or "online"."""

    m: int
    n: int
    dim: int
    topology: str | None = "hexagonal"
    dtype: type = np.float32
    mode: str = "batch"
    alpha: float = 0.3
    sigma: float | None = None
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    quantization_errors: list[float] = field(default_factory=list)
    topographic_errors: list[float] = field(default_factory=list)
    cov_matrix: np.ndarray | None = None
    eigenvalues: np.ndarray | None = None
    eigenvectors: np.ndarray | None = None

    def __post_init__(self):
        self.sigma = max(self.m, self.n) / 2 if self.sigma is None else self.sigma
        if not len(self.weights):
            self.weights = np.zeros((self.m * self.n, self.dim), self.dtype)

    @property
    def topography(self) -> np.ndarray:
        return lattice(self.m, self.n, self.topology)

    @property
    def centroids(self) -> np.ndarray:
        return self.weights.reshape(self.m, self.n, self.dim)

    def init_rand(self, seed: int | None = None) -> Som:
        self.weights = np.random.default_rng(seed).random((self.m * self.n, self.dim), self.dtype)
        return self

    def init_from(self, other: Som) -> Som:
        if (self.m, self.n, self.dim, self.dtype, self.topology) != (other.m, other.n, other.dim, other.dtype, other.topology):
            raise TypeError("the maps differ in shape, type or topology")
        self.weights = other.weights.copy()
        return self

    # ---- passes over data -------------------------------------------------------------------------------------------------

    def _sent(self, spark: SparkSession):
        book = self.weights.astype(np.float64)
        if book.nbytes > MOST_CODEBOOK_BYTES:
            raise ValueError("the codebook is too large to broadcast")
        return ship(spark).sparkContext.broadcast(book)

    def winners(self, df: DataFrame, vector: str, into: str = "neuron", distance: str | None = None) -> DataFrame:
        """``df`` and its best neuron (the lowest of equally near ones; 0 for rows of NaN), and its distance if a name is given."""
        sent, dim, at = self._sent(df.sparkSession), self.dim, df.columns.index(vector)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{into}` int" + (f", `{distance}` double" if distance else "")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best, d = (x[:, 0] for x in nearest(_vectors(batch.column(at), dim), sent.value, 1))
                more = [pa.array(best, pa.int32()), *([pa.array(np.sqrt(d))] if distance else [])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, into, *([distance] if distance else [])])

        return df.mapInArrow(run, kinds)

    def top2(self, df: DataFrame, vector: str, *carry: str) -> DataFrame:
        """(carry..., bmu1, bmu2, dist1, dist2)."""
        sent, dim, k = self._sent(df.sparkSession), self.dim, len(carry)
        few = df.select(*carry, vector)
        kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema[:k]] + ["bmu1 int, bmu2 int, dist1 double, dist2 double"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                order, near = nearest(_vectors(batch.column(k), dim), sent.value, 2)
                near = np.sqrt(near)
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], *(pa.array(order[:, i], pa.int32()) for i in (0, 1)), *(pa.array(near[:, i]) for i in (0, 1))], names=[*carry, "bmu1", "bmu2", "dist1", "dist2"])

        return few.mapInArrow(run, kinds)

    def activation(self, df: DataFrame, vector: str, weight: str | None = None) -> DataFrame:
        """(neuron, activation): rows or their weights above 0 by best neuron, zeros included."""
        w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        rows = df.select(vector, w.alias("_w")).filter((F.col("_w") > 0) & ~F.isnan("_w"))
        sums = self.winners(rows, vector).groupBy("neuron").agg(F.sum("_w").alias("activation"))
        every = df.sparkSession.range(self.m * self.n).select(F.col("id").cast("int").alias("neuron"))
        return every.join(sums, "neuron", "left").select("neuron", F.coalesce("activation", F.lit(0.0)).alias("activation"))

    def errors(self, df: DataFrame, vector: str, weight: str | None = None) -> DataFrame:
        """One row (quantization_error, topographic_error): mean distance, and share of rows whose two best neurons aren't neighbours."""
        if self.m * self.n < 2:
            return df.sparkSession.createDataFrame([(math.nan, math.nan)], "quantization_error double, topographic_error double")
        w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        rows = self.top2(df.select(vector, w.alias("_w")).filter((F.col("_w") > 0) & ~F.isnan("_w")), vector, "_w").filter("dist1 < double('inf')")
        limit = (2 if self.topology == "square" else 1) + 1e-6
        (i1, j1), (i2, j2) = ((F.floor(F.col(c) / self.n), F.col(c) % self.n) for c in ("bmu1", "bmu2"))
        if self.topology == "square":
            far = (i1 - i2) * (i1 - i2) + (j1 - j2) * (j1 - j2)
        else:
            y = i1 - i2 + (j1 % 2 - j2 % 2) * 0.5
            far = y * y + (j1 - j2) * (j1 - j2) * 0.75
        apart = (far > limit).cast("double")
        total = F.sum("_w")
        nan = F.lit(math.nan)
        return rows.agg(F.coalesce(F.sum(F.col("_w") * F.col("dist1")) / total, nan).alias("quantization_error"), F.coalesce(F.sum(F.col("_w") * apart) / total, nan).alias("topographic_error"))

    def _sums(self, df: DataFrame, vector: str, weight: str | None, index: str | None = None, n: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Sum of w x and of w by neuron; with ``index`` already spread by each row's own neighbourhood radius."""
        sent, dim, t, sigma0 = self._sent(df.sparkSession), self.dim, self.topography, float(self.sigma)
        w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        rows = df.select(F.col(vector).alias("v"), w.alias("w"), *([F.col(index).cast("long").alias("i")] if index else [])).filter((F.col("w") > 0) & ~F.isnan("w"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book = sent.value
            num, den = np.zeros_like(book), np.zeros(len(book))
            for batch in batches:
                v, w = _vectors(batch.column(0), dim), batch.column(1).to_numpy()
                best, d = (x[:, 0] for x in nearest(v, book, 1))
                ok = np.isfinite(d)
                v, w, best = v[ok], w[ok], best[ok]
                d = None
                if index:
                    step = max(1, min(4096, BLOCK_NUMBERS // len(t)))
                    for lo in range(0, len(v), step):
                        i = batch.column(2).to_numpy()[ok][lo : lo + step]
                        s = np.maximum(sigma0 / (1 + 2.0 * i / n), EPS)
                        theta = np.exp(-((t[best[lo : lo + step]][:, None] - t[None]) ** 2).sum(-1) / (2 * s[:, None] ** 2)) * w[lo : lo + step, None]
                        num += theta.T @ v[lo : lo + step]
                        den += theta.sum(0)
                else:
                    np.add.at(num, best, v * w[:, None])
                    den += np.bincount(best, w, len(book))
            for lo in range(0, len(book), ROWS):
                part = np.concatenate([den[lo : lo + ROWS, None], num[lo : lo + ROWS]], 1)
                if part[:, 0].any():
                    yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([part.tobytes()], pa.binary())], names=["lo", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for lo, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    one = np.frombuffer(sums.as_buffer(), np.float64)
                    held[lo] = held[lo] + one if lo in held else one
            for lo, one in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([one.tobytes()], pa.binary())], names=["lo", "sums"])

        kinds = "lo long, sums binary"
        sums = rows.mapInArrow(run, kinds).repartition("lo").mapInArrow(add, kinds).toArrow()  # neurons x (dim + 1) numbers
        out = np.zeros((self.m * self.n, dim + 1))
        for lo, one in zip(sums.column("lo").to_pylist(), sums.column("sums"), strict=True):
            out[lo : lo + ROWS] = np.frombuffer(one.as_buffer(), np.float64).reshape(-1, dim + 1)
        return out[:, 1:], out[:, 0]

    def _update(self, num: np.ndarray, den: np.ndarray) -> None:
        self.weights = np.where(den[:, None] > EPS, num / np.where(den > EPS, den, 1.0)[:, None], 0.0).astype(self.dtype)

    def train(self, df: DataFrame, vector: str, weight: str | None = None, n_epochs: int | None = None, n_vectors: int | None = None, order: str | None = None, use_best_epoch: bool = False, stop_quantization: float = -1e6, stop_topographic: float = -1e6) -> Som:
        """Epochs over all rows, or one pass over the first ``n_vectors`` rows by ``order`` (a row number from 0)."""
        if (n_epochs is None) == (n_vectors is None):
            raise ValueError("give n_epochs or n_vectors")
        if self.mode == "online":
            return self._train_online(df, vector, weight, n_epochs, n_vectors, order, use_best_epoch, stop_quantization, stop_topographic)
        if n_vectors is not None:
            self._update(*self._sums(df.filter(F.col(order) < n_vectors), vector, weight, order, n_vectors))
            self._note(df, vector, weight)
            return self
        return self._epochs(n_epochs, use_best_epoch, df, vector, weight, stop_quantization, stop_topographic, self._batch_epoch)

    def _batch_epoch(self, e: int, n: int, df: DataFrame, vector: str, weight: str | None) -> None:
        num, den = self._sums(df, vector, weight)
        both = self._spread(np.concatenate([num, den[:, None]], 1), max(float(self.sigma) * decay(e, n), EPS))
        self._update(both[:, :-1], both[:, -1])

    def _spread(self, sums: np.ndarray, sigma: float) -> np.ndarray:
        """The neighbourhood matrix times ``sums``, first along columns and then along rows of the lattice: no matrix of neurons x neurons."""
        step = 1.0 if self.topology == "square" else math.sqrt(3) / 2
        i, j = np.arange(self.m), np.arange(self.n)
        near = lambda d: np.exp(-(d**2) / (2 * sigma**2))
        x, out = sums.reshape(self.m, self.n, -1), np.zeros((self.m, self.n, sums.shape[1]))
        along = near((j[:, None] - j) * step)
        kinds = [0] if self.topology == "square" else [0, 1]  # columns by parity: odd ones are shifted by half a step
        for a in kinds:
            for b in kinds:
                to, of = slice(a, None, len(kinds)), slice(b, None, len(kinds))
                rows = np.tensordot(near(i[:, None] - i + 0.5 * (a - b)), x[:, of], 1)
                out[:, to] += np.einsum("jk,ikd->ijd", along[to, of], rows, optimize=True)
        return out.reshape(sums.shape)

    def _epochs(self, n, use_best, df, vector, weight, stop_q, stop_t, step) -> Som:
        self.quantization_errors, self.topographic_errors = [], []
        history = []
        for e in range(n):
            step(e, n, df, vector, weight)
            q, t = self._note(df, vector, weight)
            if use_best:
                history.append(self.weights.copy())
            if q <= stop_q and t <= stop_t:
                break
        if use_best:
            self.weights = history[int(np.nanargmin(self.quantization_errors))]
        return self

    def _note(self, df: DataFrame, vector: str, weight: str | None) -> tuple[float, float]:
        q, t = self.errors(df, vector, weight).first()
        self.quantization_errors.append(q)
        self.topographic_errors.append(t)
        return q, t

    # ---- sequential training -----------------------------------------------------------------------------------------------

    def _train_online(self, df, vector, weight, n_epochs, n_vectors, order, use_best, stop_q, stop_t) -> Som:
        """Each row changes the map before the next one is seen, so rows come in order, in a stream of bounded size, to the driver."""
        if order is None:
            raise ValueError("online training needs an order")
        w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        rows = df.select(F.col(order).alias("o"), F.col(vector).alias("v"), w.alias("w")).orderBy("o")
        if n_vectors is not None:
            self._stream(rows.limit(n_vectors), lambda i: decay(i, n_vectors))
            self._note(df, vector, weight)
            return self
        return self._epochs(n_epochs, use_best, df, vector, weight, stop_q, stop_t, lambda e, n, *_: self._stream(rows, lambda i: decay(e, n)))

    def _stream(self, rows: DataFrame, at) -> None:
        t, book = self.topography, self.weights.astype(np.float64)
        for i, r in enumerate(rows.toLocalIterator(prefetchPartitions=True)):
            if r.w is None or not r.w > 0:
                continue
            x = np.asarray(r.v, np.float64)
            d = ((book - x) ** 2).sum(1)
            if np.isnan(d).all():
                continue
            best = int(np.nanargmin(d))
            k = at(i)
            alpha, sigma = max(self.alpha * k, EPS), max(float(self.sigma) * k, EPS)
            eta = alpha * np.exp(-((t - t[best]) ** 2).sum(1) / (2 * sigma**2))
            if r.w != 1.0:
                eta = -np.expm1(r.w * np.log1p(-np.minimum(eta, 1 - EPS)))
            book += eta[:, None] * (x - book)
        self.weights = book.astype(self.dtype)

    # ---- principal components ----------------------------------------------------------------------------------------------

    def train_pca(self, df: DataFrame, vector: str, weight: str | None = None, **how) -> Som:
        ship(df.sparkSession)
        return self.train_from_cov(stats.covariance_of_vectors(df, vector, self.dim, weight), **how)

    def train_from_cov(self, cov: np.ndarray, min_weight: float = 0.0, max_weight: float = 1.0, scale_by_variance: bool = False, apply_cdf: bool = False, cdf_gain: float = 1.0, positive: bool = False) -> Som:
        """The grid spanned by the two leading components; optionally each weight through a normal distribution function. positive: see diagonalize()."""
        if self.dim < 2 or max_weight <= min_weight or cdf_gain <= 0:
            raise ValueError("needs dim >= 2, max_weight > min_weight and cdf_gain > 0")
        self.cov_matrix = cov
        self.eigenvalues, self.eigenvectors = stats.diagonalize(cov, positive=positive)
        v = [self.eigenvectors[:, k] * (math.sqrt(self.eigenvalues[k]) if scale_by_variance and self.eigenvalues[k] > 0 else 1.0) for k in (0, 1)]
        lo, hi = (-1.0, 1.0) if apply_cdf else (min_weight, max_weight)
        w = np.linspace(lo, hi, self.m)[:, None, None] * v[0] + np.linspace(lo, hi, self.n)[None, :, None] * v[1]
        if apply_cdf:
            s = np.sqrt(v[0] ** 2 + v[1] ** 2)
            s[s == 0] = 1.0
            w = min_weight + (max_weight - min_weight) * 0.5 * (1 + np.vectorize(math.erf)(w * cdf_gain / (math.sqrt(2) * s)))
        self.weights = w.reshape(self.m * self.n, self.dim).astype(self.dtype)
        return self

    # ---- the map itself ----------------------------------------------------------------------------------------------------

    def neighbours(self, parity: bool = False) -> list[tuple[int, int]]:
        """Pairs of adjacent neurons, both ways; ``parity`` takes the reference's stencil on hexagons."""
        out = []
        for k in range(self.m * self.n):
            i, j = divmod(k, self.n)
            steps = _SQUARE if self.topology == "square" else (_HEX_PARITY if parity else _HEX)[j & 1]
            out += [(k, (i + a) * self.n + j + b) for a, b in steps if 0 <= i + a < self.m and 0 <= j + b < self.n]
        return out

    def distance_map(self, normalization: str = "sum", parity: bool = False) -> np.ndarray:
        """m x n: sum or mean of distances to neighbours over their largest value."""
        if normalization not in ("sum", "mean"):
            raise ValueError(f"unknown normalization {normalization!r}")
        total, count = np.zeros(self.m * self.n), np.zeros(self.m * self.n)
        for a, b in self.neighbours(parity):
            d = float(np.sqrt(((self.weights[a].astype(float) - self.weights[b]) ** 2).sum()))
            if not math.isnan(d):
                total[a] += d
                count[a] += 1
        if normalization == "mean":
            total = np.where(count > 0, total / np.maximum(count, 1), np.nan)
        top = np.nanmax(total)
        if not (np.isfinite(top) and top > 0):
            raise ValueError("the map has no positive distance")
        return (total / top).reshape(self.m, self.n).astype(self.dtype)

    def cells(self) -> list[tuple[int, float, float, list[tuple[float, float]]]]:
        """(neuron, y, x, corners) of each neuron's cell: a unit square, or a hexagon as wide as the lattice's step."""
        t = self.topography
        if self.topology == "square":
            corners = [(-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0.5, -0.5)]
        else:
            corners = [(math.cos(a) / math.sqrt(3), math.sin(a) / math.sqrt(3)) for a in (math.pi / 6 + k * math.pi / 3 for k in range(6))]
        return [(k, float(y), float(x), [(float(y) + a, float(x) + b) for a, b in corners]) for k, (y, x) in enumerate(t)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(neuron, i, j, ty, tx, w): one row a neuron."""
        t = self.topography
        rows = [(k, *divmod(k, self.n), float(t[k, 0]), float(t[k, 1]), [float(x) for x in self.weights[k]]) for k in range(self.m * self.n)]
        return spark.createDataFrame(rows, "neuron int, i int, j int, ty double, tx double, w array<double>")


def find_hyperparameters(df: DataFrame, vector: str, dim: int, n_epochs: int, weight: str | None = None, topology: str | None = "hexagonal", mode: str = "batch", use_best_epoch: bool = True, order: str | None = None, steps: int = 8, alphas: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5)) -> dict:
    """Grid search over map size, radius and (online) rate for the least quantization error."""
    size = df.agg(F.count(F.lit(1)) if weight is None else F.sum(weight)).first()[0]
    ref = math.sqrt(5 * math.sqrt(size))
    ship(df.sparkSession)
    cov = stats.covariance_of_vectors(df, vector, dim, weight)  # the same for all trials
    best: dict = {"quantization_error": math.inf}
    for m0 in np.unique(np.linspace(1.5 * ref, 0.5 * ref, steps)):
        for sigma in np.unique(m0 / np.linspace(8.0, 1.0, steps)):
            for alpha in [None] if mode == "batch" else alphas:
                m = max(1, round(float(m0)))
                start = Som(m, m, dim, topology).train_from_cov(cov)
                som = Som(m, m, dim, topology, mode=mode, sigma=float(sigma), **({} if alpha is None else {"alpha": alpha})).init_from(start)
                som.train(df, vector, weight, n_epochs=n_epochs, order=order, use_best_epoch=use_best_epoch)
                at = int(np.nanargmin(som.quantization_errors)) if use_best_epoch else len(som.quantization_errors) - 1
                if som.quantization_errors[at] < best["quantization_error"]:
                    best = {"m": m, "alpha": alpha, "sigma": float(sigma), "epoch": at, "quantization_error": som.quantization_errors[at], "quantization_errors": som.quantization_errors, "topographic_errors": som.topographic_errors}
    return best


def column_distance2(vector: Column, centre: list[float]) -> Column:
    """Squared distance of an array column to a fixed vector, in built-in functions."""
    return F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(x)) for x in centre)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
