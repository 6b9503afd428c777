"""Linear models over hashed byte n-grams: features of whole texts as sums over positions, and their fits on the driver.

A text's features are the shares of its byte 1-, 2- and 3-grams in tables of fixed size. A linear score is then a mean of table entries over
positions, so scoring needs no feature vector and memory for one slice of a batch, however long the texts are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from skyloom.llm.textops import raw, segment_sum

SIZES = (256, 4096, 8192)
STARTS = (0, 256, 256 + 4096)
DIMENSIONS = sum(SIZES)
#: Entries of the tables of 1- and 2-grams alone.
SHORT = SIZES[0] + SIZES[1]
_LOW = np.arange(256, dtype=np.uint32)
_LOW[65:91] += 32
_RAW = np.arange(256, dtype=np.uint32)


def ngrams(column: pa.Array, lower: bool = True, longest: int = 3):
    """For each order up to ``longest`` the table entries of all positions and where each text's begin."""
    data, offsets = raw(column)
    b = (_LOW if lower else _RAW)[data]
    length = np.diff(offsets)
    for order in range(1, longest + 1):
        count = np.maximum(length - order + 1, 0)
        first = np.concatenate([[0], np.cumsum(count)])
        if len(b) < order:
            yield np.empty(0, np.int64), first
            continue
        key = b[: len(b) - order + 1].copy()
        for k in range(1, order):
            key = (key << np.uint32(8)) | b[k : len(b) - order + 1 + k]
        valid = np.ones(len(key), bool)
        for k in range(1, order):
            at = offsets[1:-1] - k
            valid[at[(at >= 0) & (at < len(key))]] = False
        key = key[valid]
        if order > 1:
            key = (key * np.uint32(2654435761)) >> np.uint32(32 - SIZES[order - 1].bit_length() + 1)
        yield key.astype(np.int64) + STARTS[order - 1], first


def scores(column: pa.Array, weights: np.ndarray, lower: bool = True) -> np.ndarray:
    """texts x models; weights: DIMENSIONS (or SHORT) x models."""
    longest = 2 if len(weights) == SHORT else 3
    out = np.zeros((len(column), weights.shape[1]))
    for at, first in ngrams(column, lower, longest):
        count = np.maximum(np.diff(first), 1)[:, None]
        for lo in range(0, weights.shape[1], 4):
            out[:, lo : lo + 4] += segment_sum(weights[:, lo : lo + 4][at].astype(np.float64), first) / count
    return out


def vectors(column: pa.Array, lower: bool = True, size: int = DIMENSIONS) -> np.ndarray:
    """texts x DIMENSIONS (or SHORT), for a few dozen texts of a sample at a time."""
    n = len(column)
    out = np.zeros((n, size), np.float32)
    for at, first in ngrams(column, lower, 2 if size == SHORT else 3):
        doc = np.repeat(np.arange(n), np.diff(first))
        out += (np.bincount(doc * size + at, minlength=n * size).reshape(n, size) / np.maximum(np.diff(first), 1)[:, None]).astype(np.float32)
    return out


def sparse(x: np.ndarray) -> bytes:
    at = np.flatnonzero(x)
    return np.array([len(at)], "<u4").tobytes() + at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def dense(blob: bytes, size: int) -> np.ndarray:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    out = np.zeros(size, np.float32)
    out[np.frombuffer(blob, "<u2", n, 4)] = np.frombuffer(blob, "<f4", n, 4 + 2 * n)
    return out


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, loss: str, ridge: float = 1e-3, steps: int = 120, gain: np.ndarray | float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model by accelerated gradient steps.

    ``x`` is changed. loss "svm": squared hinge, y in -1 and 1; "logistic": y is the probability of 1. Features are scaled by their deviation and ``gain``, and the
    scale is part of the result's weights.
    """
    mean = x.mean(0, dtype=np.float64)
    scale = gain / (np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / len(x) - mean**2, 0.0)) + 1e-4)
    x -= mean.astype(np.float32)  # in place: one copy of the sample is in memory
    x *= scale.astype(np.float32)
    p = weight / weight.sum()
    v = np.random.default_rng(1).normal(size=x.shape[1]).astype(np.float32)
    for _ in range(12):
        v = x.T @ (p * (x @ v)).astype(np.float32)  # with doubles, numpy would copy all of x to doubles
        top = float(np.linalg.norm(v))
        v = (v / max(top, 1e-12)).astype(np.float32)
    rate = 1.0 / ((2.0 if loss == "svm" else 0.25) * (top + 1.0) * 1.1 + ridge)
    w, b = np.zeros(x.shape[1]), 0.0
    w0, b0, t = w, b, 1.0
    for _ in range(steps):
        m = x @ w.astype(np.float32) + b
        g = p * (-2.0 * y * np.maximum(1.0 - y * m, 0.0) if loss == "svm" else 1.0 / (1.0 + np.exp(np.clip(-m, -50, 50))) - y)
        w1, b1 = w - rate * (x.T @ g.astype(np.float32) + ridge * w), b - rate * float(g.sum())
        t1 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w, b = w1 + (t - 1) / t1 * (w1 - w0), b1 + (t - 1) / t1 * (b1 - b0)
        w0, b0, t = w1, b1, t1
    return w0 * scale, b0 - float((w0 * scale) @ mean)


__all__ = ["DIMENSIONS", "SHORT", "dense", "fitted", "ngrams", "scores", "sparse", "vectors"]
