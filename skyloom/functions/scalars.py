"""Small numeric functions of maps and correlations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decay(e: Column, n: Column) -> Column:
    """Asymptotic decay 1 / (1 + 2 e / n)."""
    return F.lit(1.0) / (F.lit(1.0) + F.lit(2.0) * e / n)


def square_distance(a: str, b: str) -> Column:
    """Of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def neighbourhood(d2: Column, sigma: Column) -> Column:
    """Gaussian of a squared lattice distance; sigma has a floor of 1e-12."""
    s = F.greatest(sigma, F.lit(1e-12))
    return F.exp(-d2 / (s * s * 2))


def density_step(eta: Column, weight: Column) -> Column:
    """A training step of rate eta repeated ``weight`` times: 1 - (1 - eta) ** weight."""
    return -F.expm1(weight * F.log1p(-F.least(eta, F.lit(1 - 1e-12))))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def separation(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Angle in degrees between two directions in degrees, exact for small angles too."""
    b1, b2 = F.radians(lat1), F.radians(lat2)
    half = lambda x: F.pow(F.sin(x / 2), 2)
    h = half(b1 - b2) + F.cos(b1) * F.cos(b2) * half(F.radians(lon1 - lon2))
    return F.degrees(F.asin(F.least(F.sqrt(h), F.lit(1.0))) * 2)
