"""HEALPix (Gorski et al. 2005) in NESTED order as column expressions: whole-stage code, no UDF.

nside is a power of two given on the driver; pixels are BIGINT columns, angles degrees (lon, lat) or radians (theta, phi).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Eight bits spread to sixteen, and the even bits of eight compressed to four: small literal tables keep the expressions flat, where the
#: usual shift-and-mask steps would repeat their argument 32 times.
_SPREAD = [sum((k >> b & 1) << (2 * b) for b in range(8)) for k in range(256)]
_COMPRESS = [sum((k >> (2 * b) & 1) << b for b in range(4)) for k in range(256)]
#: Column of the face centers in units of pi / 4.
FACE_PHI = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)


def order_of(nside: int) -> int:
    if nside < 1 or nside & (nside - 1):
        raise ValueError("nside must be a power of two")
    return nside.bit_length() - 1


def nside2npix(nside: int) -> int:
    return 12 * nside * nside


def npix2nside(npix: int) -> int:
    return int(math.sqrt(npix / 12))


def nside2pixarea(nside: int, degrees: bool = False) -> float:
    area = math.pi / (3 * nside * nside)
    return math.degrees(math.degrees(area)) if degrees else area


def nside2resol(nside: int, arcmin: bool = False) -> float:
    resol = math.sqrt(math.pi / 3) / nside
    return math.degrees(resol) * 60 if arcmin else resol


def lonlat2thetaphi(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.lit(math.pi / 2) - F.radians(lat), F.radians(lon)


def thetaphi2lonlat(theta: Column, phi: Column) -> tuple[Column, Column]:
    return F.degrees(phi), F.degrees(F.lit(math.pi / 2) - theta)


def _looked_up(table: list[int], v: Column, n_bytes: int, step: int) -> Column:
    entries = F.expr("array(" + ", ".join(f"{x}L" for x in table) + ")")  # one text, since a Column for each entry costs seconds
    byte = lambda k: F.shiftrightunsigned(v, 8 * k).bitwiseAND(F.lit(255)).cast("int")
    return sum((F.shiftleft(F.get(entries, byte(k)), step * k) for k in range(1, n_bytes)), F.get(entries, byte(0)))


def spread_bits(v: Column, bits: int = 32) -> Column:
    """Bit k to place 2 k, for ``bits`` bits."""
    return _looked_up(_SPREAD, v.cast("long"), -(-bits // 8), 16)


def compress_bits(v: Column, bits: int = 32) -> Column:
    """Bit 2 k to place k, for ``bits`` bits of the result."""
    return _looked_up(_COMPRESS, v.cast("long"), -(-bits // 4), 4)


def xyf2nest(nside: int, x: Column, y: Column, f: Column) -> Column:
    bits = max(order_of(nside), 1)
    return spread_bits(x, bits) + spread_bits(y, bits) * 2 + f.cast("long") * (nside * nside)


def nest2xyf(nside: int, pix: Column) -> tuple[Column, Column, Column]:
    area = nside * nside
    inside = pix.cast("long").bitwiseAND(F.lit(area - 1))
    bits = max(order_of(nside), 1)
    return compress_bits(inside, bits), compress_bits(F.shiftright(inside, 1), bits), F.shiftright(pix.cast("long"), 2 * order_of(nside))


def _floor(c: Column) -> Column:
    return F.floor(c).cast("long")


def zphi2pix(nside: int, z: Column, phi: Column) -> Column:
    """The pixel of a direction by its height z and longitude phi (any real)."""
    order, last = order_of(nside), nside - 1
    t = F.pmod(phi, F.lit(2 * math.pi)) * (2 / math.pi)
    a, b = (t + 0.5) * nside, z * (0.75 * nside)
    jp, jm = _floor(a - b), _floor(a + b)
    ifp, ifm = F.shiftright(jp, order), F.shiftright(jm, order)
    face = F.when(ifp == ifm, F.when(ifp == 4, F.lit(4)).otherwise(ifp + 4)).when(ifp < ifm, ifp).otherwise(ifm + 8)
    belt = xyf2nest(nside, jm.bitwiseAND(F.lit(last)), F.lit(last) - jp.bitwiseAND(F.lit(last)), face)
    q = F.least(_floor(t), F.lit(3))
    tp, r = t - q, F.sqrt((F.lit(1.0) - F.abs(z)) * 3) * nside
    up, um = F.least(_floor(tp * r), F.lit(last)), F.least(_floor((F.lit(1.0) - tp) * r), F.lit(last))
    cap = F.when(z > 0, xyf2nest(nside, F.lit(last) - um, F.lit(last) - up, q)).otherwise(xyf2nest(nside, up, um, q + 8))
    return F.when(F.abs(z) <= 2 / 3, belt).otherwise(cap)


def ang2pix(nside: int, lon: Column, lat: Column, lonlat: bool = True) -> Column:
    """From degrees (lon, lat), or from radians (theta, phi) with lonlat=False."""
    return zphi2pix(nside, F.sin(F.radians(lat)), F.radians(lon)) if lonlat else zphi2pix(nside, F.cos(lon), lat)


def xyf2zphi(nside: int, x: Column, y: Column, f: Column, u=0.5, v=0.5) -> tuple[Column, Column]:
    """Height and longitude of the point (u, v) of a pixel's unit square; (0.5, 0.5) is its center."""
    X, Y = (x + u) / nside, (y + v) / nside
    r = F.lit(1) - F.shiftright(f, 2)
    h = r - 1 + X + Y
    m = F.lit(2.0) - r * h
    c = F.element_at(F.array(*map(F.lit, FACE_PHI)), (f + 1).cast("int"))
    polar = F.lit(1.0) - m * m / 3
    belt = m > 1
    z = F.when(belt, h * 2 / 3).otherwise(r * polar)
    phi = F.when(belt, c + X - Y).otherwise(c + (X - Y) / F.when(m == 0, 1.0).otherwise(m)) * (math.pi / 4)
    return z, phi


def pix2ang(nside: int, pix: Column, u=0.5, v=0.5) -> tuple[Column, Column]:
    """(lon, lat) in degrees of a point of the pixel, its center by default; lon is in [0, 360) for centers."""
    z, phi = xyf2zphi(nside, *nest2xyf(nside, pix), u, v)
    s = F.sqrt(F.greatest((F.lit(1.0) - z) * (F.lit(1.0) + z), F.lit(0.0)))
    return F.degrees(phi), F.degrees(F.atan2(z, s))


def pix2global(nside: int, pix: Column) -> tuple[Column, Column]:
    """Coordinates in the mosaic of 4 x 3 faces, a face of nside x nside pixels."""
    x, y, f = nest2xyf(nside, pix)
    return x + F.pmod(f, F.lit(4)) * nside, y + F.shiftright(f, 2) * nside


def ring2nest(nside: int, pix: Column) -> Column:
    """A RING index by the published ring geometry: ring and place give the direction of the center, which gives the NESTED pixel."""
    p, n = pix.cast("double"), float(nside)
    ncap, npix = 2.0 * n * (n - 1), 12.0 * n * n
    cap = lambda q: F.floor((F.sqrt(q * 2 + 1) + 1) / 2)
    i1 = cap(p)
    j1 = p - i1 * (i1 - 1) * 2
    q2 = p - ncap
    i2, j2 = F.floor(q2 / (4 * n)) + n, F.pmod(q2, F.lit(4 * n))
    q3 = F.lit(npix - 1) - p
    i3 = cap(q3)
    j3 = i3 * 4 - 1 - (q3 - i3 * (i3 - 1) * 2)
    odd = F.pmod(i2 - n + 1, F.lit(2.0))
    z = F.when(p < ncap, F.lit(1.0) - i1 * i1 / (3 * n * n)).when(p < npix - ncap, F.lit(4 / 3) - i2 * 2 / (3 * n)).otherwise(i3 * i3 / (3 * n * n) - 1)
    phi = F.when(p < ncap, (j1 + 0.5) / i1).when(p < npix - ncap, (j2 + 0.5 * odd) / n).otherwise((j3 + 0.5) / i3) * (math.pi / 2)
    return zphi2pix(nside, z, phi)


def order_index2nuniq(order: Column, index: Column) -> Column:
    return F.pow(F.lit(4.0), order + 1).cast("long") + index


def nuniq2order_index(nuniq: Column) -> tuple[Column, Column]:
    """Exact, by the length of the number in bits."""
    order = F.floor((F.length(F.bin(nuniq)) - 3) / 2).cast("int")
    return order, nuniq - F.pow(F.lit(4.0), order + 1).cast("long")
