"""Whole-batch text kernels: words, 64-bit word fingerprints and segment sums over Arrow string buffers.

All functions work on the UTF-8 bytes of an Arrow batch with a fixed number of NumPy passes, without a Python object per word.
A fingerprint is a polynomial over random 64-bit byte values, mixed with the length; two different words share one with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(4095, _P)]))
#: Bytes of text that a kernel sees at once, so that its arrays stay below a few hundred MB.
SLICE_BYTES = 4 << 20


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * len(_POWERS)), _P)]))
    return _POWERS


def _lut(separators: str | None) -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    if separators == "space":
        lut[[9, 10, 11, 12, 13, 32]] = 0
    else:
        for a, b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
            lut[a : b + 1] = 0
        lut[65:91] = np.arange(97, 123)
    return lut


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``most`` bytes of text each; a longer text is a run of its own."""
    n = batch.num_rows
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, off = len(column), column.offset
    buffers = column.buffers()
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[off : off + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a batch: where each starts and ends in the bytes, its fingerprint, and the first word of each text (``first`` has one more entry)."""

    SPACE = _lut("space")
    ALNUM = _lut(None)

    def __init__(self, column: pa.Array, lut: np.ndarray):
        data, offsets = raw(column)
        self.data, self.offsets = data, offsets
        word = (lut != 0)[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        begin[inner] = word[inner]
        self.starts = starts = np.flatnonzero(begin)
        del begin
        self.first = np.searchsorted(starts, offsets)
        if not len(starts):
            self.ends = starts
            self.hash = np.empty(0, np.uint64)
            return
        last = word.copy()
        last[:-1] &= ~word[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut <= len(data))] - 1
        last[cut] = word[cut]
        self.ends = np.flatnonzero(last) + 1
        del last, word
        self.hash = np.empty(len(starts), np.uint64)
        a = 0
        while a < len(starts):  # runs of words of about SLICE_BYTES, so that a very long text needs no more arrays than a slice
            b = max(a + 1, int(np.searchsorted(self.ends, starts[a] + 2 * SLICE_BYTES, "right")))
            self._fingerprints(lut, a, b)
            a = b

    def _fingerprints(self, lut: np.ndarray, a: int, b: int) -> None:
        lo, hi = int(self.starts[a]), int(self.ends[b - 1])
        starts, size = self.starts[a:b] - lo, self.ends[a:b] - self.starts[a:b]
        total = np.zeros(b - a, np.uint64)
        if hi - lo > 2 * SLICE_BYTES:  # one word, longer than a slice
            value = 0
            for at in range(lo, hi, SLICE_BYTES):
                part = lut[self.data[at : min(hi, at + SLICE_BYTES)]]
                value += int((_BYTE[part] * _powers(len(part))[: len(part)]).sum()) * pow(int(_P), at - lo, 1 << 64)
            total[0] = value % (1 << 64)
        else:
            low = lut[self.data[lo:hi]]
            place = np.arange(hi - lo, dtype=np.int64)
            place -= np.repeat(starts, np.diff(np.append(starts, hi - lo)))
            value = _BYTE[low]
            value *= _powers(int(place.max()) + 1)[place]
            value[low == 0] = 0
            total = np.add.reduceat(value, starts)
        self.hash[a:b] = mix(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]], exact for integers; an empty segment has 0."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values[: first[-1]], first[:-1][full])
    return out
