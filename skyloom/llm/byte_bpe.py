"""Operator 8, byte-level BPE by tree reduction.

The texts' regex matches are encoded separately. A match that is no token is encoded as a monoid: its halves recursively down to single bytes,
then neighbours are joined by re-encoding a window over the boundary, which doubles until the tokens outside it can't change. Results of short
nodes are kept, so that frequent syllables are joined once. The test of a window is local and exact:

    A row of tokens is the BPE encoding of its bytes if for every two neighbours (a, b) the encoding of bytes(a) + bytes(b) is (a, b).

Proof: merging always takes the lowest (rank, place). Take the first merge, in the run over all bytes, that crosses a border of the row,
between a and b. Up to there the merges inside a and b were the same, in the same order, as in the run over bytes(a) + bytes(b) alone,
whose next merge is then that crossing one; but that run ends in (a, b). So no merge crosses, and each token is built from its own bytes.

Decoding concatenates the tokens' bytes up a tree of the same kind. Ranks are read on the driver and broadcast (their size is checked); a worker holds a bounded cache.

Defined cases: null and empty texts have no tokens; equal rows get equal results; an empty table gives an empty result; the results carry
the columns named by ``carry`` alone, so that other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skyloom.llm.textops import slices
from skyloom.shipping import ship

#: Up to this many bytes a window's merges are looked for in a list, beyond it in a heap.
SHORT = 64
#: Entries of a worker's caches, the longest match and the longest node in bytes that are kept in them.
CACHE, NODES, PAIRS, CACHED_CHARS, CACHED_NODE = 200_000, 120_000, 200_000, 48, 6
#: How many neighbours one step of decoding concatenates.
FAN = 16
#: Characters from which a text's matches are taken in portions.
LONG = 1 << 20
MOST_VOCABULARY_BYTES = 64 << 20


class Bpe:
    """Ranks of a tiktoken file; a token's id is its rank."""

    def __init__(self, blob: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line.strip())}
        self.bytes = {i: b for b, i in self.rank.items()}
        self.known: dict[int, bool] = {}
        self.singles = {b: [i] for b, i in self.rank.items() if len(b) == 1}
        self.nodes = dict(self.singles)

    def merged(self, piece: bytes) -> list[int]:
        """Merges by the definition, for short windows."""
        rank = self.rank
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while pairs:
            low = min(pairs)
            if low == 1 << 60:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], 1 << 60)
        return [rank[x] for x in parts]

    def heap(self, piece: bytes) -> list[int]:
        """The same merges in n log n, for windows of any length."""
        n, rank = len(piece), self.rank
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = bytearray([1]) * n
        todo: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := rank.get(piece[i : end[end[i]]])) is not None:
                heapq.heappush(todo, (r, i, end[end[i]]))

        for i in range(n - 1):
            offer(i)
        while todo:
            _, i, to = heapq.heappop(todo)
            j = end[i]
            if not alive[i] or j >= n or end[j] != to:
                continue
            alive[j] = 0
            end[i] = to
            if to < n:
                before[to] = i
            offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = end[i]
        return out

    def window(self, piece: bytes) -> list[int]:
        return self.merged(piece) if len(piece) <= SHORT else self.heap(piece)

    def stable(self, a: int, b: int) -> bool:
        """Whether the neighbours a and b stay apart; with it, whatever stands beyond them does not matter."""
        pair = a << 32 | b
        if (got := self.known.get(pair)) is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            got = self.known[pair] = self.window(self.bytes[a] + self.bytes[b]) == [a, b]
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            a, b = left[max(0, len(left) - k) :], right[:k]
            w = self.window(b"".join(map(self.bytes.__getitem__, a + b)))
            rest_l, rest_r = left[: len(left) - len(a)], right[len(b) :]
            if (not rest_l or self.stable(rest_l[-1], w[0])) and (not rest_r or self.stable(w[-1], rest_r[0])):
                return rest_l + w + rest_r
            k *= 2

    def tree(self, piece: bytes) -> list[int]:
        if (got := self.nodes.get(piece)) is None:
            half = len(piece) // 2
            got = self.join(self.tree(piece[:half]), self.tree(piece[half:]))
            if len(piece) <= CACHED_NODE:
                if len(self.nodes) >= NODES:
                    self.nodes = dict(self.singles)
                self.nodes[piece] = got
        return got

    def match(self, piece: str) -> list[int]:
        """One match of the pattern; a token of the vocabulary is itself."""
        b = piece.encode()
        return [r] if (r := self.rank.get(b)) is not None else self.tree(b)

    def decode(self, ids: list[int]) -> bytes:
        parts = list(map(self.bytes.__getitem__, ids))
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
        return parts[0] if parts else b""


class Packed(dict):
    """From a match to its ids as little-endian 32-bit integers; holds the last CACHE of them at most."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.bpe.match(piece), "<u4").tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = out
        return out


_LOADED: dict[tuple[int, str], tuple] = {}


def _loaded(blob: bytes, pattern: str) -> tuple:
    import regex

    key = (hash(blob), pattern)
    if key not in _LOADED:
        bpe = Bpe(blob)
        _LOADED[key] = (bpe, Packed(bpe), regex.compile(pattern))
    return _LOADED[key]


def encode_text(text: str, packed: Packed, pattern) -> bytes:
    get = packed.__getitem__
    if len(text) < LONG:
        return b"".join(map(get, pattern.findall(text)))
    found, out = pattern.finditer(text), []
    while part := b"".join(get(m.group()) for m in islice(found, 100_000)):
        out.append(part)
    return b"".join(out)


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        blob = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(blob) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY_BYTES} bytes and can't be broadcast")
    return ship(spark).sparkContext.broadcast(blob)


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """The columns ``carry``, n_tokens, the ids themselves where ``ids``, and digests of the ids and of the bytes that they decode to."""
    blob = _vocabulary(docs.sparkSession, path)
    few = docs.select(*(f"`{c}`" for c in carry), docs[f"`{text}`"].alias("_text"))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema[:-1]] + ["n_tokens long", *(["ids array<int>"] if ids else []), "ids_sha256 string", "decoded_sha256 string"])
    k = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packed, found = _loaded(blob.value, pattern)
        for whole in batches:
            for batch in slices(whole, "_text"):
                n, codes, sha, back = [], [], [], []
                for text in batch.column(k).to_pylist():
                    got = encode_text(text or "", packed, found)
                    n.append(len(got) // 4)
                    if ids:
                        codes.append(np.frombuffer(got, "<i4"))
                    sha.append(hashlib.sha256(got).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(np.frombuffer(got, "<u4").tolist())).hexdigest())
                more = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, codes)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *codes]), pa.int32()))] if ids else []
                columns = [*batch.columns[:k], pa.array(n, pa.int64()), *more, pa.array(sha, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*carry, "n_tokens", *(["ids"] if ids else []), "ids_sha256", "decoded_sha256"])

    return few.mapInArrow(run, out)


def decoded(tokens: DataFrame, path: str, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` and text: the ids of each row as text again; null ids give a null text."""
    blob = _vocabulary(tokens.sparkSession, path)
    few = tokens.select(*(f"`{c}`" for c in carry), tokens[f"`{ids}`"].alias("_ids"))
    k = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(blob.value, ".")[0]
        for batch in batches:
            texts = [None if x is None else bpe.decode(x).decode("utf-8", "replace") for x in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, pa.string())], names=[*carry, "text"])

    return few.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema[:-1]] + ["text string"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)
