"""Operator 1, benchmark passages in training texts: an FM-index per training shard, searched backwards for the test phrases.

A shard is a slice of an Arrow batch (about SLICE_BYTES of text). Its words become symbols of the benchmark's vocabulary; only runs of
vocabulary words that are as long as the shortest phrase can hold an occurrence, so only these enter the index. Occurrences are located by
sampled suffix positions and merged to spans. Texts aren't shuffled: a document's result needs its own words and the phrases alone.

The benchmark is compiled on the driver in blocks of at most BLOCK_WORDS words; each block is a broadcast of bounded size and a pass of
its own over the rows (a chain of narrow maps), so that a large benchmark costs passes, not memory.

Words are compared by 64-bit fingerprints. Defined cases: a null or empty text has no words; an item without words matches nothing; an item
with a null id marks words as hit but isn't counted; equal rows get equal results; an empty table gives an empty result, an empty benchmark
hits nothing; of the input's other columns only those in ``carry`` are read, so that clashing names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.fm_index import FmIndex
from skyloom.llm.textops import Words, slices
from skyloom.shipping import ship

WINDOW = 10
BLOCK_WORDS = 1 << 20
FOUND = "n_words long, n_hit long, items array<string>, hit_from array<int>, hit_to array<int>"


class Phrases:
    """Windows of benchmark items over their own vocabulary. Symbols: 0 separates, word k of the vocabulary is k + 1."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        w = Words(pa.array(texts, pa.string()), Words.ALNUM)
        self.vocabulary = np.unique(w.hash)
        codes = np.searchsorted(self.vocabulary, w.hash).astype(np.int64) + 1
        by_length: dict[int, dict[tuple, set[int]]] = {}
        self.ids = ids
        for k in range(len(texts)):
            item = codes[w.first[k] : w.first[k + 1]].tolist()
            length = min(window, len(item))
            for i in range(len(item) - length + 1 if item else 0):
                by_length.setdefault(length, {}).setdefault(tuple(item[i : i + length]), set()).add(k)
        self.tables = []
        for length, found in sorted(by_length.items()):
            owners = [sorted(x) for x in found.values()]
            self.tables.append((np.array(list(found), np.int64), np.cumsum([0, *map(len, owners)]), np.array([y for x in owners for y in x], np.int64)))
        self.shortest = min(by_length, default=0)

    def find(self, w: Words) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """For each word whether it is hit, and pairs (text, item) of occurrences."""
        hit = np.zeros(len(w.hash) + 1, np.int64)
        if not len(w.hash) or not self.tables:
            return hit[:-1].astype(bool), []
        at = np.searchsorted(self.vocabulary, w.hash)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == w.hash
        # runs of known words within one text
        edge = np.zeros(len(w.hash) + 1, bool)
        edge[w.first] = True
        begins = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
        ends = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        long = ends - begins >= self.shortest
        begins, ends = begins[long], ends[long]
        if not len(begins):
            return hit[:-1].astype(bool), []
        size = ends - begins + 1
        symbols = np.zeros(int(size.sum()), np.int64)
        stop = np.cumsum(size) - 1
        word = np.arange(len(symbols)) - np.repeat(stop - size + 1, size) + np.repeat(begins, size)
        inside = np.ones(len(symbols), bool)
        inside[stop] = False
        symbols[inside] = at[word[inside]] + 1
        index = FmIndex(symbols, len(self.vocabulary) + 1)
        pairs = []
        for windows, first, owners in self.tables:
            which, lo, hi = index.search(windows)
            if not len(which):
                continue
            n = hi - lo
            rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            start = word[index.locate(rows)]
            np.add.at(hit, start, 1)
            np.add.at(hit, start + windows.shape[1], -1)
            text = np.searchsorted(w.first, start, "right") - 1
            both = np.unique(np.stack([text, np.repeat(which, n)]), axis=1)
            k = np.diff(first)[both[1]]
            own = owners[np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[:-1][both[1]], k)]
            pairs.append((np.repeat(both[0], k), own))
        return np.cumsum(hit[:-1]) > 0, pairs


def _lists(first: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)


def _find_block(few: DataFrame, k: int, phrases, again: bool) -> DataFrame:
    """One pass: words and hits of one block, merged with those of the blocks before it."""
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema[: k + 1]] + [FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Phrases = phrases.value
        for whole in batches:
            for batch in slices(whole, "_text"):
                w = Words(batch.column(k), Words.ALNUM)
                hit, pairs = own.find(w)
                n = batch.num_rows
                items: list[set[str]] = [set() for _ in range(n)]
                for text, item in pairs:
                    for t, i in zip(text.tolist(), item.tolist(), strict=True):
                        if own.ids[i] is not None:
                            items[t].add(own.ids[i])
                if again:
                    for t, before in enumerate(batch.column(k + 3).to_pylist()):
                        items[t].update(before)
                    lo, hi = (batch.column(k + j).flatten().to_numpy(zero_copy_only=False) for j in (4, 5))
                    if len(lo):
                        counts = pc.list_value_length(batch.column(k + 4)).to_numpy(zero_copy_only=False)
                        base = np.repeat(w.first[:-1], counts)
                        cover = np.zeros(len(hit) + 1, np.int64)
                        np.add.at(cover, base + lo, 1)
                        np.add.at(cover, base + hi, -1)
                        hit |= np.cumsum(cover[:-1]) > 0
                edge = np.zeros(len(hit) + 1, bool)
                edge[w.first] = True
                begins = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]]))) if len(hit) else np.empty(0, np.int64)
                ends = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1 if len(hit) else begins
                first = np.searchsorted(begins, w.first)
                base = np.repeat(w.first[:-1], np.diff(first))
                total = np.concatenate([[0], np.cumsum(hit)])
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[: k + 1],
                        pa.array(w.counts(), pa.int64()),
                        pa.array(total[w.first[1:]] - total[w.first[:-1]], pa.int64()),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        _lists(first, pa.array(begins - base, pa.int32())),
                        _lists(first, pa.array(ends - base, pa.int32())),
                    ],
                    names=[*batch.schema.names[: k + 1], "n_words", "n_hit", "items", "hit_from", "hit_to"],
                )

    return few.mapInArrow(run, out)


def compiled(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The benchmark in blocks of whole items; the driver holds one block at a time."""
    ids: list[str | None] = []
    texts: list[str | None] = []
    size = 0
    for row in benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t or "") // 2 + 1  # words at most
        if size >= block_words:
            yield Phrases(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield Phrases(ids, texts, window)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block_words: int = BLOCK_WORDS, keep_text: bool = False) -> DataFrame:
    """The columns ``carry``, then n_words, n_hit, items (sorted ids as strings) and hit_from, hit_to: spans of hit words, counted in words."""
    few = docs.select(*(f"`{c}`" for c in carry), docs[f"`{text}`"].alias("_text"))
    again, sc = False, ship(docs.sparkSession).sparkContext
    for phrases in compiled(benchmark, window=window, block_words=block_words):
        few, again = _find_block(few, len(carry), sc.broadcast(phrases), again), True
    if not again:
        few = _find_block(few, len(carry), sc.broadcast(Phrases([], [], window)), False)
    return few if keep_text else few.drop("_text")


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", chars: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """``docs`` without the benchmark's passages: from the first byte of a span's first word to the last byte of its last one.

    Texts without a hit are as before, byte by byte. The column ``chars``, if there is one, is counted anew for changed texts.
    """
    names = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = names.index(text)
    carry = tuple(f"c{i}" for i in range(len(names)) if i != at)
    found = find(renamed, benchmark, f"c{at}", carry, window, keep_text=True)
    k = len(carry)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema[: k + 1]) + ", changed boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(k)
            hit = np.flatnonzero(batch.column(k + 2).to_numpy(zero_copy_only=False) > 0)
            changed = np.zeros(batch.num_rows, bool)
            if len(hit):
                new = texts.to_pylist()
                lo, hi = batch.column(k + 4).to_pylist(), batch.column(k + 5).to_pylist()
                for i in hit.tolist():
                    w = Words(texts.slice(i, 1), Words.ALNUM)
                    b, parts, place = w.data.tobytes(), [], 0
                    for x, y in zip(lo[i], hi[i], strict=True):
                        parts.append(b[place : w.starts[x]])
                        place = int(w.ends[y - 1])
                    new[i] = b"".join([*parts, b[place:]]).decode("utf-8", "replace")
                    changed[i] = True
                texts = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], texts, pa.array(changed)], names=[*batch.schema.names[:k], "_text", "changed"])

    done = found.mapInArrow(cut, out)
    new = {names.index(text): F.col("_text")}
    if chars in names:
        i = names.index(chars)
        new[i] = F.when(F.col("changed"), F.length("_text").cast(docs.schema[i].dataType)).otherwise(F.col(f"c{i}"))
    return done.select(*(new.get(i, F.col(f"c{i}")).alias(n) for i, n in enumerate(names)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    joined = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


NO_ITEMS = hashlib.sha256(b"").hexdigest()
#: RE2 can't negate these classes by code point below 0x80 alone in a byte-safe way, so words are what remains between ASCII separators.
SQL = r"""
with b as (select item_id::varchar as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as s
  from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
d as materialized (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
dw as (select rid, n, i, array_to_string(w[i : i + n - 1], ' ') as s from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)),
occ as materialized (select rid, i, dw.n, item from dw join bw on dw.n = bw.n and dw.s = bw.s),
hit as (select rid, count(*) as n_hit from (select distinct rid, unnest(range(i, i + n)) as k from occ) group by rid),
its as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from occ) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join hit using (rid) left join its using (rid)"""
