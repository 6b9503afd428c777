"""Operator 2, language-model scores from a log-frequency Bloom filter of n-gram counts.

Counting: a task sorts its tokens' fingerprints and sends each part (a range of fingerprints) one compressed block of them with counts; the
parts, twice as many as scan tasks and MOST_PARTS at most, merge blocks as they come. So every n-gram of the training texts is counted, a row
is a block and not an n-gram, and a part's memory depends on its distinct n-grams, not on how often they occur.

Filter: an n-gram counted c times enters at the levels 0 to log2(c) - cutoff, HASHES bits each, in its part's segment. A reader probes one level
after the other until one is missing and so gets the count up to a factor of two. The model's cutoff is 0 and its filter has BITS bits for each
entry, so every n-gram counts, those that occur once too, and the filter grows with the number of distinct n-grams. It is broadcast in groups of
segments of PASS_BYTES at most, one after the other: each pass over the texts probes one group and adds its levels to those found before
(a byte for each token and one for each bigram, in a written table), so a larger corpus costs passes and not memory. Scores and shares are
computed from these levels alone.

Score: log10 of the product of  w * c(v, w) / c(v) + (1 - w * f(c(v))) * p(w),  p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),  over tokens w after v; a
text's first token follows an end token. f is the share of tokens after contexts of that frequency whose bigram is in the filter, over all
training texts.

Base score: exact counts. Words that occur often, HEAD at most, are looked up in a broadcast table; the others are joined by a shuffle.

Defined cases: a null or empty text is the end token alone; a null doc_id counts as the id with the empty text (held out, since crc32 is 0); equal
rows are each counted and scored; with no training text every count is 0 and the scores follow from N = V = 0; an empty table gives an empty
result; only doc_id and the text are read. Tokens are compared by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.scratch import materialize, tidy
from skyloom.llm.textops import Words, mix, raw, segment_sum, slices
from skyloom.shipping import ship

HEAD = 1 << 18
BITS, HASHES = 8, 4
LEVELS = 48
FLUSH_TOKENS = 2 << 20
#: Parts of all n-grams, entries of a part that are held unmerged, and bytes of the filter that are broadcast at once.
MOST_PARTS, HELD, PASS_BYTES = 4096, 4 << 20, 64 << 20
#: Bytes of text in a slice; a token takes some 150 bytes of arrays.
SLICE = 1 << 20
WEIGHT = 0.4
END = np.uint64(0xE2D0E2D0E2D0E2D1)
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all tokens with an end after each text, those of the tokens before them, and where each text's begin."""
    w = Words(column, Words.SPACE)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    seq = np.empty(len(w.hash) + n, np.uint64)
    ends = first[1:] - 1
    word = np.ones(len(seq), bool)
    word[ends] = False
    seq[word] = w.hash
    seq[ends] = END
    before = np.empty_like(seq)
    if len(seq):
        before[1:] = seq[:-1]
        before[0] = END
    return seq, before, first


def bigrams(before: np.ndarray, seq: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(3) + seq)


def pack(h: np.ndarray, c: np.ndarray) -> bytes:
    """Sorted fingerprints and counts: differences, bytes of equal weight together, compressed."""
    d = np.diff(h, prepend=np.uint64(0))
    wide = c.astype(np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([d, wide]).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    n = len(both) // 2
    return np.cumsum(both[:n], dtype=np.uint64), both[n:]


def summed(h: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if c is None:
        h = np.sort(h)
    else:
        order = np.argsort(h)
        h, c = h[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[at], (np.diff(np.append(at, len(h))) if c is None else np.add.reduceat(c, at) if len(at) else c)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def counted(train: DataFrame, parts: int) -> DataFrame:
    """(n, part, words, tokens, levels, block): all n-grams of the column _text, n = 1 and 2, by ranges of fingerprints."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush() -> Iterator[pa.RecordBatch]:
            for n in (0, 1):
                if not held[n]:
                    continue
                h, c = summed(np.concatenate(held[n]))
                held[n].clear()
                cut = np.searchsorted(_part(h, parts), np.arange(parts + 1).astype(np.uint64))
                for lo in range(0, parts, 256):
                    ps = [p for p in range(lo, min(parts, lo + 256)) if cut[p] < cut[p + 1]]
                    if ps:
                        yield pa.RecordBatch.from_arrays([pa.array([n + 1] * len(ps), pa.int32()), pa.array(ps, pa.int32()), pa.array([pack(h[cut[p] : cut[p + 1]], c[cut[p] : cut[p + 1]]) for p in ps], pa.binary())], names=["n", "part", "block"])

        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                seq, before, first = tokens(batch.column(0))
                before[first[:-1]] = END
                held[0].append(seq)
                held[1].append(bigrams(before, seq))
                if sum(map(len, held[0])) >= FLUSH_TOKENS:
                    yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def collapse() -> None:
            h, c = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            held[:] = [summed(h, c)]

        def close() -> Iterator[pa.RecordBatch]:
            if at is None:
                return
            collapse()
            h, c = held.pop()
            levels = np.bincount(np.log2(c.astype(float)).astype(int), minlength=LEVELS)
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([len(h)]), pa.array([int(c.sum())]), pa.array([levels.tolist()], pa.list_(pa.int64())), pa.array([pack(h, c)], pa.binary())], names=["n", "part", "words", "tokens", "levels", "block"])

        for batch in batches:
            for n, p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (n, p) != at:
                    yield from close()
                    at = (n, p)
                held.append(unpack(b.as_py()))
                if sum(len(h) for h, _ in held[1:]) > max(HELD, len(held[0][0])):
                    collapse()
        yield from close()

    sent = train.mapInArrow(count, "n int, part int, block binary").repartition(parts, "n", "part").sortWithinPartitions("n", "part")
    return sent.mapInArrow(merge, "n int, part int, words long, tokens long, levels array<long>, block binary")


class Filter:
    """The log-frequency Bloom filter, or its segments of the parts from ``lo`` to below ``hi``; a segment has ``bits`` bits."""

    def __init__(self, parts: int, bits: int, cutoff: int, lo: int = 0, hi: int | None = None):
        self.parts, self.bits, self.cutoff, self.lo, self.hi = parts, bits, cutoff, lo, parts if hi is None else hi
        self.stride = (bits + 7) // 8
        self.data = np.zeros((self.hi - lo) * self.stride, np.uint8)

    @staticmethod
    def seeds(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        a = mix(h + np.uint64(level * int(_PRIMES[1]) % (1 << 64)))
        return a, ((a >> np.uint64(33)) | np.uint64(1)) * _PRIMES[2]

    def place(self, a: np.ndarray) -> np.ndarray:
        return ((a & np.uint64(0xFFFFFFFFFFFF)) % np.uint64(self.bits)).astype(np.int64)

    def segment(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The bytes of one part's n-grams."""
        top = np.log2(c.astype(float)).astype(int) - self.cutoff
        bits = np.zeros(self.stride * 8, bool)
        for level in range(int(top.max(initial=-1)) + 1):
            a, step = self.seeds(h[top >= level], level)
            for _ in range(HASHES):
                bits[self.place(a)] = True
                a = a + step
        return np.packbits(bits, bitorder="little")

    def level(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram 0, or 1 and the last level whose HASHES bits are all set; 0 for those of other segments."""
        out = np.zeros(len(h), np.uint8)
        part = _part(h, self.parts).astype(np.int64)
        alive = np.arange(len(h)) if (self.lo, self.hi) == (0, self.parts) else np.flatnonzero((part >= self.lo) & (part < self.hi))
        h, base = h[alive], (part[alive] - self.lo) * self.stride
        for level in range(LEVELS):
            a, step = self.seeds(h, level)
            left = np.arange(len(h))
            for _ in range(HASHES):
                at = self.place(a)
                set_ = ((self.data[base[left] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
                left, a, step = left[set_], (a + step)[set_], step[set_]
            alive, h, base = alive[left], h[left], base[left]
            if not len(alive):
                break
            out[alive] = level + 1
        return out

    def count(self, h: np.ndarray) -> np.ndarray:
        """Counts up to a factor of two: 0, or 1.4 * 2 ** (level + cutoff)."""
        return counts_of(self.level(h), self.cutoff)

    def levels(self, seq: np.ndarray, before: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """level() of each token, looked up once each, and of each bigram."""
        word, at = np.unique(seq, return_inverse=True)
        before = before.copy()
        before[first[:-1]] = END
        return self.level(word)[at], self.level(bigrams(before, seq))


def counts_of(level: np.ndarray, cutoff: int = 0) -> np.ndarray:
    table = np.concatenate([[0.0], 1.4 * 2.0 ** (np.arange(256) + cutoff)])
    return table[level]


class Model:
    """What scoring needs besides levels: totals, the end token's level and the shares f by the level of a context's count."""

    def __init__(self, n: int, v: int, end: int):
        self.n, self.v, self.end = n, v, end
        self.share = np.zeros(LEVELS)

    @staticmethod
    def level(c: np.ndarray) -> np.ndarray:
        return np.log2(np.maximum(c, 1.0)).astype(int)

    def counts(self, uni: np.ndarray, bi: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c(w), c(v) and c(v, w) of tokens from their levels."""
        one = counts_of(uni)
        context = np.empty_like(one)
        context[1:] = one[:-1]
        context[first[:-1]] = counts_of(np.array([self.end]))[0]
        return one, context, np.minimum(counts_of(bi), context)

    def score(self, uni: np.ndarray, bi: np.ndarray, first: np.ndarray) -> np.ndarray:
        one, context, both = self.counts(uni, bi, first)
        p = (one + 0.1) / (self.n + 0.1 * (self.v + 1))
        known = context > 0
        p = np.where(known, WEIGHT * both / np.where(known, context, 1.0) + (1 - WEIGHT * self.share[self.level(context)] * known) * p, p)
        return segment_sum(np.log10(np.minimum(p, 1.0)), first)


def filters(merged: DataFrame, parts: int, most: int | None = None) -> Iterator[Filter]:
    """The filter in groups of segments of ``most`` bytes (PASS_BYTES); its segments are built on the executors, one group at a time comes to the driver."""
    spread = merged.select(F.posexplode("levels").alias("l", "k")).groupBy("l").agg(F.sum("k").alias("k")).collect()  # LEVELS rows
    words = np.zeros(LEVELS)
    for r in spread:
        words[r.l] = r.k
    entries = float((words * (np.arange(LEVELS) + 1)).sum())
    bits = int(max(64, entries * BITS * 1.05 / parts + 64))
    step = max(1, (PASS_BYTES if most is None else most) // ((bits + 7) // 8))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(parts, bits, 0, 0, 0)
        for batch in batches:
            for i, b in enumerate(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([own.segment(*unpack(b.as_py())).tobytes()], pa.binary())], names=["part", "bits"])

    for lo in range(0, parts, step):
        grams = Filter(parts, bits, 0, lo, min(parts, lo + step))
        group = merged.filter((F.col("part") >= lo) & (F.col("part") < grams.hi)).select("part", "block")
        for r in group.mapInArrow(build, "part int, bits binary").toLocalIterator():
            at = (r.part - lo) * grams.stride
            grams.data[at : at + grams.stride] |= np.frombuffer(r.bits, np.uint8)
        yield grams


def _rows(merged: DataFrame, lo: int, hi: int | None) -> DataFrame:
    """(h, c): words with counts from lo to below hi."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0):
                h, c = unpack(b.as_py())
                own = (c >= lo) if hi is None else (c >= lo) & (c < hi)
                yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), pa.array(c[own].astype(np.int64))], names=["h", "c"])

    return merged.filter("n = 1").select("block").mapInArrow(expand, "h long, c long")


def trained(train: DataFrame) -> tuple[DataFrame, int, int, int, tuple[np.ndarray, np.ndarray], int]:
    """Merged counts of the column _text of all of ``train``, how many parts they have, N, V, the frequent words with counts, and the count from
    which words are among these."""
    parts = min(MOST_PARTS, max(16, 2 * train.rdd.getNumPartitions()))
    merged = materialize(counted(train, parts), "ngrams")
    one = merged.filter("n = 1")
    n, v = one.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    by_level = {r.l: r.k for r in one.select(F.posexplode("levels").alias("l", "k")).groupBy("l").agg(F.sum("k").alias("k")).collect()}
    least = next(1 << i for i in range(LEVELS + 1) if sum(k for lv, k in by_level.items() if lv >= i) <= HEAD)
    rows = _rows(merged, least, None).toPandas()  # HEAD rows at most
    order = np.argsort(rows.h.to_numpy().view(np.uint64)) if len(rows) else np.empty(0, int)
    head = rows.h.to_numpy(np.int64).view(np.uint64)[order], rows.c.to_numpy(np.int64)[order]
    return merged, parts, int(n), int(v), head, least


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A byte string a text."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _looked(rows: DataFrame, k: int, group: Filter, head: tuple[np.ndarray, np.ndarray], scale: float) -> DataFrame:
    """The first pass over (carry..., _held, _text): exact counts of frequent words, the other words with how often each occurs, and levels."""
    sent = rows.sparkSession.sparkContext.broadcast((group, head))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["n_tokens long, known long, base double, rest array<long>, times array<int>, uni binary, bi binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (head, count) = sent.value
        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                seq, before, first = tokens(batch.column(k + 1))
                n = batch.num_rows
                at = np.minimum(np.searchsorted(head, seq), max(0, len(head) - 1))
                found = head[at] == seq if len(head) else np.zeros(len(seq), bool)
                logs = np.where(found, np.log10((np.where(found, count[at] if len(head) else 0, 1) + 0.1) / scale), 0.0)
                doc = np.repeat(np.arange(n), np.diff(first))
                rest, times, ends = [], [], np.zeros(n + 1, np.int64)
                other = np.flatnonzero(~found)
                cut = np.searchsorted(doc[other], np.arange(n + 1))
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    h, c = summed(seq[other[cut[i] : cut[i + 1]]])
                    rest.append(h)
                    times.append(c)
                    ends[i + 1] = len(h)
                ends = pa.array(np.cumsum(ends), pa.int32())
                uni, bi = own.levels(seq, before, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(segment_sum(found.astype(np.int64), first)),
                        pa.array(segment_sum(logs, first)),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.uint64), *rest]).view(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *times]), pa.int32())),
                        _binary(uni, first),
                        _binary(bi, first),
                    ],
                    names=[*batch.schema.names, "n_tokens", "known", "base", "rest", "times", "uni", "bi"],
                )

    return rows.mapInArrow(run, out).withColumn("_row", F.monotonically_increasing_id())  # fixed once the table is written


def _probed(table: DataFrame, group: Filter) -> DataFrame:
    """Another pass: the levels that this group of segments has."""
    sent = table.sparkSession.sparkContext.broadcast(group)
    names = table.columns
    text, uni, bi = (names.index(c) for c in ("_text", "uni", "bi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                seq, before, first = tokens(batch.column(text))
                more = [np.maximum(x, raw(batch.column(i))[0]) for x, i in zip(sent.value.levels(seq, before, first), (uni, bi), strict=True)]
                columns = list(batch.columns)
                columns[uni], columns[bi] = (_binary(x, first) for x in more)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return table.mapInArrow(run, table.schema)


def _fit(model: Model, table: DataFrame) -> None:
    """f by levels, over all training texts."""
    sent = table.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kept = np.zeros(LEVELS), np.zeros(LEVELS)
        own: Model = sent.value
        for batch in batches:
            uni, first = raw(batch.column(0))
            _, context, both = own.counts(uni, raw(batch.column(1))[0], first)
            level = own.level(context)
            seen += np.bincount(level, context > 0, LEVELS)
            kept += np.bincount(level, both > 0, LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(range(LEVELS), pa.int32()), pa.array(seen), pa.array(kept)], names=["l", "seen", "kept"])

    levels = table.filter(~F.col("_held")).select("uni", "bi").mapInArrow(look, "l int, seen double, kept double")
    for r in levels.groupBy("l").agg(F.sum("seen").alias("seen"), F.sum("kept").alias("kept")).collect():  # LEVELS rows
        model.share[r.l] = r.kept / r.seen if r.seen else 0.0


def scored(docs: DataFrame, held_out: str = "_held", text: str = "_text", carry: tuple[str, ...] = ("doc_id",), pass_bytes: int | None = None) -> DataFrame:
    """Train on rows where the column ``held_out`` is false and score all rows: the columns ``carry`` and held_out, n_tokens, n_known,
    train_tokens, base_score, score."""
    spark = ship(docs.sparkSession)
    few = docs.select(*(f"`{c}`" for c in carry), docs[f"`{held_out}`"].alias("_held"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("_text"))
    merged, parts, n, v, head, least = trained(few.filter(~F.col("_held")).select("_text"))
    tidy(spark)  # the blocks' shuffle is larger than the merged counts
    scale = float(n + 0.1 * (v + 1))
    table, end = None, 0
    for group in filters(merged, parts, pass_bytes):
        end = max(end, int(group.level(np.array([END]))[0]))
        last = group.hi == parts
        table = _looked(few, len(carry), group, head, scale) if table is None else _probed(table, group)
        table = materialize(table.drop("_text") if last else table, "scored", "zstd")
    model = Model(n, v, end)
    _fit(model, table)
    sent = spark.sparkContext.broadcast(model)
    keyed = table.select(*(f"`{c}`" for c in table.columns if c not in ("rest", "times", "uni", "bi")), "uni", "bi")
    names = keyed.columns[:-2]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uni, first = raw(batch.column(len(names)))
            got = sent.value.score(uni, raw(batch.column(len(names) + 1))[0], first)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(got)], names=[*names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema[: len(names)])
    done = keyed.mapInArrow(score, f"{kinds}, score double")
    rest = table.select("_row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("_row", F.col("x.rest").alias("h"), F.col("x.times").alias("times"))
    rare = _rows(merged, 1, least)
    found = rest.join(rare, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = F.col("times") * F.log10((F.col("c") + 0.1) / F.lit(scale))
    sums = found.groupBy("_row").agg(F.sum(log).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("few"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return done.join(sums, "_row", "left").select(
        *(f"`{c}`" for c in carry),
        F.col("_held").alias("held_out"),
        "n_tokens",
        (F.col("known") + zero("few")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more")).alias("base_score"),
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10))
    return scored(docs.select("doc_id", (mark == 0).alias("_held"), F.col("text").alias("_text")))
