"""Operator 5, a quality classifier from weak labels.

Twelve overlapping heuristic labellers call a text good, bad or abstain. Expectation-maximisation over the counts of their vote patterns
estimates the rates of bad votes on good texts, one for each labeller and free, and on the kinds of bad texts: a kind has a share of all texts,
a rate for each labeller of its theme (on average at least BROKEN of them call a text of the kind bad) and one rate for the others; a bad vote
never speaks for good. So labellers that agree decide, and one that often is alone loses its say. The posterior of a pattern is a soft label.
A logistic scorer over hashed byte n-grams and bucketed text measures learns these labels and scores every text; texts below KEEP_AT are rejected.

Pattern counts cover all rows. The scorer alone learns from a sample: of texts with and without a bad vote about SAMPLE each at most,
weighted back to their shares. A row's lot comes from its text, the columns ``carry`` and its number among rows equal in these, so blank texts and
copies are drawn at their share, whatever the partitions.

Defined cases: a null or empty text has no words, gets a bad vote for its length and is scored like any other; equal rows get equal results; an empty
table gives an empty result; null doc_ids are kept as they are; only the columns ``carry`` and the text are read, so other names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.hashed import SHORT, dense, fitted, scores, sparse, vectors
from skyloom.llm.scratch import materialize
from skyloom.llm.textops import Words, mix, raw, segment_sum, slices
from skyloom.shipping import ship

LABELLERS = ("short", "symbols", "exclaims", "capitals", "same_word_again", "few_distinct", "odd_words", "same_line_again", "symbol_words", "bare_words", "no_letters", "few_words")
SAMPLE, KEEP_AT, ITERATIONS = 3000, 0.5, 40
#: The n-gram shares of a text of this many bytes weigh half as much as those of a long one, since they are noisy in short texts.
HALF = 200
THEMES = (("short", "odd_words"), ("symbols", "symbol_words", "bare_words", "no_letters"), ("same_word_again", "few_distinct", "same_line_again", "few_words"), ("exclaims", "capitals"))
#: First guesses: share of each kind of bad texts, rates of bad votes within a kind's theme, beyond it and on good texts; pseudo-counts for them.
KIND, WITHIN, BEYOND, ON_GOOD, PSEUDO = 0.025, 0.6, 0.05, 0.01, 20.0
BROKEN = 1.5
BUCKETS = 12
#: Bytes of text in a slice; a byte takes some 35 bytes of arrays.
SLICE = 1 << 20
#: What each of the thousands of n-gram shares weighs against a bucket of a measure, so that they don't drown these.
GRAM_GAIN = 0.2
_GAIN = np.concatenate([np.full(SHORT, GRAM_GAIN), np.ones(len(LABELLERS) * BUCKETS)])
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"#*$%&|<>{}~^\\=_")] = 1
_CLASS[list(b"!")] = 2
_CLASS[65:91] = 3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def measures(column: pa.Array) -> np.ndarray:
    """texts x labellers: word count, then ratios that are large in bad texts (few_distinct: repeated share of pairs; odd_words: mean word length; few_words: root of
    the word count by distinct words, neither good nor bad below 30 words)."""
    data, offsets = raw(column)
    w = Words(column, Words.SPACE)
    n = len(column)
    words = w.counts().astype(float)
    some = np.maximum(words, 1)
    kind = _CLASS[data]
    out = np.zeros((n, len(LABELLERS)))
    out[:, 0] = words
    size = segment_sum((w.ends - w.starts).astype(np.int64), w.first)
    for j, k, per in ((1, 1, some), (2, 2, some), (3, 3, np.maximum(size, 1))):
        out[:, j] = segment_sum((kind == k).astype(np.int64), offsets) / per
    again = np.concatenate([[False], w.hash[1:] == w.hash[:-1]]) if len(w.hash) else np.empty(0, bool)
    again[w.first[:-1][w.first[:-1] < len(again)]] = False
    out[:, 4] = segment_sum(again.astype(np.int64), w.first) / some
    out[:, 6] = size / some
    if len(w.starts):
        out[:, 8] = segment_sum((np.maximum.reduceat((kind == 1).astype(np.int8), w.starts) > 0).astype(np.int64), w.first) / some
        letters = np.add.reduceat(_LETTER[data].astype(np.int64), w.starts)
        out[:, 9] = segment_sum((letters == 0).astype(np.int64), w.first) / some
        out[:, 10] = np.where(words > 0, 1 - segment_sum(letters, w.first) / np.maximum(size, 1), 0)
    lines = np.flatnonzero(data == 10)
    cut = np.searchsorted(lines, offsets)
    blob = data.tobytes()
    for i in range(n):
        a, b = int(w.first[i]), int(w.first[i + 1])
        # pairs of words that stood before: in natural text few, in repeated text most
        h = w.hash[a:b]
        pairs = h[:-1] * np.uint64(3) + h[1:]
        out[i, 5] = 1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0
        out[i, 11] = (b - a) ** 0.5 / len(np.unique(h)) if b - a >= 30 else 0.35
        if cut[i + 1] > cut[i]:
            ls = [x for x in blob[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
            again_ = len(ls) - len(set(ls))
            out[i, 7] = again_ / len(ls) if again_ >= 3 else 0
    return out


#: From a labeller's measure: bad above the first value, good up to the second, else it abstains. Word count and length are special.
LIMITS = {"symbols": (0.15, 0.03), "exclaims": (0.25, 0.03), "capitals": (0.4, 0.2), "same_word_again": (0.2, 0.05), "few_distinct": (0.45, 0.3), "same_line_again": (0.3, 0.05), "symbol_words": (0.2, 0.02), "bare_words": (0.1, 0.02), "no_letters": (0.25, 0.12), "few_words": (0.5, 0.25)}


def votes(m: np.ndarray) -> np.ndarray:
    """-1 bad, 0 abstains, 1 good."""
    out = np.zeros(m.shape, np.int8)
    for j, name in enumerate(LABELLERS):
        if name == "short":
            bad, good = m[:, j] < 5, m[:, j] >= 30
        elif name == "odd_words":
            bad, good = (m[:, j] > 30) | (m[:, j] < 1.5), (m[:, j] >= 2.5) & (m[:, j] <= 16)
        else:
            bad, good = m[:, j] > LIMITS[name][0], m[:, j] <= LIMITS[name][1]
        out[good, j] = 1
        out[bad, j] = -1
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    """A row of votes as one number, below 3 ** labellers."""
    return (v.astype(np.int64) + 1) @ 3 ** np.arange(v.shape[1])


def unpattern(p: np.ndarray) -> np.ndarray:
    return (np.asarray(p)[:, None] // 3 ** np.arange(len(LABELLERS))) % 3 - 1


class Labels:
    """Posterior probabilities of good, by EM over counts of vote patterns. share: of good texts, then of each kind; rate: kinds x labellers."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray):
        v, n = unpattern(patterns), counts.astype(float)
        theme = np.array([[x in t for x in LABELLERS] for t in THEMES])
        k = len(THEMES)
        self.share = np.array([1 - k * KIND] + [KIND] * k)
        guess = np.concatenate([np.full((1, len(LABELLERS)), ON_GOOD), np.where(theme, WITHIN, BEYOND)])
        first, self.rate = self.share, guess
        for _ in range(ITERATIONS if len(n) else 0):
            w = n[:, None] * self.posterior(v)
            self.share = (w.sum(0) + PSEUDO * first) / (n.sum() + PSEUDO)
            hit, said = w.T @ (v == -1), w.T @ (v != 0)
            rate = (hit + PSEUDO * guess) / (said + PSEUDO)
            for i, own in enumerate(theme, 1):
                full = rate[i, own].sum()
                rate[i, own] += (1 - rate[i, own]) * max(0.0, (BROKEN - full) / (own.sum() - full))
                rate[i, ~own] = (hit[i, ~own].sum() + PSEUDO * BEYOND) / (said[i, ~own].sum() + PSEUDO)
                rate[i] = np.maximum(rate[i], rate[0])
            self.rate = np.clip(rate, 1e-4, 1 - 1e-4)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """patterns x (good, then each kind of bad)."""
        x = np.log(self.share) + (v == -1) @ np.log(self.rate).T + (v == 1) @ np.log(1 - self.rate).T
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    def good(self, v: np.ndarray) -> np.ndarray:
        return self.posterior(v)[:, 0]


def buckets(m: np.ndarray) -> np.ndarray:
    """texts x measures: each measure's bucket, an entry of the scorer's second table."""
    scale = np.array([1.0 if x in ("short", "odd_words") else 100.0 for x in LABELLERS])
    return np.minimum(np.log2(1 + m * scale).astype(int), BUCKETS - 1) + np.arange(m.shape[1]) * BUCKETS


def _trust(column: pa.Array) -> np.ndarray:
    size = np.diff(raw(column)[1])
    return size / (size + HALF)


def _inputs(column: pa.Array, m: np.ndarray) -> np.ndarray:
    x = np.zeros((len(column), SHORT + len(LABELLERS) * BUCKETS), np.float32)
    x[:, :SHORT] = vectors(column, False, SHORT) * _trust(column)[:, None].astype(np.float32)
    np.put_along_axis(x, SHORT + buckets(m), 1.0, 1)
    return x


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.grams, self.table, self.bias = weights[:SHORT, None].astype(np.float32), weights[SHORT:], bias

    def score(self, column: pa.Array, m: np.ndarray) -> np.ndarray:
        s = scores(column, self.grams, lower=False)[:, 0] * _trust(column) + self.table[buckets(m)].sum(1) + self.bias
        return 1 / (1 + np.exp(np.clip(-s, -50, 50)))


def drawn(key: np.ndarray, copies: np.ndarray, share: np.ndarray) -> np.ndarray:
    """How many of a key's copies are in the sample: each has its own lot, from the key and its number among them."""
    out = np.zeros(len(key), np.int64)
    for i in np.flatnonzero(copies > 1).tolist():
        for lo in range(1, int(copies[i]), 1 << 20):
            number = np.arange(lo, min(int(copies[i]), lo + (1 << 20)), dtype=np.uint64)
            out[i] += int((_lots(key[i] + number * np.uint64(0x9E3779B97F4A7C15)) < share[i]).sum())
    return out + (_lots(key) < share)


def _lots(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> np.uint64(11)).astype(float) / (1 << 53)


def learned(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ()) -> tuple[Labels, Scorer]:
    """Labels from the patterns of all rows, and the scorer that learns them; the columns ``keys`` and the text spread the sample."""
    ship(docs.sparkSession)
    key = F.xxhash64(F.lit(5), docs[f"`{text}`"], *(docs[f"`{c}`"].cast("string") for c in keys))
    few = docs.select(docs[f"`{text}`"].alias("_text"), key.alias("_key"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(pattern(votes(measures(batch.column(0))))), batch.column(1)], names=["p", "key"])

    looked = materialize(few.mapInArrow(look, "p long, key long").groupBy("p", "key").agg(F.count(F.lit(1)).alias("c")), "patterns")
    rows = looked.groupBy("p").agg(F.sum("c").alias("c")).collect()  # 3 ** labellers rows at most
    p, c = np.array([r.p for r in rows], np.int64), np.array([r.c for r in rows], np.int64)
    order = np.argsort(p)
    p, c = p[order], c[order]
    labels = Labels(p, c)
    odd = (unpattern(p) == -1).any(1) if len(p) else np.empty(0, bool)
    share = {flag: min(1.0, SAMPLE / max(1, int(c[odd == flag].sum()))) for flag in (False, True)}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            bad = (unpattern(batch.column(0).to_numpy()) == -1).any(1)
            times = drawn(own.view(np.uint64), n, np.where(bad, share[True], share[False]))
            at = pa.array(np.flatnonzero(times))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(times).take(at)], names=["p", "key", "times"])

    lots = {r.key: r for r in looked.mapInArrow(draw, "p long, key long, times long").collect()}  # SAMPLE with and SAMPLE without a bad vote on average
    wanted = np.array(sorted(lots), np.int64)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            own = batch.column(1).to_numpy()
            for i in np.flatnonzero(np.isin(own, wanted)).tolist():
                if int(own[i]) not in done:
                    done.add(int(own[i]))
                    column = batch.column(0).slice(i, 1)
                    x = _inputs(column, measures(column))
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, 1), pa.array([sparse(x[0])], pa.binary())], names=["key", "x"])

    got = {r.key: r.x for r in few.mapInArrow(take, "key long, x binary").dropDuplicates(["key"]).collect()} if len(wanted) else {}  # a row a key
    size = SHORT + len(LABELLERS) * BUCKETS
    if not got:
        return labels, Scorer(np.zeros(size), 0.0)
    v = unpattern(np.array([lots[k].p for k in wanted.tolist()], np.int64))
    x = np.empty((len(wanted), size), np.float32)
    for i, k in enumerate(wanted.tolist()):
        x[i] = dense(bytes(got[k]), size)
    weight = np.where((v == -1).any(1), 1 / share[True], 1 / share[False]) * np.array([lots[k].times for k in wanted.tolist()])
    return labels, Scorer(*fitted(x, labels.good(v), weight / weight.mean(), "logistic", 1e-4, 200, _GAIN))


def judged(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, n_bad_votes, weak_label (posterior of good), score and kept."""
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, text, carry))
    few = docs.select(*(f"`{c}`" for c in carry), docs[f"`{text}`"].alias("_text"))
    k = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, scorer = sent.value
        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                m = measures(batch.column(k))
                v = votes(m)
                score = scorer.score(batch.column(k), m)
                more = [pa.array((v == -1).sum(1), pa.int64()), pa.array(labels.good(v)), pa.array(score), pa.array(score >= KEEP_AT)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], *more], names=[*carry, "n_bad_votes", "weak_label", "score", "kept"])

    return few.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema[:k]] + ["n_bad_votes long", "weak_label double", "score double", "kept boolean"]))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with the columns of ``docs``."""
    names = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    kept = judged(renamed, f"c{names.index(text)}", tuple(renamed.columns)).filter("kept")
    return kept.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
