"""Operator 4, language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Both steps vote with pairwise linear support vector machines over hashed byte n-grams of the whole text. Families are those of public
linguistics (FAMILIES); a language that isn't listed is a family of its own. The machines learn from a sample of labelled rows: of each
language about SAMPLE at most, fewer (but FEWEST) where all languages together would have more than ALL. Every language is learned; the
bounds hold for the fit alone, and every row is predicted.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without lang teach nothing; with one language only, that is
predicted; without any, ``und``; a null doc_id counts as the id with the empty text; equal rows get equal results; an empty table gives an empty
result; only doc_id, text and lang are read, and lang in training rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.hashed import DIMENSIONS, dense, fitted, scores, sparse, vectors
from skyloom.llm.textops import slices
from skyloom.shipping import ship

SAMPLE, FEWEST, ALL, AT_ONCE = 400, 40, 40_000, 32
_BY_FAMILY = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt",
    "indic": "hi bn mr gu pa ne ur si",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "sinitic": "zh yue",
    "semitic": "ar he mt am",
    "iranian": "fa ku ps tg",
    "austronesian": "id ms tl jv",
    "dravidian": "ta te kn ml",
}
FAMILIES = {lang: family for family, langs in _BY_FAMILY.items() for lang in langs.split()}


class Votes:
    """Pairwise machines between classes; a class's margin is the sum over its pairs."""

    def __init__(self, classes: list[str]):
        self.classes, self.pairs = classes, list(combinations(range(len(classes)), 2))
        self.weights, self.biases = np.zeros((DIMENSIONS, len(self.pairs))), np.zeros(len(self.pairs))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Votes:
        for k, (a, b) in enumerate(self.pairs):
            own = (y == a) | (y == b)
            sign = np.where(y[own] == a, 1.0, -1.0)
            share = np.where(sign > 0, 1.0 / max(1, (sign > 0).sum()), 1.0 / max(1, (sign < 0).sum()))
            self.weights[:, k], self.biases[k] = fitted(x[own], sign, share, "svm")
        return self

    def choose(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class with most votes (margins break ties) and the confidence: the least logistic value among its own pairs."""
        n, k = len(margins), len(self.classes)
        votes, sure = np.zeros((n, k)), np.ones((n, k))
        for j, (a, b) in enumerate(self.pairs):
            m = margins[:, j]
            near = 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
            votes[:, a] += (m > 0) + 1e-3 * np.tanh(m)
            votes[:, b] += (m <= 0) - 1e-3 * np.tanh(m)
            sure[:, a], sure[:, b] = np.minimum(sure[:, a], near), np.minimum(sure[:, b], 1 - near)
        best = votes.argmax(1)
        return best, sure[np.arange(n), best]


class LanguageModel:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        family = {lang: FAMILIES.get(lang.lower().split("-")[0], f"one:{lang}") for lang in self.langs}
        names = sorted(set(family.values()))
        y = np.array([names.index(family[v]) for v in langs], int)
        self.families = Votes(names).fit(x, y)
        self.within = []
        for f, name in enumerate(names):
            own = [v for v in self.langs if family[v] == name]
            rows = np.flatnonzero(y == f)
            self.within.append(Votes(own).fit(x[rows], np.array([own.index(langs[i]) for i in rows], int)))
        every = [self.families, *self.within]
        self.weights = np.concatenate([v.weights for v in every], 1).astype(np.float32)
        self.biases = np.concatenate([v.biases for v in every])
        for v in every:
            del v.weights, v.biases  # what is broadcast has each weight once

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(column)
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        m = scores(column, self.weights) + self.biases
        k = len(self.families.pairs)
        f, sure = self.families.choose(m[:, :k])
        out, score = np.full(n, "und", object), np.zeros(n)
        for i, votes in enumerate(self.within):
            rows = np.flatnonzero(letters & (f == i))
            best, more = votes.choose(m[rows, k : k + len(votes.pairs)])
            out[rows] = np.array(votes.classes, object)[best]
            score[rows] = sure[rows] * more
            k += len(votes.pairs)
        return out.tolist(), score


def train(labelled: DataFrame) -> LanguageModel:
    """A model from (text, lang, key) rows; key spreads the sample."""
    rows = labelled.filter("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return LanguageModel(np.zeros((0, DIMENSIONS), np.float32), [])
    each = max(FEWEST, min(SAMPLE, ALL // len(counts)))
    shares = rows.sparkSession.createDataFrame([(lang, int(min(1.0, each / n) * (1 << 30))) for lang, n in counts.items()], "lang string, share long")
    some = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("key", F.lit(4)), F.lit(1 << 30)) < F.col("share")).select("text", "lang")  # a row a language

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 18):
                for lo in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(lo, AT_ONCE)
                    yield pa.RecordBatch.from_arrays([part.column(1), pa.array([sparse(x) for x in vectors(part.column(0))], pa.binary())], names=["lang", "x"])

    got = some.mapInArrow(look, "lang string, x binary").limit(2 * each * len(counts)).collect()  # bounded by the sample
    x = np.empty((len(got), DIMENSIONS), np.float32)
    for i, r in enumerate(got):
        x[i] = dense(bytes(r.x), DIMENSIONS)
    return LanguageModel(x, [r.lang for r in got])


def identified(docs: DataFrame, model: LanguageModel, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    few = docs.select(*(f"`{c}`" for c in carry), docs[f"`{text}`"].alias("_text"))
    k = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                lang, score = sent.value.predict(batch.column(k))
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(lang, pa.string()), pa.array(score)], names=[*carry, "lang_pred", "score"])

    return few.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema[:k]] + ["lang_pred string", "score double"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    held = F.pmod(F.crc32(key.cast("binary")), F.lit(4)) == 2
    model = train(docs.filter(~held).select("text", "lang", key.alias("key")))
    return identified(docs.select("doc_id", held.alias("held_out"), "text"), model, carry=("doc_id", "held_out"))
