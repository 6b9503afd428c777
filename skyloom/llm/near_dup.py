"""Operator 3, near duplicates by MinHash with tensored banding, confirmed on full shingle sets.

A text's set holds its distinct five-word shingles. SIDE elements on each of two sides, an element being WIDTH minhashes, make SIDE * SIDE
tables: a table's key joins one element of the first side with one of the second, so 2 * SIDE * WIDTH minhashes serve where plain banding
needs SIDE * SIDE * 2 * WIDTH. Two texts meet if they share an element on both sides: at a similarity s with a chance of
(1 - (1 - s**WIDTH)**SIDE)**2, 0.9999 at 0.85 and 0.9994 at 0.8. The product is taken only of elements that two different sets share, so a text without
a partner costs 2 * SIDE rows and no table key.

Equal sets are one class from the start (min and max of a group's fingerprints tell whether it holds two). Links between classes:
1. Rounds of representatives: in each table bucket every class is compared with two representatives, in an order that each round draws anew,
   unless both are in one component already. Rows grow with the bucket's size, never with its square.
2. Whatever is still in two components within a bucket goes through an exact prefix and position filter, rarest shingles first; only pairs
   across components come out, so a component's own pairs don't. The most promising ones are confirmed first, then those still across.
Every pair is confirmed by its intersection. Both steps end with connected components, written to the shared folder.

Classes with many copies (HOT rows and more, MOST_HOT classes at most) get their component by a broadcast, so no task has all copies of a text.

Defined cases: a null, empty or wordless text has an empty set and is its own component; fewer than five words are one shingle; equal rows
are one class; rows that share a doc_id share its fate; a row with a null doc_id joins its class, links others like any text, is named by the
smallest id there (null if none) and is always kept; an empty table gives an empty result; only the id and the text are read, so other names
can't clash. Shingles are compared by 64-bit fingerprints, sets by two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.components import components
from skyloom.llm.scratch import materialize
from skyloom.llm.textops import Words, mix, slices
from skyloom.shipping import ship

#: Words of a shingle, and from which similarity in percent texts are near duplicates; the contract of the query says 85.
WORDS, PERCENT, QUERY_PERCENT = 5, 80, 85
SIDE, WIDTH, ROUNDS, FIRST = 8, 2, 3, 3
#: A class is hot from HOT rows on, and from a MOST_HOT-th of all rows.
HOT, MOST_HOT = 1000, 10_000
_RNG = np.random.default_rng(31)
_XOR = _RNG.integers(0, 2**63, 2 * SIDE * WIDTH, dtype=np.uint64)
_TIMES = _RNG.integers(0, 2**63, 2 * SIDE * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_Q = np.multiply.accumulate(np.full(WORDS, 0xC2B2AE3D27D4EB4F, np.uint64))


def shingle_sets(w: Words, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, and where each text's begin."""
    h, first = w.hash, w.first
    size = np.diff(first)
    if len(h) >= words:
        n = len(h) - words + 1
        runs = np.zeros(n, np.uint64)
        for j in range(words):
            runs += h[j : j + n] * _Q[j % WORDS]
        runs = mix(runs)
    out, length = [], np.zeros(len(size), np.int64)
    for i in np.flatnonzero(size).tolist():
        a, b = int(first[i]), int(first[i + 1])
        if b - a < words:
            s = mix((h[a:b] * _Q[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            s = np.sort(runs[a : b - words + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        out.append(s)
        length[i] = len(s)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(length)])


def _prints(values: np.ndarray, first: np.ndarray, full: np.ndarray, seed: int = 0xA5A5A5A55A5A5A5A) -> np.ndarray:
    """A fingerprint of each non-empty set."""
    return mix(np.add.reduceat(mix(values ^ np.uint64(seed)), first[full]) + np.diff(first)[full].astype(np.uint64))


def _second(values: np.ndarray, first: np.ndarray, full: np.ndarray) -> np.ndarray:
    return _prints(values, first, full, 0x3C6EF372FE94F82B)


def _elements(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One row of 2 * SIDE elements for each set."""
    out = np.empty((len(start), 2 * SIDE), np.uint64)
    for e in range(2 * SIDE):
        key = np.full(len(start), e + 1, np.uint64)
        for k in range(e * WIDTH, (e + 1) * WIDTH):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((values ^ _XOR[k]) * _TIMES[k], start))
        out[:, e] = key
    return out


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, print, second, elements, raw): two fingerprints of the set, null for an empty one, its elements, and the first again."""
    ship(docs.sparkSession)
    few = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                values, first = shingle_sets(Words(batch.column(1), Words.SPACE))
                size = np.diff(first)
                full = np.flatnonzero(size)
                mark, second = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
                rows = np.empty(0, np.int64)
                if len(full):
                    mark[full] = _prints(values, first, full).view(np.int64)
                    second[full] = _second(values, first, full).view(np.int64)
                    rows = _elements(values, first[:-1][full]).view(np.int64).ravel()
                at = np.concatenate([[0], np.cumsum((size > 0) * 2 * SIDE)])
                none = size == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(size, pa.int64()), pa.array(mark, mask=none), pa.array(second, mask=none), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(rows, pa.int64()))],
                    names=["doc_id", "n_shingles", "print", "second", "elements"],
                )

    return few.mapInArrow(run, f"doc_id {few.schema[0].dataType.simpleString()}, n_shingles long, print long, second long, elements array<long>").withColumn("raw", F.col("print"))


def table_keys(signed: DataFrame) -> DataFrame:
    """(key, print, n) of the tables, n being the set's size, for classes that share an element on both sides with another class."""
    sides = signed.filter("print is not null").select("print", F.col("n_shingles").alias("n"), F.posexplode("elements").alias("e", "v"))
    shared = sides.groupBy("e", "v").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).filter("lo != hi").select("e", "v")
    own = sides.join(shared, ["e", "v"]).groupBy("print").agg(F.max("n").alias("n"), F.collect_set(F.struct("e", "v")).alias("s"))
    a, b = (f"filter(s, x -> x.e {op} {SIDE})" for op in ("<", ">="))
    return own.select("print", "n", F.expr(f"explode(flatten(transform({a}, x -> transform({b}, y -> xxhash64(x.e, y.e, x.v, y.v)))))").alias("key"))


def _bounded(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def representatives(keys: DataFrame, turn: int, percent: int = PERCENT) -> DataFrame:
    """Pairs of each member (key, print, n, label) with its bucket's first and last one, in the order of this turn, across labels and only if
    their sizes allow the similarity."""
    me = F.struct(F.xxhash64("print", F.lit(turn)).alias("o"), "print", "label", "n")
    ends = keys.groupBy("key").agg(F.min(me).alias("lo"), F.max(me).alias("hi"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 != l1").select("key", F.array("lo", "hi").alias("ends"))
    sized = lambda x: 100 * F.least(x["n"], F.col("n")) >= percent * F.greatest(x["n"], F.col("n"))
    met = keys.join(ends, "key").select("print", F.explode(F.filter("ends", lambda x: (x["label"] != F.col("label")) & sized(x))).alias("x"))
    return _bounded(met.select(F.col("print").alias("a"), F.col("x.print").alias("b")))


def sets_of(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(print, n, s): the sets of the classes in ``wanted`` (rep, print, raw, second), from the text of the document that represents each, or
    from any of the rows without id where a class has no other."""
    own = docs.select(docs[f"`{doc_id}`"].alias("rep"), docs[f"`{text}`"].alias("_text"))
    named = own.join(wanted.select("rep", "print", "raw", "second"), "rep").select("print", "raw", "second", "_text")
    nameless = own.filter("rep is null").select(*(F.lit(None).cast("long").alias(c) for c in ("print", "raw", "second")), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                values, first = shingle_sets(Words(batch.column(3), Words.SPACE))
                full = np.flatnonzero(np.diff(first))
                if not len(full):
                    continue
                raw, second = _prints(values, first, full).view(np.int64), _second(values, first, full).view(np.int64)
                if batch.column(0).null_count:  # rows without id: all of them, each set once
                    _, once = np.unique(np.stack([raw, second]), axis=1, return_index=True)
                    right, raw, second = full[once], raw[once], second[once]
                    mark = pa.nulls(len(right), pa.int64())
                else:
                    fits = (raw == batch.column(1).to_numpy()[full]) & (second == batch.column(2).to_numpy()[full])
                    right, raw, second = full[fits], raw[fits], second[fits]
                    mark = batch.column(0).take(pa.array(right, pa.int64()))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64))).take(pa.array(right, pa.int64()))
                yield pa.RecordBatch.from_arrays([mark, pa.array(raw), pa.array(second), pa.array(np.diff(first)[right], pa.int64()), lists], names=["print", "raw", "second", "n", "s"])

    kinds = "print long, raw long, second long, n long, s array<long>"
    found = named.mapInArrow(run, kinds).select("print", "n", "s")
    others = nameless.mapInArrow(run, kinds).groupBy("raw", "second").agg(F.first("n").alias("n"), F.first("s").alias("s"))
    lacking = wanted.filter("rep is null").select("print", "raw", "second")
    return found.unionAll(others.join(lacking, ["raw", "second"]).select("print", "n", "s"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar enough, by their full sets."""
    one = sets.select(F.col("print").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    two = sets.select(F.col("print").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.filter(f"100 * both >= {percent} * (na + nb - both)").select("a", "b").distinct()


def _labelled(keys: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return keys.select("key", "print", "n", F.col("print").alias("label"))
    return keys.join(labels.withColumnRenamed("node", "print"), "print", "left").select("key", "print", "n", F.coalesce("label", "print").alias("label"))


def across(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b, shared) with different labels that can be similar enough; members: (print, label).

    Shingles are ordered by how few sets hold them. The first one that a similar pair shares leaves enough room in both sets for the overlap
    that the pair needs, so a set need only be known under its first shingles: fewer for the smaller of a pair than for the larger one.
    """
    own = sets.join(members, "print").select("print", "label", "n", F.explode("s").alias("h"))
    often = own.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    first = own.join(often, "h").groupBy("print", "label", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))
    rare = first.select("print", "label", "n", F.posexplode(F.expr(f"slice(hs, 1, int(n - ({percent} * n + 99) div 100 + 1))")).alias("at", "x"))
    rare = materialize(rare.select("print", "label", "n", "at", F.col("x.h").alias("h")), "prefix")
    heads = rare.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    held = rare.join(heads.select("h", F.col("m.label").alias("major")), "h")
    two = 100 + percent  # a pair of sizes x and y needs an overlap of percent * (x + y) / (100 + percent)
    need = f"({percent} * (x.n + y.n) + {two - 1}) div {two}"
    fit = f"x.label != y.label and 100 * x.n >= {percent} * y.n and (x.n < y.n or (x.n = y.n and x.print < y.print)) and x.at + {need} <= x.n and y.at + {need} <= y.n"
    small = held.filter(f"at + ({2 * percent} * n + {two - 1}) div {two} <= n")
    # pairs of two texts of a shingle's most frequent component don't occur: one side is of another one
    met = [
        left.alias("x").join(right.alias("y"), F.expr(f"x.h = y.h and {fit}")).select(F.col("x.print").alias("a"), F.col("y.print").alias("b"))
        for left, right in ((small.filter("label != major"), held), (small.filter("label = major"), held.filter("label != major")))
    ]
    pairs = met[0].union(met[1]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def _ranked(pairs: DataFrame) -> DataFrame:
    """Candidates with first: whether they are among the FIRST most promising ones of either side, by shared rare shingles."""
    rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("shared"), "a", "b"))
    return pairs.withColumn("ra", rank("a")).withColumn("rb", rank("b")).select("a", "b", (F.least("ra", "rb") <= FIRST).alias("first"))


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``."""
    signed = materialize(signatures(docs, text, doc_id), "signatures")
    classes = _classes(signed)
    if not (clash := classes.filter("second != other")).isEmpty():  # different sets with one fingerprint get one from both
        again = F.col("again").isNotNull()
        signed = signed.join(clash.select("print", F.lit(1).alias("again")), "print", "left").withColumn("print", F.when(again, F.xxhash64("print", "second")).otherwise(F.col("print"))).drop("again")
        signed = materialize(signed, "signatures")
        classes = _classes(signed)
    keys = materialize(table_keys(signed), "keys")
    wanted = keys.select("print").distinct().join(classes, "print")
    sets = materialize(sets_of(docs, wanted, text, doc_id), "sets")
    links, labels = None, None
    for turn in range(ROUNDS):
        found = confirmed(representatives(_labelled(keys, labels), turn, percent), sets, percent)
        links = materialize(found if links is None else links.union(found), "confirmed")
        labels = components(links)
    open_ = _labelled(keys, labels)
    mixed = open_.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 != l1").select("key")
    members = open_.join(mixed, "key").select("print", "label").distinct()
    left = materialize(_ranked(across(members, sets, percent)), "candidates")
    # the most promising pairs join most components, so that of the others few are still across two
    for part in (left.filter("first"), left.filter("not first")):
        for side in ("a", "b"):
            part = part.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side, "left")
        part = part.filter("coalesce(la, a) != coalesce(lb, b)").select("a", "b")
        found = materialize(confirmed(part, sets, percent), "confirmed")
        if not found.isEmpty():
            links = links.union(found)
            labels = components(links)
    joined = classes.join(labels.withColumnRenamed("node", "print"), "print")
    named = joined.groupBy("label").agg(F.min("rep").alias("component"))
    linked = labels.join(named, "label").select(F.col("node").alias("print"), "component")
    names = materialize(classes.join(linked, "print", "left").select("print", F.coalesce("component", "rep").alias("component"), "copies"), "names")
    rows = signed.select("doc_id", "n_shingles", "print")
    most = max(HOT, (names.agg(F.sum("copies")).first()[0] or 0) // MOST_HOT)
    hot = names.filter(F.col("copies") >= most).select("print", "component")  # MOST_HOT classes at most
    out = rows.join(F.broadcast(hot), "print").unionByName(rows.filter("print is null").withColumn("component", F.col("doc_id")))
    out = out.unionByName(rows.filter("print is not null").join(F.broadcast(hot.select("print")), "print", "left_anti").join(names.filter(F.col("copies") < most).drop("copies"), "print"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False))).alias("kept"))


def _classes(signed: DataFrame) -> DataFrame:
    """(print, raw, second, other, rep, copies): classes of equal sets; second and other differ where sets share a fingerprint by chance."""
    own = signed.filter("print is not null").groupBy("print")
    return materialize(own.agg(F.min("raw").alias("raw"), F.min("second").alias("second"), F.max("second").alias("other"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component."""
    names = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key = f"c{names.index(doc_id)}"
    gone = find(docs, text, doc_id, percent).filter("not kept").select(F.col("doc_id").alias(key)).distinct()
    return renamed.join(gone, key, "left_anti").select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=QUERY_PERCENT)


SQL = rf"""
with recursive d as materialized (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i : i + {WORDS - 1}], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) as i from d where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
l as materialized (select x.a, x.b from (select p.doc_id as a, q.doc_id as b, count(*) as k from s p join s q on p.s = q.s and p.doc_id <> q.doc_id group by all) x
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= {QUERY_PERCENT} * (na.n + nb.n - k)),
r as (select doc_id as v, doc_id as c from d union select l.b, r.c from r join l on r.v = l.a),
c as (select v, min(c) as c from r group by v)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.c as component_id, d.doc_id = c.c as kept from d join c on c.v = d.doc_id left join n on n.doc_id = d.doc_id"""
