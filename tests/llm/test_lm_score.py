import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import lm_score as op

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None]


def test_base_against_brute_force(odd):
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = odd.withColumn("_held", F.pmod(F.crc32(key.cast("binary")), F.lit(10)) == 0)
    got = op.scored(docs, text="text").collect()
    rows = odd.collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter(w for r in rows if not held(r.doc_id) for w in words(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted(((r.doc_id, held(r.doc_id), len(words(r.text)), sum(c[w] > 0 for w in words(r.text)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(r.text)), 5)) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=repr) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_filter_counts():
    rng = np.random.default_rng(3)
    h, c = np.unique(rng.integers(0, 2**63, 20000, dtype=np.uint64)), rng.zipf(1.5, 20000).clip(1, 10**6)
    c = c[: len(h)]
    f = op.Filter(8, 200_000, 1)
    part = op._part(h, 8)
    for p in range(8):
        f.data[p * f.stride : (p + 1) * f.stride] = f.segment(h[part == p], c[part == p])
    got = f.count(h)
    sure = c >= 2
    assert (got[sure] >= 1.4 * 2.0 ** np.floor(np.log2(c[sure])) - 1e-9).all()  # a Bloom filter forgets nothing
    exact = got[sure] == 1.4 * 2.0 ** np.floor(np.log2(c[sure]))
    assert exact.mean() > 0.93
    assert (f.count(rng.integers(0, 2**63, 20000, dtype=np.uint64)) > 0).mean() < 0.05


def test_blocks_round_trip():
    h, c = op.summed(np.array([5, 3, 5, 2**63 + 1, 3, 5], np.uint64))
    assert h.tolist() == [3, 5, 2**63 + 1] and c.tolist() == [2, 3, 1]
    assert [x.tolist() for x in op.unpack(op.pack(h, c))] == [h.tolist(), c.tolist()]


def test_fluent_text_scores_higher(spark):
    rows = [(i, "the cat sat on the mat and the dog sat on the rug") for i in range(200)]
    rows += [(1000, "the cat sat on the rug"), (1001, "rug the on sat cat the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_held", F.col("doc_id") >= 1000)
    s = {r.doc_id: r.score for r in op.scored(docs, text="text").filter("doc_id >= 1000").collect()}
    assert s[1000] > s[1001] + 2


def test_empty(empty):
    assert op.scored(empty.withColumn("_held", F.lit(False)), text="text").count() == 0


def exact_model(train, weight=op.WEIGHT):
    """The score by plain loops: counts up to a factor of two, back-off shares over all training tokens."""
    uni = collections.Counter(w for t in train for w in words(t))
    bi = collections.Counter(p for t in train for p in zip([None, *words(t)[:-1]], words(t)))
    n, v = sum(uni.values()), len(uni)
    about = lambda c: 1.4 * 2.0 ** math.floor(math.log2(c)) if c else 0.0
    seen, kept = collections.Counter(), collections.Counter()
    for t in train:
        for a, b in zip([None, *words(t)[:-1]], words(t)):
            seen[math.floor(math.log2(uni[a]))] += 1
            kept[math.floor(math.log2(uni[a]))] += 1  # every training bigram is known

    def score(text):
        out = 0.0
        for a, b in zip([None, *words(text)[:-1]], words(text)):
            context, both = about(uni[a]), min(about(bi[a, b]), about(uni[a]))
            p = (about(uni[b]) + 0.1) / (n + 0.1 * (v + 1))
            if context:
                level = math.floor(math.log2(uni[a]))
                p = weight * both / context + (1 - weight * (kept[level] / seen[level] if seen[level] else 0.0)) * p
            out += math.log10(min(p, 1.0))
        return out

    return score


def some_texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 60)).clip(1, 3000)) for _ in range(n)]


def test_score_against_exact_counts(spark, monkeypatch):
    """With a roomy filter nothing is found that isn't there, so scores are those of the exact counts, in one pass or in many."""
    monkeypatch.setattr(op, "BITS", 64)
    texts = some_texts(400, 1)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("_held", F.col("doc_id") % 10 == 0).repartition(3)
    score = exact_model([t for i, t in enumerate(texts) if i % 10])
    for pass_bytes in (None, 1500):
        got = op.scored(docs, text="text", pass_bytes=pass_bytes).collect()
        assert len(got) == 400
        for r in got:
            assert abs(r.score - score(texts[r.doc_id])) < 1e-6, r.doc_id


def test_the_real_filter_errs_little(spark):
    texts = some_texts(600, 2)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("_held", F.col("doc_id") % 10 == 0)
    score = exact_model([t for i, t in enumerate(texts) if i % 10])
    got = op.scored(docs, text="text").collect()
    off = [abs(r.score - score(texts[r.doc_id])) / r.n_tokens for r in got]
    assert np.mean(off) < 0.05 and max(off) < 0.5


def test_passes_over_groups_are_the_whole_filter(spark):
    merged, parts, *_ = op.trained(spark.createDataFrame([(t,) for t in some_texts(200, 3)], "_text string").repartition(2))
    (whole,) = op.filters(merged, parts)
    groups = list(op.filters(merged, parts, 2 * whole.stride))
    assert len(groups) == parts // 2 and all(len(g.data) <= 2 * whole.stride for g in groups)
    h = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    h = np.concatenate([h, op.tokens(op.pa.array(some_texts(50, 3)))[0]])
    assert (np.max([g.level(h) for g in groups], axis=0) == whole.level(h)).all() and whole.level(h).max() > 3


def test_merging_as_blocks_come(spark, monkeypatch):
    """A part that collapses its blocks again and again has the counts of one that does so once."""
    df = spark.createDataFrame([(t,) for t in some_texts(300, 4)], "_text string").repartition(6)
    monkeypatch.setattr(op, "FLUSH_TOKENS", 100)
    rows = {(r.n, r.part): op.unpack(bytes(r.block)) for r in op.counted(df, 16).collect()}
    want = collections.Counter(w for t in some_texts(300, 4) for w in words(t))
    got = collections.Counter()
    for (n, _), (h, c) in rows.items():
        assert (h[1:] > h[:-1]).all()
        if n == 1:
            got.update(c.tolist())
    assert got == collections.Counter(want.values())


def test_what_occurs_once_counts(spark):
    rows = [(i, "the cat sat on the mat and the dog sat on the rug") for i in range(200)]
    rows += [(500, "a zebra yawned"), (1000, "a zebra yawned"), (1001, "a quokka yawned"), (1002, "yawned zebra a"), (1003, "the zebra"), (1004, "the quokka")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_held", F.col("doc_id") >= 1000)
    s = {r.doc_id: r.score for r in op.scored(docs, text="text").filter("doc_id >= 1000").collect()}
    assert s[1000] > s[1001] + 1 and s[1000] > s[1002] + 1 and s[1003] > s[1004] + 0.5


def test_the_filter_grows_with_the_counts(spark):
    size = []
    for n in (2000, 20000):
        merged, parts, *_ = op.trained(spark.createDataFrame([(f"a{i} b{i}",) for i in range(n)], "_text string"))
        (grams,) = op.filters(merged, parts)
        uni, bi = grams.levels(*op.tokens(op.pa.array([f"a{i} b{i}" for i in range(0, n, 7)])))
        assert (uni > 0).all() and (bi > 0).all()
        size.append(len(grams.data))
    assert size[1] > 5 * size[0]
