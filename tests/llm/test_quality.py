import re
import tracemalloc

import numpy as np

from skyloom.llm import quality_classifier, quality_rules
from skyloom.llm.hashed import fitted


def base(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = {}
    for i in range(len(words) - 7):
        runs.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {k for at in runs.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed


def test_rules_against_brute_force(odd, empty):
    f = quality_rules.with_features(odd)
    rows = quality_rules.judged(f).select("doc_id", "text", "_q", "_q_v").collect()
    for r in rows:
        q = r["_q"]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, r["_q_v"].base_failed) == base(r.text), r.text and r.text[:40]
        assert not (r["_q_v"].base_failed and r["_q_v"].kept)
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["_q_v"].kept for r in rows)
    assert quality_rules.keep_good(empty).count() == 0


def test_rules_run_no_python(odd):
    plan = quality_rules.judged(quality_rules.with_features(odd))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def corpus(spark, bad):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 9))) for _ in range(600)]
    text = lambda: ". ".join(" ".join(rng.choice(vocabulary, 9)).capitalize() for _ in range(10)) + "."
    rows = [(i, text(), 1) for i in range(300)]
    for i in range(bad):
        t = text()
        rows.append((1000 + i, (t.upper().replace(" ", "!! "), t.replace(" ", "*** "), " ".join(x for w in t.split()[:20] for x in [w] * 8))[i % 3], 0))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)


def test_held_out_accuracy(spark):
    docs = corpus(spark, 45)
    truth = {r.doc_id: r.quality for r in docs.collect()}
    got = quality_classifier.judged(docs).collect()
    assert np.mean([r.kept == bool(truth[r.doc_id]) for r in got]) > 0.98
    assert all(0 <= r.score <= 1 and 0 <= r.weak_label <= 1 for r in got)
    rules = quality_rules.keep_good(docs).collect()
    assert {r.doc_id for r in rules} == {i for i, q in truth.items() if q}


def plain_em(op, names, patterns):
    """Counts by vote pattern -> shares of good and of each kind of bad, and rates of bad votes; loops over patterns, kinds and rules."""
    rules, kinds = range(len(names)), range(len(op.THEMES) + 1)
    inside = [[k > 0 and names[j] in op.THEMES[k - 1] for j in rules] for k in kinds]
    start = [[op.ON_GOOD if k == 0 else op.WITHIN if inside[k][j] else op.BEYOND for j in rules] for k in kinds]
    first = [1 - op.KIND * len(op.THEMES)] + [op.KIND] * len(op.THEMES)
    share, rate = first, start
    n = sum(patterns.values())
    for _ in range(op.ITERATIONS):
        post = {}
        for v in patterns:
            p = []
            for k in kinds:
                x = share[k]
                for j in rules:
                    x *= rate[k][j] if v[j] < 0 else 1 - rate[k][j] if v[j] > 0 else 1
                p.append(x)
            post[v] = [x / sum(p) for x in p]
        weight = lambda k, js, of: sum(c * post[v][k] for v, c in patterns.items() for j in js if of(v[j]))  # noqa: E731, B023
        share = [(sum(c * post[v][k] for v, c in patterns.items()) + op.PSEUDO * first[k]) / (n + op.PSEUDO) for k in kinds]
        new = []
        for k in kinds:
            row = []
            for j in rules:
                js = [j] if k == 0 or inside[k][j] else [i for i in rules if not inside[k][i]]
                row.append((weight(k, js, lambda y: y < 0) + op.PSEUDO * start[k][j]) / (weight(k, js, lambda y: y != 0) + op.PSEUDO))
            if k:
                own = [x for j, x in enumerate(row) if inside[k][j]]
                lift = max(0, (op.BROKEN - sum(own)) / (len(own) - sum(own)))
                row = [max(new_good[j], x + (1 - x) * lift * inside[k][j]) for j, x in enumerate(row)]
            if k == 0:
                new_good = row
            new.append([min(0.9999, max(0.0001, x)) for x in row])
        rate = new
    return share, rate


def some_patterns(rules, seed):
    rng = np.random.default_rng(seed)
    bad = rng.random(400) < 0.3
    v = np.where(rng.random((400, rules)) < np.where(bad[:, None], 0.5, 0.03), -1, 1) * (rng.random((400, rules)) < 0.8)
    counts = {}
    for row in v.tolist():
        counts[tuple(row)] = counts.get(tuple(row), 0) + 1
    return counts


def test_em_of_the_rules_against_plain_loops(spark):
    q = quality_rules
    counts = some_patterns(len(q.RULES), 1)
    df = spark.createDataFrame([(list(v),) for v, n in counts.items() for _ in range(n)], "v array<int>").repartition(5)
    state = q.em_parameters(df, "v").first().state
    share, rate = plain_em(q, q.RULES, counts)
    assert np.allclose(state, share + sum(rate, []), atol=1e-9) and max(rate[0]) > 0.01
    assert q.em_parameters(df.repartition(2), "v").first().state == state  # whatever the tasks


def test_em_of_the_classifier_against_plain_loops():
    q = quality_classifier
    counts = some_patterns(len(q.LABELLERS), 2)
    v = np.array(list(counts))
    labels = q.Labels(q.pattern(v), np.array(list(counts.values())))
    share, rate = plain_em(q, q.LABELLERS, counts)
    assert np.allclose(labels.share, share, atol=1e-9) and np.allclose(labels.rate, rate, atol=1e-9)
    assert (q.unpattern(q.pattern(v)) == v).all()


def test_measures_against_brute_force(odd):
    import pyarrow as pa

    texts = [r.text for r in odd.collect()]
    got = quality_classifier.measures(pa.array(texts, pa.string()))
    for text, m in zip(texts, got, strict=True):
        t = (text or "").encode()
        w = re.findall(rb"[^\x20\x09-\x0D]+", t)
        low = [x.lower() for x in w]
        n, size = max(1, len(w)), max(1, sum(map(len, w)))
        pairs = list(zip(low, low[1:]))
        lines = [x for x in t.split(b"\n") if x.strip()] if b"\n" in t else []
        again = len(lines) - len(set(lines))
        special, letters = rb"[#*$%&|<>{}~^\\=_]", rb"[0-9A-Za-z\x80-\xff]"
        want = [len(w), len(re.findall(special, t)) / n, t.count(b"!") / n, len(re.findall(rb"[A-Z]", t)) / size, sum(a == b for a, b in pairs) / n, 1 - len(set(pairs)) / len(pairs) if pairs else 0, sum(map(len, w)) / n]
        want += [again / len(lines) if again >= 3 else 0, sum(bool(re.search(special, x)) for x in w) / n, sum(not re.search(letters, x) for x in w) / n, 1 - sum(len(re.findall(letters, x)) for x in w) / size if w else 0, len(w) ** 0.5 / len(set(low)) if len(w) >= 30 else 0.35]
        assert np.allclose(m, want), (text or "")[:50]


def test_a_rule_that_is_alone_is_outvoted(spark):
    """A fifth of the good texts has exclamation marks all over: one bad vote each, which all-must-pass would drop."""
    docs = corpus(spark, 45)
    loud = docs.filter("quality = 1 and doc_id % 5 = 0").selectExpr("doc_id", "regexp_replace(text, '([a-z]+ [a-z]+) ', '$1! ') as text", "quality")
    docs = loud.unionAll(docs.filter("not (quality = 1 and doc_id % 5 = 0)"))
    f = quality_rules.with_features(docs)
    rows = quality_rules.judged(f).select("doc_id", "quality", "_q_v.*").collect()
    alone = [r for r in rows if r.quality and -1 in r.votes]
    assert len(alone) >= 50 and all(r.kept for r in alone)
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in rows if r.quality}
    got = {r.doc_id: r for r in quality_classifier.judged(docs).collect()}
    assert sum(got[r.doc_id].n_bad_votes > 0 for r in alone) >= 50 and np.mean([got[r.doc_id].kept == bool(r.quality) for r in rows]) > 0.98


def test_clean_corpus_stays(spark):
    docs = corpus(spark, 0)
    assert quality_classifier.keep_good(docs).count() == 300 and quality_rules.keep_good(docs).count() == 300


def test_classifier_odd_rows(odd, empty):
    assert quality_classifier.judged(odd).count() == odd.count()
    assert quality_classifier.keep_good(odd).columns == odd.columns
    assert quality_classifier.judged(empty).count() == 0


def test_blanks_and_copies_are_sampled_at_their_share(spark, monkeypatch):
    """Blank texts and copies don't crowd the other texts out of the scorer's sample."""
    monkeypatch.setattr(quality_classifier, "SAMPLE", 60)
    seen = []
    real = quality_classifier.fitted
    monkeypatch.setattr(quality_classifier, "fitted", lambda x, y, weight, *more: seen.append((len(x), y, weight)) or real(x, y, weight, *more))
    docs = corpus(spark, 300).selectExpr("doc_id", "text").unionAll(spark.range(5000, 5600).selectExpr("id as doc_id", "if(id % 2 = 0, null, ' ') as text"))
    copies = spark.range(400).selectExpr("cast(null as long) as doc_id", "repeat('same words here again ', 12) as text")
    for part in (1, 5):
        got = quality_classifier.judged(docs.unionAll(copies).repartition(part))
        truth = {r.doc_id: (r.score, r.kept) for r in got.filter("doc_id < 2000").collect()}
        assert len(truth) == 600 and sum(kept == (i < 1000) for i, (_, kept) in truth.items()) > 0.9 * 600
        seen.append(truth)
    (n, _, _), first, _, second = seen
    assert 60 < n < 180 and all(abs(first[i][0] - second[i][0]) < 1e-6 for i in first)


def test_lots_of_copies():
    key, copies = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x12345678912345), np.array([1, 500] * 1000)
    times = quality_classifier.drawn(key, copies, np.full(2000, 0.1))
    assert abs(times[::2].mean() - 0.1) < 0.04 and abs(times[1::2].mean() - 50) < 1 and times[1::2].min() > 15


def test_the_fit_keeps_one_copy_of_the_sample():
    rng = np.random.default_rng(3)
    for loss, y in (("logistic", rng.random(1500)), ("svm", rng.choice([-1.0, 1.0], 1500))):
        x = rng.random((1500, 1000), np.float32)
        wide, weight, size = x.astype(np.float64), rng.random(1500) + 0.5, x.nbytes
        tracemalloc.start()
        w, b = fitted(x, y, weight, loss)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < size / 4  # a copy in doubles takes twice the sample
        w64, b64 = fitted(wide, y, weight, loss)
        assert np.abs(w - w64).max() < 1e-3 * np.abs(w64).max() and abs(b - b64) < 1e-3 * np.abs(w64).sum()
