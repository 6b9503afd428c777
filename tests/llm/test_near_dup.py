import random
import re

from skyloom.llm import near_dup as op
from skyloom.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=80):
    """doc_id -> (set size, smallest id of its component), for distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 160))]
        for _ in range(rng.randint(1, 14)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append(" ".join(t))
    rows += [rows[0], "a b", "a b", "a  B", "b a", "", None, " ", "one two three four five"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    for percent in (80, 85):
        got = op.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_crowd_at_the_threshold(spark):
    """Copies of one text with so many edits that about half of the pairs are links: the residual step has to find those that rounds miss. At 85 %."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(150)] = f"e{i}_{rng.randrange(99)}"
        rows.append((i, " ".join(t)))
    got = op.find(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 85)


def test_odd_rows(odd, empty):
    got = op.find(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[6].component_id, by[7].component_id, by[8].component_id, by[7].kept) == (6, 6, 6, False)
    assert by[0].component_id == 0 and by[1].component_id == 1 and by[0].kept
    assert sorted((r.component_id is None, r.n_shingles) for r in got if r.doc_id is None)[0][0] is False
    kept = op.deduplicate(odd)
    assert kept.columns == odd.columns and not {7, 8} & {r.doc_id for r in kept.collect()}
    assert op.find(empty).count() == 0 and op.deduplicate(empty).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def chain(n, step):
    """Texts of which each is near the next alone: words are replaced one after the other."""
    base = [f"w{i}" for i in range(200)]
    for k in range(n):
        t = list(base)
        for j in range(k * step):
            t[(j * 7) % 200] = f"x{j}"
        yield " ".join(t)


def test_a_text_without_id_links_others(spark):
    a, b, c = chain(3, 3)
    assert not 100 * len(shingles(a) & shingles(c)) >= 80 * len(shingles(a) | shingles(c))
    for ids, want in (((1, 3, 2), {1: 1, 2: 1, 3: 1}), ((1, None, 2), {1: 1, 2: 1, None: 1}), ((None, 5, None), {5: 5, None: 5}), ((None, None, None), {None: None})):
        rows = list(zip(ids, (a, b, c), strict=True))
        got = op.find(spark.createDataFrame([*rows, (None, b), (None, b)] if None in ids else rows, "doc_id long, text string").repartition(3)).collect()
        assert {r.doc_id: r.component_id for r in got} == want and all(r.kept for r in got if r.doc_id is None)
        assert len(got) == (5 if None in ids else 3)


def test_many_copies(spark, monkeypatch):
    """Hot classes get their component by broadcast, others by a shuffle."""
    monkeypatch.setattr(op, "HOT", 10)
    a, b, c = chain(3, 3)
    rows = [(i, (a, c, "", "lone text of its own here", None)[i % 5]) for i in range(100, 200)] + [(50, b), (60, "another lone text here now")]
    got = op.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_sets_that_share_a_fingerprint(spark, monkeypatch):
    """Fingerprints of three values: different sets don't become one class."""
    real = op.signatures
    monkeypatch.setattr(op, "signatures", lambda *a: real(*a).withColumn("print", op.F.pmod("print", op.F.lit(3))))
    rows = list(enumerate([*chain(9, 1), *(f"lone text number {i} of its own" for i in range(6)), "lone text number 3 of its own", "", None]))
    got = op.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
