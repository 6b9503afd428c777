import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm import benchmark_leaks as op
from skyloom.llm.fm_index import FmIndex, suffix_array

from .conftest import LOREM

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items):
    words = WORD.findall((text or "").translate(LOW))
    hit, found = set(), set()
    for item, t in items:
        own = WORD.findall((t or "").translate(LOW))
        n = min(10, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[k : k + n]:
                    hit.update(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=9), min_size=1, max_size=6), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_index_finds_every_occurrence(runs, pattern):
    text = np.array([x for r in runs for x in [*r, 0]])
    order = suffix_array(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    index = FmIndex(text, 4)
    which, lo, hi = index.search(np.array([pattern]))
    got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if len(which) else []
    assert got == [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)].tolist() == pattern]


ITEMS = [(1, "Past old STONE walls while seven quiet birds watched from a tall, green tree"), (2, "nobody spoke"), (3, ""), (4, None), (None, "hello"), (10, "seven quiet birds watched from a tall green tree and nobody spoke"), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]


def test_against_brute_force(spark, odd):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    want = sorted(((r.doc_id, *brute(r.text, ITEMS)) for r in odd.collect()), key=repr)
    for block in (1 << 20, 8):
        got = op.find(odd, bench, block_words=block).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == want


def test_removal(spark, odd):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    clean = op.remove(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    before = {(r.doc_id, r.source, r.n_chars): r.text for r in odd.collect()}
    for r in clean.collect():
        if r.text == f"the river ran {LOREM[LOREM.index('about'):]}":
            assert r.n_chars == len(r.text)
        assert brute(r.text, [x for x in ITEMS if x[0] in (1, 10)])[1] == 0
        old = before.get((r.doc_id, r.source, r.n_chars), r.text)
        if brute(old, ITEMS)[1] == 0:
            assert r.text == old


def test_empty(spark, odd, empty):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert op.find(empty, bench).count() == 0
    assert {r.n_hit for r in op.find(odd, bench.limit(0)).collect()} == {0}
    assert op.remove(odd, bench.limit(0)).count() == odd.count()
