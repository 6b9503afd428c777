import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm import textops
from skyloom.llm.textops import Words, slices

SPACE, ALNUM = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB9é漢 \n\t!_"), max_size=30)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_are_those_of_the_regex(values):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    for lut, pattern in ((Words.SPACE, SPACE), (Words.ALNUM, ALNUM)):
        w = Words(pa.array(values, pa.string()), lut)
        low = w.data.tobytes().translate(lower)
        got = [[low[w.starts[k] : w.ends[k]] for k in range(w.first[i], w.first[i + 1])] for i in range(len(values))]
        assert got == [pattern.findall((v or "").encode().translate(lower)) for v in values]
        flat = [x for row in got for x in row]
        assert len(set(w.hash.tolist())) == len(set(flat)) and len({(h, x) for h, x in zip(w.hash.tolist(), flat, strict=True)}) == len(set(flat))


def test_slices_cover_all_rows_within_the_bound():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (3, 90, 0, 40, 40, 200)] + [None])], names=["t"])
    parts = list(slices(batch, "t", 100))
    assert sum(p.num_rows for p in parts) == 7 and all(p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= 100 for p in parts)
    sliced = batch.slice(1, 3)
    assert np.array_equal(Words(sliced.column(0), Words.SPACE).counts(), [1, 0, 1])


def test_very_long_texts_take_bounded_memory(monkeypatch):
    """32 MB in one text, and a word of 12 MB: a few bytes of arrays for each byte of text, and the fingerprints of the words themselves."""
    import tracemalloc

    big = pa.array(["word another long token here " * 1_150_000 + "x" * (12 << 20)])
    tracemalloc.start()
    w = Words(big, Words.SPACE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14 * len(w.data), peak / len(w.data)
    assert len(set(w.hash.tolist())) == 6 and w.counts().tolist() == [5 * 1_150_000 + 1]
    short = pa.array(["word another long token here", "b" * 70_000 + " c"])
    whole = Words(short, Words.SPACE).hash
    assert (w.hash[:5] == whole[:5]).all()
    monkeypatch.setattr(textops, "SLICE_BYTES", 11)  # every word in portions
    assert (Words(short, Words.SPACE).hash == whole).all()
