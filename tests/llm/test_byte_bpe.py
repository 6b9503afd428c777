import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm import byte_bpe as op

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
with open(PATH, "rb") as f:
    BPE = op.Bpe(f.read())
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=BPE.rank, special_tokens={})
FOUND = regex.compile(PATTERN)


def ids(text):
    return np.frombuffer(op.encode_text(text, op.Packed(BPE), FOUND), "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(st.sampled_from("aeinrst"), min_size=60, max_size=400), st.text(st.sampled_from("ab =é漢"), max_size=300)))
def test_like_tiktoken_and_back(text):
    got = ids(text)
    assert got == REFERENCE.encode_ordinary(text)
    assert BPE.decode(got).decode() == text


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, "é" * 3000, " " * 4000 + "x", "=" * 3000, "x" * 33])
def test_long_matches(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


def test_real_matches_go_through_the_tree(monkeypatch):
    """Every match that is no token of the vocabulary is built by joins, down to single bytes; decoding is a tree as well."""
    bpe = op.Bpe.__new__(op.Bpe)
    bpe.__dict__ |= {"rank": BPE.rank, "bytes": BPE.bytes, "known": {}, "singles": BPE.singles, "nodes": dict(BPE.singles)}
    joined = []
    real = op.Bpe.join
    monkeypatch.setattr(op.Bpe, "join", lambda self, a, b: joined.append((len(a), len(b))) or real(self, a, b))
    text = "Therhean thntblein unmistakably erhaanti. " * 3
    got = np.frombuffer(op.encode_text(text, op.Packed(bpe), FOUND), "<u4").tolist()
    assert got == REFERENCE.encode_ordinary(text)
    long = [m for m in dict.fromkeys(FOUND.findall(text)) if m.encode() not in bpe.rank]
    assert len(long) >= 3 and len(joined) >= sum(len(m) for m in long) // 2 and (1, 1) in joined
    assert all(bpe.nodes[m[: len(m) // 2].encode()] for m in long if 1 < len(m) // 2 <= op.CACHED_NODE)


@pytest.mark.parametrize("text", ["abcde fghij klmno", "unmistakably", "ñandú" * 40, "ab" * 300])
def test_any_split_joins_to_the_same_tokens(text):
    """The join is associative: whatever the place where a match is cut, its parts join to the tokens of the whole."""
    for piece in FOUND.findall(text):
        b = piece.encode()
        want = BPE.heap(b)
        for cut in range(1, len(b)):
            assert BPE.join(BPE.heap(b[:cut]), BPE.heap(b[cut:])) == want


def test_portions(monkeypatch):
    text = "some words, and more words. " * 200
    whole = ids(text)
    monkeypatch.setattr(op, "LONG", 10)
    assert ids(text) == whole


def test_rows(odd, empty):
    got = op.encoded(odd, PATH, PATTERN, carry=("doc_id", "text")).collect()
    assert len(got) == odd.count()
    for r in got:
        want = REFERENCE.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids) == (len(want), want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = op.decoded(op.encoded(odd, PATH, PATTERN, carry=("doc_id", "text")).withColumnRenamed("text", "was"), PATH, carry=("doc_id", "was"))
    assert all(r.text == (r.was or "") for r in back.collect())
    assert op.encoded(empty, PATH, PATTERN).count() == 0
