"""The text kernel and the token counter against plain Python."""

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeweave.llm import kernel, tokens

ALPHABET = "aAbÉß 09_.,'\n\t-é日あ한́ "


def spans(texts):
    out = []
    for lo, hi, cp, at in kernel.chunks(pa.array(texts, pa.string()), 20):
        w = kernel.words(cp, at)
        for i in range(hi - lo):
            out.append([(int(w.start[k] - at[i]), int(w.end[k] - at[i]), int(w.hash[k])) for k in range(w.first[i], w.first[i + 1])])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=40)), max_size=6))
def test_words(texts):
    wide = "぀-ヿ㐀-鿿가-힣"
    seen = {}
    for t, got in zip(texts, spans(texts)):
        want = [m.span() for m in re.finditer(rf"[{wide}]|(?:[^\W{wide}]|́)+", t or "")]
        assert [g[:2] for g in got] == want
        for a, b, h in got:
            assert seen.setdefault(h, t[a:b].lower()) == t[a:b].lower()
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab'sltrvemdAé 1½\n\t.-日", max_size=30), min_size=1, max_size=5))
def test_token_counts(texts):
    encode = tokens.encoder(tokens.VOCABULARY).encode_ordinary
    assert tokens.Counter()(pa.array(texts)).tolist() == [len(encode(t)) for t in texts]


def test_ngrams_stay_within_rows():
    cp, at = kernel.code_points(pa.array(["a b c", None, "d", "a b"]))
    h, first = kernel.words(cp, at).ngrams(2)
    assert first.tolist() == [0, 1, 4] and h[0] == h[2] != h[1]


def test_slices_and_invalid_utf8():
    col = pa.array(["xx", "é y", "z"])[1:]
    assert [len(w) for w in spans(col.to_pylist())] == [2, 1]
    bad = pa.Array.from_buffers(pa.string(), 2, [None, pa.array([0, 2, 3], pa.int32()).buffers()[1], pa.py_buffer(b"a\xffb")])
    cp, at = kernel.code_points(bad)
    assert at.tolist() == [0, 2, 3] and cp[2] == ord("b")
