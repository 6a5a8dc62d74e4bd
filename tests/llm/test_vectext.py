import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from patchlight.llm import vectext as vt

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\u00e9\u0130.", max_size=30)), min_size=1, max_size=8)


def plain(text):
    return (text or "").encode().lower().split()


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_are_the_plain_ones(texts):
    hashes, of = vt.words(*vt.text_bytes(pa.array(texts, pa.string())))
    known = {}
    for k, text in enumerate(texts):
        own = hashes[of[k] : of[k + 1]].tolist()
        assert len(own) == len(plain(text))
        for w, h in zip(plain(text), own, strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(2, 5))
def test_shingles_are_the_plain_ones(texts, size):
    h, where = vt.shingles(*vt.words(*vt.text_bytes(pa.array(texts, pa.string()))), size)
    known = {}
    for k, text in enumerate(texts):
        w = plain(text)
        want = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [("only", *w)] * bool(w)
        own = h[where[k] : where[k + 1]].tolist()
        assert len(own) == len(want)
        for x, y in zip(want, own, strict=True):
            assert known.setdefault(x, y) == y
    assert len(set(known.values())) == len(known)


def test_slices_cover_all_texts_once():
    offsets = vt.text_bytes(pa.array(["a" * 5, "", "b" * 100, "c", None]))[1]
    seen = [k for i, j in vt.slices(offsets, 8) for k in range(i, j)]
    assert seen == [0, 1, 2, 3, 4]
