import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import textvec as V

TEXT = st.text(st.sampled_from("abAB çÉ1½ .\n\t’-İß名"), max_size=40)


def brute_words(text):
    return re.findall(r"[^\W_]+", text.lower())


@settings(deadline=None, max_examples=150)
@given(st.lists(TEXT | st.none(), max_size=6))
def test_words_and_shingles(texts):
    h, off = V.words(texts)
    name = {}
    for i, t in enumerate(texts):
        want = brute_words(t or "")
        got = h[off[i] : off[i + 1]].tolist()
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert name.setdefault(g, w) == w
    s, soff = V.shingles(texts, 2)
    for i, t in enumerate(texts):
        w = brute_words(t or "")
        assert soff[i + 1] - soff[i] == len({tuple(w[k : k + 2]) for k in range(len(w) - 1)})


@settings(deadline=None, max_examples=150)
@given(st.lists(TEXT | st.none(), max_size=6))
def test_lines(texts):
    cp, doc, line, bounds = V.lines(texts)
    got = [(int(d), int(n), "".join(map(chr, cp[a:b]))) for d, n, a, b in zip(doc, line, bounds[:-1], bounds[1:])]
    want = []
    for i, t in enumerate(texts):
        for n, x in enumerate((t or "").lower().split("\n")):
            f = "".join(c for c in x if c.isalnum())
            if f:
                want.append((i, n, f))
    assert got == want


def test_span_hashes_depend_on_content_only():
    cp = np.array([ord(c) for c in "abcXabcYab"], np.uint32)
    h = V.span_hashes(cp, np.array([0, 4, 8, 0]), np.array([3, 7, 10, 0]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def test_long_text():
    rng = random.Random(0)
    t = " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(200_000))
    h, off = V.words([t, "x"])
    assert off.tolist() == [0, 200_000, 200_001]


def test_slices_are_bounded_by_rows_and_bytes():
    import pyarrow as pa

    from newsloom.llm import similarity

    texts = ["x" * n for n in (1, 30 << 20, 5, 9 << 20, 9 << 20, 0, 1)] + [None] + ["y"] * 20
    b = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    got = list(similarity.slices(iter([b, b.slice(0, 0)]), 10))
    assert [x for s in got for x in s.column(0).to_pylist()] == list(range(len(texts)))
    assert all(s.num_rows <= 10 and (s.num_rows == 1 or sum(len(t or "") for t in s.column(1).to_pylist()) <= similarity.SLICE_BYTES) for s in got)
