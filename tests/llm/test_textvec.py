import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.llm import textvec as tv

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("abC é漢1._\n")), max_size=30)), max_size=8)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_and_hashes(texts):
    arr = pa.array(texts, pa.string())
    data, off = tv.buffer(arr, lower=True)
    start, end, tok = tv.words(data, off)
    h = tv.span_hash(data, start, end)
    k, seen = 0, {}
    for i, t in enumerate(texts):
        want = [w.encode() for w in re.findall(r"[^\W_]+", (t or "").lower())]
        assert tok[i + 1] - tok[i] == len(want)
        for w in want:
            assert data[start[k] : end[k]].tobytes() == w
            assert seen.setdefault(w, h[k]) == h[k]
            k += 1
    assert len(set(seen.values())) == len(seen)
    for size in (1, 3):
        g, goff = tv.shingles(h, tok, size)
        assert list(np.diff(goff)) == [max(n - size + 1, min(n, 1)) for n in np.diff(tok)]


@given(TEXTS, st.integers(1, 20))
@settings(max_examples=100, deadline=None)
def test_slices_cover(texts, limit):
    got = list(tv.slices(pa.array(texts, pa.string()), limit))
    assert [a for a, _ in got] == [0, *(b for _, b in got)][: len(got)] and (not texts or got[-1][1] == len(texts))


def test_int_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 60, 50_000, dtype=np.uint64))
    t = tv.IntTable(keys)
    assert (t.find(keys) == np.arange(len(keys))).all()
    other = rng.integers(1 << 60, 1 << 61, 1000, dtype=np.uint64)
    assert (t.find(other) == -1).all() and (tv.IntTable(np.zeros(0, np.uint64)).find(other) == -1).all()


def test_counter():
    c = tv.Counter64(every=10)
    rng = np.random.default_rng(2)
    all_ = [rng.integers(0, 50, 30).astype(np.uint64) for _ in range(20)]
    for a in all_:
        c.add(a)
    c.fold()
    k, n = np.unique(np.concatenate(all_), return_counts=True)
    assert (c.keys == k).all() and (c.counts == n).all()
