import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from treeloom.llm import lm_score as L
from treeloom.llm import textvec as tv

from .conftest import prose

TEXTS = ["the cat sat on the mat", "the dog ate the cat", "a cat", "", "été à la mer"]


def windows(texts):
    data, off = tv.buffer(pa.array(texts))
    return np.unique(L._windows(data, off), return_counts=True)


def model_of(texts):
    return L.automaton(*L.levels(*windows(texts)))


def brute(texts, text):
    """Backoff by dictionaries: the same model asked n-gram by n-gram."""
    counts = [Counter() for _ in range(L.ORDER)]
    for t in texts:
        t = (0,) * (L.ORDER - 1) + tuple(b + 1 for b in t.encode())
        for i in range(L.ORDER - 1, len(t)):
            for k in range(L.ORDER):
                counts[k][t[i - k : i + 1]] += 1
    kept = counts
    by = {}
    for k in range(L.ORDER):
        for g, n in kept[k].items():
            by.setdefault(g[:-1], {})[g[-1]] = n

    def parts(ctx):
        seen = by.get(ctx)
        if seen is None:
            return None
        total = sum(seen.values())
        whole = max(kept[len(ctx) - 1].get(ctx, 0), total) if ctx else max(1, total)
        return seen, whole, (whole - total + len(seen)) / (whole + len(seen))

    def p(ctx, s):
        got = parts(ctx)
        lower = (lambda: p(ctx[1:], s)) if ctx else (lambda: 1 / 256)
        if got is None:
            return lower()
        seen, whole, escape = got
        return (seen[s] / (whole + len(seen)) if s in seen else 0) + escape * lower()

    t = (0,) * (L.ORDER - 1) + tuple(b + 1 for b in text.encode())
    return [math.log10(p(t[i - L.ORDER + 1 : i], t[i])) for i in range(L.ORDER - 1, len(t))]


def test_automaton_is_the_model():
    tr = L.Traverser(model_of(TEXTS))
    for t in [*TEXTS, "zebra", "the the the", "\x00ÿ", "cat" * 300]:
        data, off = tv.buffer(pa.array([t]))
        assert tr.bytes(data, off) == pytest.approx(brute(TEXTS, t), rel=1e-5, abs=1e-6)


def test_probabilities_sum_to_one():
    a = model_of(TEXTS)
    tr = L.Traverser(a)
    for s in range(len(a["fail"])):
        _, logp = tr.step(np.full(256, s, np.int32), np.arange(1, 257).astype(np.uint64))
        assert (10.0**logp).sum() == pytest.approx(1, rel=1e-4)


def test_stretches_are_one_traversal(monkeypatch):
    a = model_of(TEXTS)
    text = "the cat sat on a dog à la mer " * 60
    data, off = tv.buffer(pa.array([text, "x", text[:700]]))
    cut = L.Traverser(a).bytes(data, off)
    monkeypatch.setattr(L, "STRETCH", 10**6)
    assert np.allclose(cut, L.Traverser(a).bytes(data, off), rtol=1e-6)


def phrases_of(text):
    """The phrases of a text word by word."""
    raw, out = text.encode(), []
    while raw:
        end = 0
        for m in re.finditer(rb"[^\t\n\x0b\x0c\r ]+", raw):
            h = tv.span_hash(np.frombuffer(m[0], np.uint8), np.array([0]), np.array([len(m[0])]))[0]
            if h % np.uint64(L.CUT) == 0 and m.end() < len(raw):
                end = m.end() + 1
                break
        out.append(raw[: end or len(raw)])
        raw = raw[len(out[-1]) :]
    return out


def test_phrases():
    texts = [prose(3, 400), "", " ", "the ", "the cat", " the  cat\n\n", "été à la mer " * 9, prose(4, 50) + " "]
    data, off = tv.buffer(pa.array(texts))
    begin, end, at = L.phrases(data, off)
    for i, t in enumerate(texts):
        assert [data[a:b].tobytes() for a, b in zip(begin[at[i] : at[i + 1]], end[at[i] : at[i + 1]])] == phrases_of(t)
    assert len(phrases_of(texts[0])) > 20


@pytest.mark.parametrize("own", [False, True])
def test_score_against_brute_force(spark, own):
    """Byte n-grams and phrase arcs by dictionaries, own occurrences taken off text by text."""
    r = random.Random(3)
    texts = [prose(k, r.randrange(5, 120)) for k in range(12)]
    texts += [texts[0], texts[1] + " and more", texts[2][: len(texts[2]) // 2], (texts[3] + " ") * 3, "", " "]
    arcs, whole = Counter(), Counter()
    for t in texts:
        p = phrases_of(t)
        arcs.update(zip(p, p[1:]))
        whole.update(p[:-1])
    others = texts if own else [*texts, prose(99, 60), prose(1, 3)]
    want = []
    for t in others:
        base, p, at, total = brute(texts, t), phrases_of(t), 0, 0.0
        mine, my_whole = (Counter(zip(p, p[1:])), Counter(p[:-1])) if own else (Counter(), Counter())
        for j, x in enumerate(p):
            b = sum(base[at : at + len(x)])
            at += len(x)
            n = whole[p[j - 1]] - my_whole[p[j - 1]] if j else 0
            total += math.log10((arcs[p[j - 1], x] - mine[p[j - 1], x] + L.PRIOR * 10**b) / (n + L.PRIOR)) if n else b
        want.append(total)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in L.score(spark.createDataFrame(list(enumerate(others)), "doc_id long, text string"), L.train(df), own).collect()}
    for k, t in enumerate(others):
        assert got[k].log10_prob == pytest.approx(want[k], rel=1e-4, abs=1e-5) and got[k].n_bytes == len(t.encode())


def test_copies_score_apart(spark):
    """Under the model of all texts a text that occurs twice is far cheaper than one that occurs once."""
    texts = [prose(k, 150) for k in range(60)]
    rows = list(enumerate(texts + texts[:20]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = {r.doc_id: r.bits_per_byte for r in L.score(df, L.train(df), own=True).collect()}
    twice, once = [s[k] for k in [*range(20), *range(60, 80)]], [s[k] for k in range(20, 60)]
    assert max(twice) < min(once)


def test_counts_cover_all_documents(spark, docs):
    rows = [r.text for r in docs.select("text").collect()]
    keys, n = windows(rows)
    got = {r.gram: r.n for r in L.count_grams(docs.repartition(7)).collect()}
    assert got == dict(zip(keys.astype(int).tolist(), n.tolist()))


def test_query_ranks_text_over_noise(spark, small, docs):
    model = L.train(docs)
    df = spark.createDataFrame([(1, docs.first().text), (2, "qzxj" * 50)], "doc_id long, text string")
    s = {r.doc_id: r.bits_per_byte for r in L.score(df, model).collect()}
    assert s[1] < 3 < 6 < s[2]


def test_odd_rows(odd, empty):
    model = L.train(odd)
    got = L.score(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.bits_per_byte is None) == (r.n_bytes == 0) and (r.n_bytes > 0 or r.log10_prob == 0)
    uniform = L.score(odd, L.train(empty)).where("n_bytes > 0").collect()
    assert all(abs(r.bits_per_byte - 8) < 1e-4 for r in uniform)
    assert L.score(empty, model).count() == 0


def test_model_grows_with_the_input(spark, docs):
    """Every n-gram and every arc that occurs is kept at any size: what is rare in the whole isn't lost."""
    few = docs.limit(20).select("doc_id", "text").persist()
    many = few.union(spark.createDataFrame([(1, "the same words again " * 100_000)], few.schema))
    for f in (L.count_grams, L.count_arcs):
        a, b = ({tuple(x)[:-1] for x in f(d).collect()} for d in (few, many))
        assert a < b


def test_ties_and_repeats(spark):
    """Equal texts score alike, whatever their ids; a repeated row counts each time."""
    t = prose(5, 80)
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (3, prose(6, 80))], "doc_id long, text string")
    got = L.score(df, L.train(df), own=True).collect()
    assert len(got) == 5 and len({round(r.log10_prob, 6) for r in got}) == 2
