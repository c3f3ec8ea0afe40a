import re
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from treeloom.llm import pii_crf as P
from treeloom.llm import textvec as tv


@pytest.fixture(scope="module")
def dec():
    return P.Decoder(P.default_model())


def test_viterbi_is_best():
    rng = np.random.default_rng(1)
    n = P.N_LABELS
    trans = rng.normal(size=(n, n))
    for before, after in product((False, True), repeat=2):
        e = rng.normal(size=(5, 3, n)) * 2
        got = P.viterbi(e, trans, np.full(5, before), np.full(5, after))
        for i in range(5):
            best = max(product(range(n), repeat=3), key=lambda y: sum(e[i, t, y[t]] for t in range(3)) + sum(trans[a, b] for a, b in zip(y, y[1:])) + (trans[0, y[0]] if before else 0) + (trans[y[-1], 0] if after else 0))
            assert tuple(got[i]) == best


def test_cutting_is_exact(dec, docs):
    texts = pa.array([r.text for r in docs.select("text").collect()])
    data, off = tv.buffer(texts)
    s, e, tok = tv.words(data, off, tv.NONSPACE)
    cut = dec.labels(data, s, e, tok)
    for i in range(len(texts)):
        a, b = tok[i], tok[i + 1]
        whole = dec.labels(data, s[a:b], e[a:b], np.array([0, b - a]), cut=False)
        assert (whole == cut[a:b]).all()


def test_held_out_accuracy(dec):
    rows = P.labelled_table(300, seed=99)
    tp = fp = fn = 0
    for toks, labs in rows:
        data, off = tv.buffer(pa.array([" ".join(toks)]))
        s, e, tok = tv.words(data, off, tv.NONSPACE)
        got = [P.LABELS[k] for k in dec.labels(data, s, e, tok)]
        tp += sum(a == b != "O" for a, b in zip(got, labs))
        fp += sum(a != "O" and a != b for a, b in zip(got, labs))
        fn += sum(b != "O" and a != b for a, b in zip(got, labs))
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.95


PATTERNS = {"EMAIL": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "IP": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)", "CARD": r"(?<!\w)\d{16}(?!\w)", "PHONE": r"\+1 \(\d{3}\) \d{3}-\d{4}"}


def test_documents(spark, docs):
    got = {(r.doc_id, r.kind, r.begin, r.end, r.value) for r in P.find(docs).collect()}
    want = {(r.doc_id, k, m.start(), m.end(), m[0]) for r in docs.select("doc_id", "text").collect() for k, p in PATTERNS.items() for m in re.finditer(p, r.text)}
    assert want and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_odd_rows(spark, odd, empty):
    assert P.find(odd).count() == 0 and P.find(empty).count() == 0
    t = "é mail a.b@c.example.com### or\n+1 (523) 555-1055, x"
    df = spark.createDataFrame([(1, t, "k"), (1, t, "k"), (None, t, "k"), (2, None, "k"), (3, "", "k"), (4, "word " * 200_000 + t, "k")], "doc_id long, text string, kind string")
    got = [(r.doc_id, r.kind, r.value) for r in P.find(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(i, k, v) for i in (1, 1, None, 4) for k, v in (("EMAIL", "a.b@c.example.com"), ("PHONE", "+1 (523) 555-1055"))]))
    r = P.find(df).where("doc_id = 1 and kind = 'EMAIL'").first()
    assert t[r.begin : r.end] == r.value


@pytest.mark.parametrize("text,kind,value", [
    ("call 020 7946 0958 now", "PHONE", "020 7946 0958"), ("tel 06 12 34 56 78 ok", "PHONE", "06 12 34 56 78"), ("ruf 030 12345678 an", "PHONE", "030 12345678"), ("tel: 0171/123456", "PHONE", "0171/123456"), ("+44 20 7946 0958", "PHONE", "+44 20 7946 0958"),
    ("at 2001:db8:85a3::8a2e:370:7334 x", "IP", "2001:db8:85a3::8a2e:370:7334"), ("from 192.168.0.1, then", "IP", "192.168.0.1"), ("ssn 123-45-6789.", "SSN", "123-45-6789"), ("to DE89 3704 0044 0532 0130 00 ok", "IBAN", "DE89 3704 0044 0532 0130 00"),
    ("to GB29NWBK60161331926819", "IBAN", "GB29NWBK60161331926819"), ("pay 4111 1111 1111 1111, thanks", "CARD", "4111 1111 1111 1111"), ("card 378282246310005 x", "CARD", "378282246310005"), ("<jane.doe@uni-example.ac.uk>;", "EMAIL", "jane.doe@uni-example.ac.uk"),
])
def test_formats_of_many_countries(dec, text, kind, value):
    assert [(k, v) for _, k, _, _, v in dec.spans(pa.array([text]))] == [(kind, value)]


@pytest.mark.parametrize("text", ["version 2.4.1 of", "on 2024-01-31 at 12:30", "price $1,234.56 for 3 items", "isbn 978-3-16-148410-0 x", "mac 00:1a:2b:3c:4d:5e end", "id 550e8400-e29b-41d4-a716-446655440000", "order 12345678 shipped", "see @handle and x@ y", "std::vector<int> a::b", "BY-NC 4.0.", f'key = "{"ab12" * 10}"'])
def test_what_only_looks_private(dec, text):
    assert dec.spans(pa.array([text])) == []


def test_fit_against_enumeration():
    """The likelihood of the fitted model, by all labellings of short sentences, is at a maximum: small steps from it lose."""
    rows = [(["a@b.c", "x"], ["B-EMAIL", "O"]), (["x", "1.2.3.4"], ["O", "B-IP"]), (["12", "x", "5"], ["O", "O", "O"])]
    crf = P.train(rows, epochs=4000, l2=0.01)

    def objective(w, trans):
        out = 0.0
        for toks, labs in rows:
            shapes = ["<", *(P.shape_of(t.encode()) for t in toks), ">"]
            e = np.array([sum(w[p, [crf.index[f] for f in P.features(shapes[t + 1 + d])]].sum(0) for p, d in ((0, 0), (1, -1), (2, 1))) for t in range(len(toks))])
            total = sum(np.exp(sum(e[t, y] for t, y in enumerate(ys)) + sum(trans[a, b] for a, b in zip(ys, ys[1:]))) for ys in product(range(P.N_LABELS), repeat=len(toks)))
            ys = [P.LABELS.index(x) for x in labs]
            out += sum(e[t, y] for t, y in enumerate(ys)) + sum(trans[a, b] for a, b in zip(ys, ys[1:])) - np.log(total)
        return out / len(rows) - 0.005 * (w**2).sum() - 0.005 * (trans**2).sum()

    best, rng = objective(crf.w, crf.trans), np.random.default_rng(1)
    for _ in range(12):
        assert objective(crf.w + 0.02 * rng.normal(size=crf.w.shape), crf.trans + 0.02 * rng.normal(size=crf.trans.shape)) < best + 1e-6


def test_ties_and_long_tokens(dec):
    """Equal scores give the first labels; a token of any length is looked at entire."""
    e = np.zeros((1, 3, P.N_LABELS))
    assert P.viterbi(e, np.zeros((P.N_LABELS, P.N_LABELS)), np.array([False]), np.array([False])).tolist() == [[0, 0, 0]]
    long = "x1-" * 20_000
    assert dec.spans(pa.array([long + " mail a.b@c.org " + long, "a" * 100_000 + "@example.org"]))[0][4] == "a.b@c.org"
    assert P.features("d" * 60 + "x")[4] == "runs=60"
