"""Personal data by a linear-chain conditional random field (CRF) over word shapes.

Tokens are runs of non-space characters. A token's features are those of its
shape (digits kept one by one, letters collapsed, punctuation kept) and of its
neighbours' shapes: the shape entire, its trigrams, and counts of what is in it;
none of them is a pattern of personal data. Weights and label transitions are
trained on a small labelled table (``labelled_table``, or a caller's own) by
gradient ascent on the regularised log-likelihood, and frozen. Emissions depend
on shapes alone, so they are worked out once for each distinct shape.

Decoding is exact Viterbi in numpy batches. Where the label O beats every other
label by more than transitions could ever make up, O is on the best path
whatever stands around; such tokens cut the text into short stretches, and only
those are run, all stretches of a length at once.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import text_batches

KINDS = ["EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN"]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
N_LABELS = len(LABELS)
MAX_LABELLED = 4000

#: Classes of bytes within a shape: d digits, X and x letters, # other marks, the rest itself.
_CLASS = np.full(256, ord("#"), np.uint8)
_CLASS[48:58] = ord("d")
_CLASS[65:91] = ord("X")
_CLASS[97:123] = ord("x")
_CLASS[128:] = ord("x")
for _ch in "@.-()+:/_,":
    _CLASS[ord(_ch)] = ord(_ch)


def shape_of(token: bytes) -> str:
    """The shape: letters collapse by case, digits and punctuation stay one by one."""
    return re.sub(r"(X|x)\1+", r"\1", bytes(_CLASS[np.frombuffer(token, np.uint8)]).decode())


EDGE = "#,.:;/_-"


@lru_cache(200_000)
def features(shape: str) -> tuple[str, ...]:
    """What the model sees of a shape."""
    core = shape.strip(EDGE) or "#"
    runs = [len(x) for x in re.findall("d+", core)]
    short = re.sub("d+", "d", core)
    around = "^" + short + "$"
    out = [
        "core=" + core, "short=" + short, f"digits={sum(runs)}", f"groups={len(runs)}", "runs=" + "-".join(map(str, runs)), f"longest={max(runs, default=0)}", f"shortest={min(runs, default=0)}",
        f"open={core[:1]}", f"close={core[-1:]}", f"letters={'x' in core.lower()}", f"turns={len(re.findall('[Xx]d|d[Xx]', core))}",
    ]
    out += [f"n{ch}={short.count(ch)}" for ch in "@.-:()+/"]
    return tuple(dict.fromkeys([*out, *("tri=" + around[k : k + 3] for k in range(len(around) - 2))]))


#: Countries of account numbers: letters after the country and its two digits, then digits.
_IBAN = {"DE": (0, 18), "FR": (0, 23), "GB": (4, 14), "ES": (0, 20), "NL": (4, 10), "CH": (0, 17), "BE": (0, 12), "PL": (0, 24), "PT": (0, 21), "AT": (0, 16)}
#: National and international ways of writing telephone numbers; d is a digit, spaces part tokens.
_PHONES = """(ddd) ddd-dddd|ddd-ddd-dddd|ddd.ddd.dddd|+1 (ddd) ddd-dddd|+1 ddd ddd dddd|+1-ddd-ddd-dddd|1-ddd-ddd-dddd|0dd dddd dddd|0dddd dddddd|0dd dddddddd|0ddd dddddd|0ddd/dddddd|0ddd-dddddd
0d dd dd dd dd|0d.dd.dd.dd.dd|+33 d dd dd dd dd|+44 dd dddd dddd|+44 dddd dddddd|+49 ddd ddddddd|+49 dd dddddddd|+49-ddd-ddddddd|+34 ddd dd dd dd|+34 ddd ddd ddd|9dd ddd ddd|+dd ddd ddd dddd|+ddddddddddd|+dddddddddddd|(0dd) dddd dddd""".replace("\n", "|").split("|")
_DECOYS = """d|dd|ddd|dddd|ddddd|dddddd|dddddddd|dddddddddd|dddddddddddddddddddddddd|d.d|d.dd|d.d.d|dd.d.dd|dddd-dd-dd|dd.dd.dddd|dd/dd/dddd|d/d|dd:dd|dd:dd:dd|$d|$ddd.dd|d,ddd|d,ddd,ddd|dd%|d.d%|(dddd)|[dd]|dd-dd|dddd-dddd
978-d-dddd-dddd-d|vd.d|vd.d.d|dd.d.|#ddd|dst|dth|dx|ddx|x-dd|x.dd|x_d|x/d|x:dd|X-dddd|XXdddd|XX-dd-X|x(d)|x=d|http://x.x/ddd|https://x.x.x/x/d|/x/x/d|@x|x@|@xd|x.x|x-x|x/x|x_x|x:x|x::x|"x"|(x)|{x}|x=|=|-|--|...|*|&|+|/|hh:hh:hh:hh:hh:hh""".replace("\n", "|").split("|")


def labelled_table(n: int = 1000, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """A small labelled table of made-up sentences: tokens and labels.

    Words, names and numbers are random, written in many countries' ways; half
    of the sentences hold no personal data but what looks a little like it
    (versions, dates, amounts, hashes, paths, hardware addresses). Any token may
    have marks around it.
    """
    r = random.Random(seed)
    syll = "an er on in th ou ti re st en de la ch au que mi do ver sch ung ción ez ai oi ka no wa gü és".split()
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 4)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    marks = lambda: "".join(r.choice(",.;:!?)]}#*%$&|~'\"") for _ in range(r.randint(1, 3)))

    def made(pattern: str) -> list[str]:
        return re.sub("[dhxX]", lambda m: num(1) if m[0] == "d" else hexa(2) if m[0] == "h" else word() if m[0] == "x" else r.choice("ABCDEFGHKLMNPRSTUVWZ"), pattern).split(" ")

    def plain() -> str:
        w = word()
        w = r.choice([w, w, w, w.title(), w.upper()])
        return w + (marks() if r.random() < 0.3 else "")

    def decoy() -> list[str]:
        k = r.randrange(12)
        if k == 0:
            return [hexa(r.choice([7, 8, 16, 32, 40, 64]))]
        if k == 1:
            return ["-".join(hexa(j) for j in (8, 4, 4, 4, 12))]
        if k == 2:
            return [word(), r.choice("=:"), '"' + "".join(r.choice("0123456789abcdefXYZ") for _ in range(r.randrange(16, 44))) + '"']
        return made(r.choice(_DECOYS))

    def private() -> tuple[str, list[str]]:
        k = r.choice(KINDS)
        if k == "EMAIL":
            user = r.choice([word(), word() + num(r.randint(1, 4)), f"{word()}.{num(2)}", f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}-{word()}", f"{word()}+{word()}", word().title() + "." + word().title()])
            host = ".".join(r.choice([word(), word(), word() + num(1), f"{word()}-{word()}"]) for _ in range(r.choice([1, 1, 2, 3])))
            return k, [f"{user}@{host}." + r.choice(["com", "org", "net", "de", "fr", "es", "co.uk", "info", "io", "edu"])]
        if k == "PHONE":
            return k, made(r.choice(_PHONES))
        if k == "IP":
            if r.random() < 0.7:
                return k, [".".join(str(r.randint(0, 255)) for _ in range(4))]
            groups = [hexa(r.randint(1, 4)) for _ in range(8)]
            if r.random() < 0.5:
                at = r.randrange(1, 6)
                groups[at : at + r.randint(2, 7 - at)] = [""]
            return k, [":".join(groups)]
        if k == "CARD":
            return k, made(r.choice(["d" * 16, "d" * 16, "dddd dddd dddd dddd", "dddd-dddd-dddd-dddd", "d" * 15, "dddd dddddd ddddd"]))
        if k == "SSN":
            return k, made("ddd-dd-dddd")
        country = r.choice(list(_IBAN))
        letters, digits = _IBAN[country]
        code = country + num(2) + "".join(r.choice("ABCDEFGHKLMNPRSTUVWZ") for _ in range(letters)) + num(digits)
        return k, [code] if r.random() < 0.5 else [code[j : j + 4] for j in range(0, len(code), 4)]

    rows = []
    for i in range(n):
        toks, labs = [], []
        for _ in range(r.randint(1, 4)):
            for _ in range(r.randint(0, 5)):
                toks.append(plain())
                labs.append("O")
            kind, t = private() if i % 2 == 0 else ("", decoy())
            if r.random() < 0.3:
                t = [*t[:-1], t[-1] + marks()]
            toks += t
            labs += [f"B-{kind}", *[f"I-{kind}"] * (len(t) - 1)] if kind else ["O"] * len(t)
        for _ in range(r.randint(0, 4)):
            toks.append(plain())
            labs.append("O")
        rows.append((toks, labs))
    return rows


class CRF:
    """Weights by (place, feature, label) for a token and its two neighbours, and transitions by (label, label)."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, trans: np.ndarray):
        self.index, self.w, self.trans = index, weights, trans

    def emit(self, shape: str, place: int) -> np.ndarray:
        """What a shape at the token (0), before it (1) or after it (2) adds to its labels."""
        ids = [self.index[f] for f in features(shape) if f in self.index]
        return self.w[place, ids].sum(0) if ids else np.zeros(N_LABELS)


def train(rows: list[tuple[list[str], list[str]]], epochs: int = 60, rate: float = 0.3, l2: float = 1e-4) -> CRF:
    """Fit by full-batch AdaGrad on the log-likelihood; forward and backward passes run over all sentences at once.

    Emissions and gradients go by distinct shape, so a pass costs what its shapes have features.
    """
    if len(rows) > MAX_LABELLED:
        rows = sorted(rows, key=lambda x: zlib.crc32(" ".join(x[0]).encode()))[:MAX_LABELLED]
    rows = sorted(rows, key=lambda x: -len(x[0]))  # so that those that still run come first
    n, top = len(rows), len(rows[0][0])
    size = np.array([len(t) for t, _ in rows])
    running = [int((size > t).sum()) for t in range(top)]
    mask = np.arange(top) < size[:, None]
    shapes: dict[str, int] = {"<": 0, ">": 1}
    at_shape = np.ones((n, top + 2), np.int64)
    at_shape[:, 0] = 0
    gold = np.zeros((n, top), np.int64)
    for i, (toks, labs) in enumerate(rows):
        at_shape[i, 1 : len(toks) + 1] = [shapes.setdefault(shape_of(t.encode()), len(shapes)) for t in toks]
        gold[i, : len(labs)] = [LABELS.index(x) for x in labs]
    index: dict[str, int] = {}
    lists = [[index.setdefault(f, len(index)) for f in features(s)] for s in shapes]
    feat = np.concatenate([np.array(x) for x in lists])
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])[:-1]])
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(feat, kind="stable")
    by_feat = np.flatnonzero(np.concatenate([[True], np.diff(feat[order]) > 0]))
    places = [at_shape[:, 1:-1][mask], at_shape[:, :-2][mask], at_shape[:, 2:][mask]]

    def spread(values: np.ndarray) -> np.ndarray:
        """Sums over tokens of values (tokens x labels), by place and feature."""
        out = np.empty((3, len(index), N_LABELS))
        for p, s in enumerate(places):
            by_shape = np.stack([np.bincount(s, values[:, k], len(lists)) for k in range(N_LABELS)], 1)
            out[p] = np.add.reduceat(by_shape[owner[order]], by_feat)
        return out

    w, trans = np.zeros((3, len(index), N_LABELS)), np.zeros((N_LABELS, N_LABELS))
    gw, gt = np.full(w.shape, 1e-8), np.full(trans.shape, 1e-8)
    seen_w, seen_t, pair, at = spread(np.eye(N_LABELS)[gold[mask]]), np.zeros_like(trans), mask[:, 1:], np.arange(n)
    np.add.at(seen_t, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)
    for _ in range(epochs):
        e = np.zeros((n, top, N_LABELS))
        e[mask] = sum(np.add.reduceat(w[p][feat], first)[s] for p, s in enumerate(places))
        fwd, bwd, step = np.zeros((n, top, N_LABELS)), np.zeros((n, top, N_LABELS)), np.exp(trans)
        fwd[:, 0] = e[:, 0]
        for t in range(1, top):
            k = running[t]
            big = fwd[:k, t - 1].max(1, keepdims=True)
            fwd[:k, t] = e[:k, t] + big + np.log(np.exp(fwd[:k, t - 1] - big) @ step)
        last = fwd[at, size - 1]
        big = last.max(1)
        log_z = big + np.log(np.exp(last - big[:, None]).sum(1))
        exp_t = np.zeros_like(trans)
        for t in range(top - 2, -1, -1):
            k = running[t + 1]
            x = e[:k, t + 1] + bwd[:k, t + 1]
            big = x.max(1, keepdims=True)
            right = np.exp(x - big)
            bwd[:k, t] = big + np.log(right @ step.T)
            exp_t += step * (np.exp(fwd[:k, t] + big - log_z[:k, None]).T @ right)
        exp_w = spread(np.exp(fwd + bwd - log_z[:, None, None])[mask])
        dw, dt = (seen_w - exp_w) / n - l2 * w, (seen_t - exp_t) / n - l2 * trans
        gw += dw * dw
        gt += dt * dt
        w += rate * dw / np.sqrt(gw)
        trans += rate * dt / np.sqrt(gt)
    return CRF(index, w, trans)


def viterbi(e: np.ndarray, trans: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Best labels of stretches (stretches x tokens x labels); before and after: whether O stands there."""
    n, t_len, _ = e.shape
    score = e[:, 0] + np.where(before[:, None], trans[0], 0.0)
    back = np.zeros((n, t_len, N_LABELS), np.int8)
    for t in range(1, t_len):
        x = score[:, :, None] + trans
        back[:, t] = x.argmax(1)
        score = x.max(1) + e[:, t]
    score = score + np.where(after[:, None], trans[:, 0], 0.0)
    out = np.zeros((n, t_len), np.int64)
    out[:, -1] = score.argmax(1)
    for t in range(t_len - 1, 0, -1):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    return out


class Decoder:
    def __init__(self, crf: CRF):
        self.crf = crf
        self.slack = 2 * (crf.trans.max() - crf.trans.min())
        edge = [crf.emit("<", 1), crf.emit(">", 2)]
        self.known: dict[int, int] = {}
        self.rows: list[np.ndarray] = [np.stack([np.zeros(N_LABELS), edge[0], edge[1]])]  # row 0: no token at the edge
        self.table = np.zeros((1, 3, N_LABELS))

    def _ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each token's shape; new shapes get their emissions."""
        cls = _CLASS[data]
        keep = np.ones(len(cls), bool)
        letter = (cls == ord("x")) | (cls == ord("X"))
        keep[1:] = ~letter[1:] | (cls[1:] != cls[:-1])
        keep[start] = True
        place = np.zeros(len(cls) + 1, np.int64)
        np.cumsum(keep, out=place[1:])
        kept = np.flatnonzero(keep)
        h = tv.span_hash(cls[kept], place[start], place[end])
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        ids = np.empty(len(uniq), np.int64)
        for i, (u, f) in enumerate(zip(uniq.tolist(), first)):
            k = self.known.get(u)
            if k is None:
                s = shape_of(data[start[f] : end[f]].tobytes())
                k = self.known[u] = len(self.rows)
                self.rows.append(np.stack([self.crf.emit(s, p) for p in range(3)]))
            ids[i] = k
        if len(self.table) != len(self.rows):
            self.table = np.stack(self.rows)
        return ids[inv]

    def labels(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, tok: np.ndarray, cut: bool = True) -> np.ndarray:
        """Label of each token; ``cut=False`` runs Viterbi over whole texts (for tests)."""
        n = len(start)
        out = np.zeros(n, np.int64)
        if not n:
            return out
        ids = self._ids(data, start, end)
        is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
        full = np.diff(tok) > 0
        is_first[tok[:-1][full]] = True
        is_last[tok[1:][full] - 1] = True
        prev, nxt = np.concatenate([[0], ids[:-1]]), np.concatenate([ids[1:], [0]])
        prev[is_first], nxt[is_last] = 0, 0
        # Bound O's lead per shape first, so that most tokens never get an emission row of their own.
        t = self.table
        lead = [t[:, p, :1] - t[:, p] for p in range(3)]  # O less each label
        low = [x[:, 1:] for x in lead]
        m = low[0].min(1)[ids] + low[1].min(1)[prev] + low[2].min(1)[nxt]
        open_ = np.flatnonzero(m <= self.slack) if cut else np.arange(n)
        if cut and len(open_):  # the bound was by label; now exactly
            exact = (low[0][ids[open_]] + low[1][prev[open_]] + low[2][nxt[open_]]).min(1)
            open_ = open_[exact <= self.slack]
        if not len(open_):
            return out
        e = t[ids[open_], 0] + t[prev[open_], 1] + t[nxt[open_], 2]
        new = np.ones(len(open_), bool)
        new[1:] = (np.diff(open_) > 1) | is_first[open_[1:]]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(open_)))
        for s in np.unique(size):
            at = first[size == s]
            rows = at[:, None] + np.arange(s)
            before = ~is_first[open_[at]]
            after = ~is_last[open_[at + s - 1]]
            out[open_[rows]] = viterbi(e[rows], self.crf.trans, before, after)
        return out

    def spans(self, texts: pa.Array) -> list[tuple[int, str, int, int, str]]:
        """(row, kind, begin, end, text) in characters; marks around a span are left out."""
        data, off = tv.buffer(texts)
        start, end, tok = tv.words(data, off, tv.NONSPACE)
        lab = self.labels(data, start, end, tok)
        hit = np.flatnonzero(lab > 0)
        if not len(hit):
            return []
        row = np.searchsorted(tok, hit, "right") - 1
        kind, inner = (lab[hit] - 1) // 2, (lab[hit] - 1) % 2 == 1
        joined = np.zeros(len(hit), bool)
        joined[1:] = inner[1:] & (np.diff(hit) == 1) & (kind[1:] == kind[:-1]) & (row[1:] == row[:-1])
        first = np.flatnonzero(~joined)
        last = np.append(first[1:], len(hit)) - 1
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        out = []
        for a, b in zip(first, last):
            s, e = int(start[hit[a]]), int(end[hit[b]])
            raw = data[s:e].tobytes()
            lead = len(raw) - len(raw.lstrip(b"#*%$&!,.;:\"'<>[]{}|?/_-"))
            raw2 = raw[lead:].rstrip(b"#*%$&!,.;:\"'<>[]{}|?/_-")
            if not raw2:
                continue
            s, e = s + lead, s + lead + len(raw2)
            base = chars[off[row[a]]]
            out.append((int(row[a]), KINDS[kind[a]], int(chars[s] - base), int(chars[e] - base), raw2.decode("utf-8", "replace")))
        return out


_fitted: list[CRF] = []


def default_model() -> CRF:
    """The model of ``labelled_table()``; it takes a few seconds once."""
    if not _fitted:
        _fitted.append(train(labelled_table()))
    return _fitted[0]


def find(docs: DataFrame, model: CRF | None = None) -> DataFrame:
    """doc_id, kind, begin, end, value: personal data in each row of ``docs``.

    begin and end are character positions in the text. Null and empty texts
    have none, a null doc_id stays null, repeated rows repeat their results and
    repeated values each count; of labellings of equal score the one with the
    first labels in ``LABELS`` is taken. Texts of any length are read entire; an
    empty table gives no row. Other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        dec = Decoder(shared.value)
        for b in tv.batches(batches):
            ids, texts = tv.column(b, 0), tv.column(b, 1)
            for lo, hi in tv.slices(texts):
                got = dec.spans(texts.slice(lo, hi - lo))
                if got:
                    r, k, s, e, v = zip(*got)
                    yield pa.record_batch([ids.slice(lo, hi - lo).take(pa.array(r)), pa.array(k), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(v)], ["doc_id", "kind", "begin", "end", "value"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, kind string, begin int, end int, value string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    text_batches(spark)
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
