"""Language-model scoring with a weighted backoff automaton.

The automaton has two kinds of states. Those of bytes are contexts of up to
``ORDER - 1`` bytes: every n-gram of bytes that occurs in any document is an
arc, smoothed by Witten-Bell, and a failure arc with the backoff weight leads to
the next shorter context. There are at most 257 ** ``ORDER`` of them whatever
the corpus, so they are broadcast. Those of phrases are the phrase that was read
last: texts are cut after every word whose hash is 0 modulo ``CUT``, which cuts
repeated passages alike wherever they stand. Each phrase that follows another
anywhere in the corpus is an arc, with ``n`` of ``whole`` occurrences; the
failure arc leads into the bytes, with ``PRIOR`` occurrences to share
(Dirichlet smoothing): (n + PRIOR * bytes) / (whole + PRIOR). Arcs of phrases
are never pruned and grow with the corpus; they stay a table, which positions
meet by joins, so no machine holds them all.

One traversal from left to right carries the byte state of a text, adds up
log-probabilities and notes them at the ends of phrases; where the state of a
phrase is known, what its arc says takes their place. Long texts are cut into
stretches that begin ``ORDER - 1`` bytes early, which brings the automaton to
the very state it would have had. A text that is scored under the corpus that
holds it would be predicted from itself, so its own occurrences of phrases are
taken off the counts (``own``): what is left tells what the rest of the corpus
knows of it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import materialize, text_batches

ORDER, CUT, PRIOR = 3, 8, 1.0
STRETCH = 512


class Model(NamedTuple):
    """The byte states, and the table (ctx, pair, n) of phrase arcs: ``pair`` is a phrase after ``ctx``."""

    bytes: dict
    arcs: DataFrame


def _windows(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each byte + 1 with the ORDER - 1 before it in its text, 9 bits each; zeros stand before the begin."""
    sym = data.astype(np.uint64) + np.uint64(1)
    at = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    g = sym.copy()
    for j in range(1, ORDER):
        prev = np.zeros(len(data), np.uint64)
        if j < len(data):
            prev[j:] = sym[:-j]
        prev[at < j] = 0
        g |= prev << np.uint64(9 * j)
    return g


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, n): how often each window of ORDER bytes ends at a position, over all texts."""

    def run(batches):
        c = tv.Counter64()
        for b in tv.batches(batches):
            texts = tv.column(b, 0)
            for lo, hi in tv.slices(texts, 4 * tv.SLICE_BYTES):
                data, off = tv.buffer(texts.slice(lo, hi - lo))
                if len(data):
                    c.add(_windows(data, off))
        c.fold()
        for lo in range(0, len(c.keys), 1 << 18):
            yield pa.record_batch([pa.array(c.keys[lo : lo + (1 << 18)].astype(np.int64)), pa.array(c.counts[lo : lo + (1 << 18)])], ["gram", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null and text <> ''")
    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def byte_states(docs: DataFrame) -> dict:
    """The automaton of all n-grams of bytes; at most 257 ** ORDER counts reach the driver."""
    rows = count_grams(docs).toPandas()
    order = np.argsort(rows["gram"].to_numpy(), kind="stable")
    top, n = rows["gram"].to_numpy()[order].astype(np.uint64), rows["n"].to_numpy()[order]
    return automaton(*levels(top, n))


def levels(top: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """N-grams of each order with their counts: a shorter one occurs wherever a longer one ends with it."""
    keys, counts = [], []
    for k in range(1, ORDER + 1):
        c = tv.Counter64()
        c.add(top & np.uint64((1 << (9 * k)) - 1), n)
        c.fold()
        keys.append(c.keys)
        counts.append(c.counts.astype(np.float64))
    return keys, counts


def automaton(keys: list[np.ndarray], counts: list[np.ndarray]) -> dict:
    """States, arcs with log10 probabilities and next states, failure states and backoff weights, by Witten-Bell."""
    names = [np.zeros(1, np.uint64)]  # state ids by order of context: (context, its first id)
    first = [0]
    for k in range(1, ORDER):
        ctx = np.unique(keys[k] >> np.uint64(9))
        names.append(ctx)
        first.append(first[-1] + len(names[k - 1]))
    n_states = first[-1] + len(names[-1])
    tables = [tv.IntTable(c) for c in names]

    def state(ctx: np.ndarray, k: int) -> np.ndarray:
        """The state of the longest suffix of contexts of k symbols."""
        out = np.zeros(len(ctx), np.int32)
        left = np.arange(len(ctx))
        for j in range(k, 0, -1):
            pos = tables[j].find(ctx[left] & np.uint64((1 << (9 * j)) - 1))
            out[left[pos >= 0]] = first[j] + pos[pos >= 0]
            left = left[pos < 0]
        return out

    fail, back = np.zeros(n_states, np.int32), np.zeros(n_states, np.float32)
    prob_by: list[np.ndarray] = []
    arc_key, arc_p, arc_to = [], [], []
    for k in range(ORDER):  # contexts of k symbols, n-grams of k + 1
        grams, n = keys[k], counts[k]
        ctx, sym = grams >> np.uint64(9), grams & np.uint64(511)
        at = np.searchsorted(names[k], ctx)
        # Occurrences of the context: the kept count of it, or all positions at order 0.
        if k:
            known, times = (np.append(x, x.dtype.type(0)) for x in (keys[k - 1], counts[k - 1]))
            pos = np.minimum(np.searchsorted(known[:-1], names[k]), len(known) - 1)
            # A context of padding alone is no n-gram: it occurs as often as its kept continuations.
            whole = np.where(known[pos] == names[k], times[pos], 0)
            whole = np.maximum(whole, np.bincount(at, n, len(names[k])))
        else:
            whole = np.array([max(1.0, n.sum())])
        kinds = np.bincount(at, minlength=len(names[k])).astype(np.float64)
        escape = (whole - np.bincount(at, n, len(names[k])) + kinds) / (whole + kinds)
        if k:
            lower = prob_by[k - 1][np.searchsorted(keys[k - 1], grams & np.uint64((1 << (9 * k)) - 1))]
        else:
            lower = np.full(len(grams), 1 / 256)
        p = n / (whole + kinds)[at] + escape[at] * lower
        prob_by.append(p)
        ids = first[k] + np.arange(len(names[k]))
        back[ids] = np.log10(escape)
        if k:
            fail[ids] = state(names[k] & np.uint64((1 << (9 * (k - 1))) - 1), k - 1)
        arc_key.append((first[k] + at).astype(np.uint64) << np.uint64(9) | sym)
        arc_p.append(np.log10(p).astype(np.float32))
        arc_to.append(state(grams, k + 1) if k + 1 < ORDER else state(grams & np.uint64((1 << (9 * (ORDER - 1))) - 1), ORDER - 1))
    begin = int(state(np.zeros(1, np.uint64), ORDER - 1)[0])
    return {"begin": begin, "arcs": np.concatenate(arc_key), "p": np.concatenate(arc_p), "to": np.concatenate(arc_to).astype(np.int32), "fail": fail, "back": back}


class Traverser:
    """Runs texts through the automaton, all stretches of a slice abreast."""

    def __init__(self, a: dict):
        self.a, self.table = a, tv.IntTable(a["arcs"])
        self.root = np.log10(1 / 256).astype(np.float32)

    def step(self, state: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log10 probabilities of one symbol each."""
        a = self.a
        pos = self.table.find(state.astype(np.uint64) << np.uint64(9) | sym)
        miss = np.flatnonzero(pos < 0)
        if not len(miss):
            return a["to"][pos], a["p"][pos]
        logp, to = np.zeros(len(sym), np.float32), np.zeros(len(sym), np.int32)
        hit = np.flatnonzero(pos >= 0)
        logp[hit], to[hit] = a["p"][pos[hit]], a["to"][pos[hit]]
        at = state[miss]
        while len(miss):
            logp[miss] += a["back"][at]
            base = at == 0  # the empty context has no symbol: a uniform byte
            logp[miss[base]] += self.root
            miss, at = miss[~base], a["fail"][at[~base]]
            pos = self.table.find(at.astype(np.uint64) << np.uint64(9) | sym[miss])
            ok = pos >= 0
            logp[miss[ok]] += a["p"][pos[ok]]
            to[miss[ok]] = a["to"][pos[ok]]
            miss, at = miss[~ok], at[~ok]
        return to, logp

    def bytes(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Log10 probability of each byte after those before it in its text."""
        size = np.diff(off)
        out = np.zeros(len(data), np.float32)
        if not len(data):
            return out
        parts = -(-size // STRETCH)
        text = np.repeat(np.arange(len(size)), parts)
        base = np.zeros(len(size) + 1, np.int64)
        np.cumsum(parts, out=base[1:])
        begin = off[:-1][text] + STRETCH * (np.arange(base[-1]) - base[:-1][text])
        end = np.minimum(begin + STRETCH, off[1:][text])
        warm = np.minimum(begin - off[:-1][text], ORDER - 1)
        order = np.argsort(-(end - begin + warm), kind="stable")  # so that those that still run come first
        text, begin, end, warm = text[order], begin[order], end[order], warm[order]
        length = end - begin + warm
        state = np.where(warm == 0, self.a["begin"], 0).astype(np.int32)
        running = len(text)
        sym_of = data.astype(np.uint64) + np.uint64(1)
        for t in range(int(length[0])):
            running = int(np.searchsorted(-length[:running], -t, "left"))
            at = begin[:running] - warm[:running] + t
            state[:running], logp = self.step(state[:running], sym_of[at])
            on = t >= warm[:running]
            out[at[on]] = logp[on]
        return out


def phrases(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the phrases of each text, which together are the text, and their offsets by text.

    A phrase ends with the one space after a word whose hash is 0 modulo CUT, or with the text.
    """
    start, end, tok = tv.words(data, off, tv.NONSPACE)
    last = end[(tv.span_hash(data, start, end) % np.uint64(CUT) == 0) & (end < off[1:][tv.doc_of(tok)])]
    begin = np.unique(np.concatenate([off[:-1], last + 1]))
    begin = begin[begin < len(data)]
    return begin, np.append(begin[1:], len(data)), np.searchsorted(begin, off)


def phrase_arcs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, begin, end, ctx, pair) of each phrase but the first of a text; ctx names the phrase before."""
    begin, end, at = phrases(data, off)
    h = tv.span_hash(data, begin, end)
    later = np.ones(len(begin), bool)
    later[at[:-1][np.diff(at) > 0]] = False
    on = np.flatnonzero(later)
    ctx = h[on - 1]
    pair = tv.mix(ctx * np.uint64(0xD6E8FEB86659FD93) + h[on])
    return tv.doc_of(at)[on], begin[on], end[on], ctx.view(np.int64), pair.view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def count_arcs(docs: DataFrame) -> DataFrame:
    """(ctx, pair, n): how often each phrase follows each, over all texts."""

    def run(batches):
        for b in tv.batches(batches):
            texts = tv.column(b, 0)
            for lo, hi in tv.slices(texts, 4 * tv.SLICE_BYTES):
                *_, ctx, pair = phrase_arcs(*tv.buffer(texts.slice(lo, hi - lo)))
                _, at, n = np.unique(pair, return_index=True, return_counts=True)
                if len(at):
                    yield pa.record_batch([pa.array(ctx[at]), pa.array(pair[at]), pa.array(n)], ["ctx", "pair", "n"])

    rows = _texts(docs).select("text").where("text is not null and text <> ''").mapInArrow(run, "ctx long, pair long, n long")
    return rows.groupBy("ctx", "pair").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Model:
    """The automaton of all documents; rows with a null or empty text add nothing, repeated rows count each time."""
    return Model(byte_states(docs), materialize(count_arcs(docs), "arcs"))


_PHRASE = pa.struct([("ctx", pa.int64()), ("pair", pa.int64()), ("base", pa.float64()), ("own", pa.int32()), ("own_whole", pa.int32())])


def spelled(docs: DataFrame, states: dict, own: bool) -> DataFrame:
    """doc_id, n_bytes, base, phrases: texts under the byte states, with their phrases' arcs and own occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(states)

    def times(text: np.ndarray, what: np.ndarray) -> np.ndarray:
        _, back, n = np.unique(tv.mix(what.view(np.uint64) ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_inverse=True, return_counts=True)
        return n[back] if own else np.zeros(len(what), np.int64)

    def run(batches):
        tr = Traverser(shared.value)
        for b in tv.batches(batches):
            ids, texts = tv.column(b, 0), tv.column(b, 1)
            for lo, hi in tv.slices(texts, 4 * tv.SLICE_BYTES):
                data, off = tv.buffer(texts.slice(lo, hi - lo))
                logp = np.concatenate([[0.0], np.cumsum(tr.bytes(data, off), dtype=np.float64)])
                text, begin, end, ctx, pair = phrase_arcs(data, off)
                cols = [pa.array(ctx), pa.array(pair), pa.array(logp[end] - logp[begin]), *(pa.array(times(text, x), pa.int32()) for x in (pair, ctx))]
                rows = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(hi - lo + 1)), pa.int32()), pa.StructArray.from_arrays(cols, fields=list(_PHRASE)))
                yield pa.record_batch([ids.slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(logp[off[1:]] - logp[off[:-1]]), rows], ["doc_id", "n_bytes", "base", "phrases"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_bytes long, base double, phrases array<struct<ctx: long, pair: long, base: double, own: int, own_whole: int>>")


def score(docs: DataFrame, model: Model, own: bool = False) -> DataFrame:
    """doc_id, n_bytes, log10_prob, bits_per_byte of every row of ``docs``.

    ``own`` says that the model is of these documents: a row's own occurrences
    of phrases are then left out of account, those of its copies are not, so
    copies score apart from texts that occur once. A null or empty text has 0
    bytes, log-probability 0 and a null bits_per_byte; a null doc_id stays null;
    repeated rows each get their row; texts of any length are read entire.
    Columns other than doc_id and text are ignored, whatever their names. A
    model of an empty corpus gives uniform bytes; an empty table gives no row.
    """
    # The row's number is stored with it, so it stays the same when a task is run again.
    rows = materialize(spelled(docs, model.bytes, own).withColumn("row", F.monotonically_increasing_id()), "spelled")
    places = rows.select("row", F.explode("phrases").alias("x")).select("row", "x.*")
    whole = model.arcs.groupBy("ctx").agg(F.sum("n").alias("whole")).where("whole > 1" if own else "true")
    known = places.join(whole, "ctx").where("whole > own_whole").join(model.arcs, ["ctx", "pair"], "left")
    seen = F.coalesce("n", F.lit(0)) - F.col("own")
    arc = F.when(seen > 0, F.log10(seen + PRIOR * F.pow(F.lit(10.0), F.col("base")))).otherwise(float(np.log10(PRIOR)) + F.col("base"))
    gain = arc - F.log10(F.col("whole") - F.col("own_whole") + PRIOR) - F.col("base")
    gains = known.groupBy("row").agg(F.sum(gain).alias("gain"))
    logp = F.col("base") + F.coalesce("gain", F.lit(0.0))
    out = rows.select("row", "doc_id", "n_bytes", "base").join(gains, "row", "left").select("doc_id", "n_bytes", logp.alias("log10_prob"))
    return out.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("log10_prob") * float(np.log2(10)) / F.col("n_bytes")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the model of all documents."""
    text_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs), own=True)
