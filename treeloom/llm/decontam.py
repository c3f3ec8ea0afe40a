"""Benchmark decontamination by edit distance.

Items and the item-sized windows of documents are sequences of word hashes.
The CGK random walk copies a sequence's current word to the output and moves on
only where a random bit of (step, word) says so, which maps edit distance to
Hamming distance. A walk that has lost step with another seldom finds it again
where a fifth of the words are edited, so walks are begun anew along the whole
window: an item's embedding is the walks that begin at each of its words, a
document's those that begin at every ``stride``-th word, and an item-sized
window has all the walks that begin in it, up to its end. A repetition samples
``bits`` steps of a walk, at least ``GAP`` apart so that they see different
words; equal samples make a candidate. Repetitions are added until edited items
are found with ``TARGET_RECALL`` in a simulation (``repetitions``), and
candidates are verified by the exact edit distance of the item to the best
matching stretch of the document.

Work is linear in the text: documents are never shuffled, the items' keys are
broadcast in shards of ``SHARD_WORDS`` words, and more items mean more passes.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import text_batches

MAX_EDITS, TARGET_RECALL = 0.2, 0.97
SHARD_WORDS = 500_000
PER_WALK, GAP, MAX_WALKS = 2, 3, 24
#: By kind of item: its least words, stride of the document's walks, steps of a walk, sampled steps.
KINDS = {"long": (12, 4, 12, 4), "short": (5, 1, 7, 2), "exact": (1, 1, 0, 0)}
_rng = np.random.default_rng(987654321)
_STEP_BITS = _rng.integers(0, 1 << 63, (MAX_WALKS, 16), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def kind_of(n_words: int) -> str:
    """Items of fewer than 5 words allow no edit and are looked up as they are."""
    return next(k for k, x in KINDS.items() if n_words >= x[0])


@lru_cache
def samples(kind: str, walk: int) -> tuple[tuple[int, ...], ...]:
    """The steps of each repetition of a walk."""
    _, _, steps, bits = KINDS[kind]
    rng, out = np.random.default_rng([walk, steps, bits]), []
    while len(out) < PER_WALK:
        s = np.sort(rng.choice(steps, bits, replace=False))
        if (np.diff(s) >= GAP).all():
            out.append(tuple(int(x) for x in s))
    return tuple(out)


def walk_keys(h: np.ndarray, start: np.ndarray, stop: np.ndarray, kind: str, walk: int) -> list[np.ndarray]:
    """A key of each start for each repetition of a walk; beyond ``stop`` it reads padding."""
    reps = samples(kind, walk)
    padded, pad, pos = np.append(h, np.uint64(0)), len(h), start.copy()
    keys = [np.full(len(start), (walk * PER_WALK + k + 1) * len(kind), np.uint64) for k in range(len(reps))]
    for j in range(max(max(s) for s in reps) + 1):
        sym = padded[np.where(pos < stop, pos, pad)]
        for k, s in enumerate(reps):
            if j in s:
                keys[k] = (keys[k] ^ sym) * np.uint64(0xD6E8FEB86659FD93)
                keys[k] ^= keys[k] >> np.uint64(29)
        pos += ((sym * _STEP_BITS[walk, j]) >> np.uint64(63)).astype(np.int64)
    return keys


def exact_keys(h: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """A key of the ``n`` words from each start."""
    padded, key = np.append(h, np.zeros(n, np.uint64)), np.full(len(start), n, np.uint64)
    for j in range(n):
        key = (key ^ padded[np.where(start + j < stop, start + j, len(h))]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
    return key


def edited(words: list[int], r: random.Random, spread: bool) -> list[int]:
    """``words`` with all the edits that are allowed, spread evenly or anywhere."""
    out, n = list(words), int(MAX_EDITS * len(words))
    for k in range(n):
        p = min(len(out) - 1, k * len(out) // n + r.randrange(2)) if spread else r.randrange(len(out))
        op = r.random()
        if op < 0.4:
            out[p] = r.getrandbits(63)
        elif op < 0.7:
            out.insert(p, r.getrandbits(63))
        else:
            del out[p]
    return out


@lru_cache
def repetitions(kind: str, target: float = TARGET_RECALL, trials: int = 400) -> int:
    """Walks that find ``target`` of simulated items with all the edits that are allowed.

    Items are those of the kind's least words that allow most edits for their
    length, which are the hardest: longer ones have more walks that may meet.
    """
    if kind == "exact":
        return 0
    n = KINDS[kind][0] if kind == "short" else 15
    stride, r = KINDS[kind][1], random.Random(17)
    rows, docs = [], []
    for t in range(trials):
        rows.append([r.getrandbits(63) for _ in range(n)])
        docs.append([r.getrandbits(63) for _ in range(8 + t % 4)] + edited(rows[-1], r, t % 2 == 0) + [r.getrandbits(63) for _ in range(20)])
    sides = []
    for x, by in ((rows, 1), (docs, stride)):
        off = np.concatenate([[0], np.cumsum([len(y) for y in x])])
        start = np.concatenate([np.arange(a, b, by) for a, b in zip(off[:-1], off[1:])])
        of = np.searchsorted(off, start, "right") - 1
        sides.append((np.concatenate([np.array(y, np.uint64) for y in x]), start, off[1:][of], of))
    found = np.zeros(trials, bool)
    for w in range(MAX_WALKS):
        a, b = ([tv.mix(k ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) for k in walk_keys(h, start, stop, kind, w)] for h, start, stop, of in sides)
        for x, y in zip(a, b):
            found[sides[1][3][np.isin(y, x)]] = True
        if found.mean() >= target:
            return w + 1
    raise ValueError(f"no {MAX_WALKS} walks reach a recall of {target}")


def item_index(items: list[tuple[int, str]]) -> dict:
    """Sorted keys of all items' walks with the item and its offset, for broadcasting."""
    texts = pa.array([t for _, t in items], pa.string())
    data, off = tv.buffer(texts, lower=True)
    s, e, tok = tv.words(data, off)
    h = tv.span_hash(data, s, e)
    n = np.diff(tok)
    kinds = np.array([kind_of(int(k)) if k else "" for k in n])
    tables, plan = {}, []
    for kind in (k for k in KINDS if (kinds == k).any()):
        of = np.flatnonzero(kinds == kind)
        if kind == "exact":
            for size in np.unique(n[of]):
                on = of[n[of] == size]
                tables[kind, int(size)] = (exact_keys(h, tok[:-1][on], tok[1:][on], int(size)), on, np.zeros(len(on), np.int64))
            continue
        on = np.repeat(of, n[of])
        shift = np.arange(len(on)) - np.repeat(np.cumsum(n[of]) - n[of], n[of])
        got = [k for w in range(repetitions(kind)) for k in walk_keys(h, tok[:-1][on] + shift, tok[1:][on], kind, w)]
        tables[kind, repetitions(kind)] = (np.concatenate(got), np.tile(on, len(got)), np.tile(shift, len(got)))
    for name, (k, i, sh) in tables.items():
        order = np.argsort(k, kind="stable")
        plan.append((name, k[order], i[order].astype(np.int32), sh[order].astype(np.int32)))
    return {"ids": [i for i, _ in items], "words": h, "off": tok, "tables": plan}


def edit_fit(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits (insert, delete, replace a word) that turn ``item`` into a stretch of ``text``, and that stretch.

    Rows of the dynamic programme run over the text at once; the begin of the
    best stretch is carried along. Of equal stretches the first to end counts.
    """
    n = len(text)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    big = n + len(item) + 2
    for w in item:
        up, diag = cost + 1, cost[:-1] + (text != w)
        best = up.copy()
        frm = begin.copy()
        take = diag < up[1:]
        best[1:][take] = diag[take]
        frm[1:][take] = begin[:-1][take]
        # Left moves: running minimum of (best - position), remembering where it was reached.
        key = (best - steps) * big + (n - steps)
        run = np.minimum.accumulate(key)
        src = n - run % big
        cost, begin = best[src] + (steps - src), frm[src]
    at = int(cost.argmin())
    return int(cost[at]), int(begin[at]), at


class Matcher:
    """Finds an index's items in the texts of a slice."""

    def __init__(self, shared: dict):
        self.ix, self.tables = shared, []
        for name, k, i, sh in shared["tables"]:
            uniq, first, count = np.unique(k, return_index=True, return_counts=True)
            # Most keys of a document are in no item; a map of one byte for 32 slots a key tells so without a probe.
            bits = max(10, int(32 * len(uniq)).bit_length())
            there = np.zeros(1 << bits, bool)
            there[(uniq >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables.append((name, np.uint64(64 - bits), there, tv.IntTable(uniq), first, count, i, sh))
        self.size = np.diff(shared["off"])
        self.most = (MAX_EDITS * self.size).astype(np.int64)
        of = np.repeat(np.arange(len(self.size), dtype=np.uint64), self.size)
        self.members = tv.IntTable(np.unique(self._member(shared["words"], of)))
        same = np.flatnonzero(of[1:] == of[:-1])
        self.pairs = tv.IntTable(np.unique(self._member(self._pair(shared["words"])[same], of[same])))

    @staticmethod
    def _member(word: np.ndarray, item: np.ndarray) -> np.ndarray:
        return tv.mix(word ^ (item * np.uint64(0x9E3779B97F4A7C15)))

    @staticmethod
    def _pair(words: np.ndarray) -> np.ndarray:
        """Of each word with the next one."""
        return tv.mix(words[:-1]) + words[1:]

    def _likely(self, cand: np.ndarray, h: np.ndarray, tok: np.ndarray) -> np.ndarray:
        """Candidates (row, item, at) around whose place enough words and pairs of words are the item's: each edit can miss one word and two pairs only."""
        cand = self._enough(cand, h, tok, self.members, self.size - self.most)
        return self._enough(cand, self._pair(h), tok, self.pairs, self.size - 1 - 2 * self.most)

    def _enough(self, cand: np.ndarray, h: np.ndarray, tok: np.ndarray, members: tv.IntTable, least: np.ndarray) -> np.ndarray:
        kept = []
        for k in range(0, len(cand), 1 << 15):
            part = cand[k : k + (1 << 15)]
            row, item, at = part.T
            lo, hi = self._around(row, item, at, tok)
            n = np.maximum(np.minimum(hi, len(h)) - lo, 0)
            off = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=off[1:])
            pos = np.repeat(lo - off[:-1], n) + np.arange(off[-1])
            there = members.find(self._member(h[pos], np.repeat(item, n).astype(np.uint64))) >= 0
            kept.append(part[tv.sum_by(there.astype(np.int64), off) >= least[item]])
        return np.concatenate(kept) if kept else cand

    def _around(self, row: np.ndarray, item: np.ndarray, at: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where an item with all its edits can lie if its begin falls on ``at`` by the place of some word of it."""
        lo = np.maximum(tok[row], at - self.most[item])
        return lo, np.maximum(lo, np.minimum(tok[row + 1], at + self.size[item] + 2 * self.most[item]))

    def _hits(self, h: np.ndarray, tok: np.ndarray):
        """(row, item, at) of equal keys, by key."""
        n = np.diff(tok)
        begun: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for (kind, reps), shift, there, table, first, count, item, off in self.tables:
            stride = KINDS[kind][1]
            if stride not in begun:
                per = -(-n // stride)
                row = np.repeat(np.arange(len(n)), per)
                base = np.concatenate([[0], np.cumsum(per)])
                begun[stride] = row, tok[:-1][row] + stride * (np.arange(base[-1]) - base[:-1][row])
            row, start = begun[stride]
            stop = tok[1:][row]
            keys = (k for w in range(reps) for k in walk_keys(h, start, stop, kind, w)) if kind != "exact" else [exact_keys(h, start, stop, reps)]
            for key in keys:
                hit = np.flatnonzero(there[(key >> shift).astype(np.int64)])
                pos = table.find(key[hit])
                hit, pos = hit[pos >= 0], pos[pos >= 0]
                if len(hit):
                    times = count[pos]
                    at = np.repeat(first[pos], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    w = np.repeat(hit, times)
                    yield row[w], item[at].astype(np.int64), start[w] - off[at]

    def match(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, edits, first word, end word) of the best stretch for each item that a text contains."""
        ix = self.ix
        data, off = tv.buffer(texts, lower=True)
        s, e, tok = tv.words(data, off)
        if not len(s) or not self.tables:
            return []
        h = tv.span_hash(data, s, e)
        ahead = int(self.size.max())
        n_items, span = len(self.size), len(h) + ahead + 1
        found = [np.unique((row * n_items + item) * span + at + ahead) for row, item, at in self._hits(h, tok)]
        if not found:
            return []
        packed = np.unique(np.concatenate(found))
        cand = np.stack([packed // (n_items * span), packed // span % n_items, packed % span - ahead], 1)
        cand = self._likely(cand, h, tok)
        row, item, at = cand.T
        lo, hi = self._around(row, item, at, tok)
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        # Candidates of a row and item whose surroundings meet are one stretch to look through; they are in order of place.
        k = 0
        while k < len(cand):
            r, i, a, b = int(row[k]), int(item[k]), int(lo[k]), int(hi[k])
            k += 1
            while k < len(cand) and row[k] == r and item[k] == i and lo[k] <= b:
                b = max(b, int(hi[k]))
                k += 1
            best = out.get((r, i))
            if best and best[0] == 0:
                continue
            cost, x, y = edit_fit(ix["words"][ix["off"][i] : ix["off"][i + 1]], h[a:b])
            if cost <= self.most[i] and (best is None or cost < best[0]):
                out[r, i] = (cost, a + x - int(tok[r]), a + y - int(tok[r]))
        return [(r, i, *v) for (r, i), v in sorted(out.items())]


def shards(items: DataFrame):
    """Indexes of all items with an id and a word, each of about ``SHARD_WORDS`` words, read as a stream."""
    part: list[tuple[int, str]] = []
    size = 0
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        part.append((r[0], r[1]))
        size += len(r[1]) // 5 + 1
        if size >= SHARD_WORDS:
            yield item_index(part)
            part, size = [], 0
    if part:
        yield item_index(part)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, first_word, end_word: items that a document contains with at most ``MAX_EDITS`` of their words edited.

    Words are lower-cased runs of letters and digits. One row for each row of
    ``docs`` and item, of the stretch with the fewest edits (ties: the first in
    the text). Null or empty texts contain nothing, items without a word are in
    no document, a null doc_id stays null, repeated rows repeat their results,
    repeated items count once (one id with two texts is two items of that id).
    Texts and items of any length are read entire; an empty table of documents
    or of items gives no row. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits int, first_word int, end_word int"
    out = None
    for index in shards(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            m = Matcher(shared.value)
            ids_of = shared.value["ids"]
            for b in tv.batches(batches):
                ids, texts = tv.column(b, 0), tv.column(b, 1)
                for lo, hi in tv.slices(texts):
                    got = m.match(texts.slice(lo, hi - lo))
                    if got:
                        r, i, c, f, e = zip(*got)
                        yield pa.record_batch([ids.slice(lo, hi - lo).take(pa.array(r)), pa.array([ids_of[k] for k in i], pa.int64()), pa.array(c, pa.int32()), pa.array(f, pa.int32()), pa.array(e, pa.int32())], ["doc_id", "item_id", "edits", "first_word", "end_word"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that contain no item by the rule of ``contaminated``, with all columns; the test runs beside the row.

    Null and empty texts stay, as do rows with a null doc_id that hold no item;
    repeated rows share their fate; without items all rows stay; a column may
    have any name.
    """
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for index in shards(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            m = Matcher(shared.value)
            for b in tv.batches(batches):
                texts = tv.column(b, at)
                for lo, hi in tv.slices(texts):
                    keep = np.ones(hi - lo, bool)
                    keep[[x[0] for x in m.match(texts.slice(lo, hi - lo))]] = False
                    yield b.slice(lo, hi - lo).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    text_batches(spark)
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
