"""Language identification by prediction by partial matching (PPM).

Per language a variable-order byte context tree holds symbol counts below each
context of up to ``ORDER`` bytes. The code length of a byte under the frozen
counts is that of PPM method C without exclusions: from the longest context
that the language has seen, an escape of probability ``d / (n + d)`` is paid
(n: occurrences of the context, d: distinct symbols after it) until a context
has the symbol, which then costs ``-log2(c / (n + d))``; the last resort is a
uniform byte. With frozen counts that length depends on the last ``ORDER``
bytes alone, so it is worked out once for each n-gram of the trees and looked
up for all bytes of a batch at once; the sums are the exact code lengths.
Texts are lower-cased first, for capitals tell the kind of a text rather than
its language; code lengths and bytes are those of the lower-cased text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import text_batches

ORDER = 3
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _grams(data: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """Each byte with the k - 1 before it in its text (zero bytes before its begin), as one integer."""
    g = data.astype(np.uint64)
    at = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    for j in range(1, k):
        prev = np.zeros(len(data), np.uint64)
        prev[j:] = data[:-j] if j < len(data) else 0
        prev[at < j] = 0
        g |= prev << np.uint64(8 * j)
    return g


def training_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` labelled documents of each language, those of the least hash of doc_id.

    Only doc_id and lang are read to choose them; whole texts are then taken.
    """
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    # The limit on row_number is applied within each task before anything is moved.
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = ids.withColumn("__r", F.row_number().over(rank)).where(F.col("__r") <= per_language).select("lang", F.col("doc_id").cast("long").alias("doc_id")).distinct().collect()
    session = docs.sparkSession
    picked = session.createDataFrame([(r.doc_id, r.lang) for r in rows], "doc_id long, lang string")
    return docs.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"], "left_semi")


def train(docs: DataFrame, per_language: int = 300) -> dict:
    """Count the context trees over the labelled sample; the result is bounded by it."""

    def count(batches):
        by: dict = {}
        for b in tv.batches(batches):
            langs, texts = tv.column(b, 0).to_pylist(), tv.column(b, 1)
            for i, lang in enumerate(langs):
                data, off = tv.buffer(texts.slice(i, 1), lower=True)
                if len(data):
                    by.setdefault(lang, tv.Counter64()).add(_grams(data, off, ORDER + 1))
        for lang, c in by.items():
            c.fold()
            yield pa.record_batch([pa.array([lang] * len(c.keys)), pa.array(c.keys.astype(np.int64)), pa.array(c.counts)], ["lang", "gram", "n"])

    counts = training_sample(docs, per_language).select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return code_lengths(counts.toPandas())


def code_lengths(counts) -> dict:
    """Tables of exact PPM-C code lengths in bits from (lang, gram, n) counts.

    ``costs[k]`` has a row for each (k + 1)-gram that any language has seen and
    ``escapes[k]`` one for each k-byte context; columns are languages.
    """
    langs = sorted(counts["lang"].unique()) if len(counts) else []
    by = {lang: (g["gram"].to_numpy().astype(np.uint64), g["n"].to_numpy()) for lang, g in counts.groupby("lang")}
    grams, costs, contexts, escapes = [], [], [], []
    for k in range(ORDER + 1):  # contexts of k bytes, grams of k + 1
        mask = np.uint64((1 << (8 * (k + 1))) - 1)
        own = []
        for lang in langs:
            c = tv.Counter64()
            c.add(by[lang][0] & mask, by[lang][1])
            c.fold()
            own.append((c.keys, c.counts))
        keys = np.unique(np.concatenate([o[0] for o in own])) if own else np.zeros(0, np.uint64)
        ctx = np.unique(keys >> np.uint64(8))
        cost, esc = np.zeros((len(keys), len(langs)), np.float32), np.zeros((len(ctx), len(langs)), np.float32)
        at = np.searchsorted(ctx, keys >> np.uint64(8))
        if k:  # what the next shorter context charges for the same symbol
            short = keys & np.uint64((1 << (8 * k)) - 1)
            lower = costs[k - 1][np.searchsorted(grams[k - 1], short)]
        else:
            lower = np.full(cost.shape, 8.0, np.float32)
        for j, (g, n) in enumerate(own):
            pos = np.searchsorted(keys, g)
            c = np.zeros(len(keys))
            c[pos] = n
            total = np.bincount(at, c, len(ctx))
            kinds = np.bincount(at, c > 0, len(ctx))
            with np.errstate(divide="ignore", invalid="ignore"):
                e = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                cost[:, j] = np.where(c > 0, -np.log2(c / (total + kinds)[at]), e[at] + lower[:, j])
            esc[:, j] = e
        grams.append(keys)
        costs.append(cost)
        contexts.append(ctx)
        escapes.append(esc)
    return {"langs": langs, "grams": grams, "costs": costs, "contexts": contexts, "escapes": escapes}


class Scorer:
    """Adds up code lengths of whole texts for all languages."""

    def __init__(self, model: dict):
        self.m = model
        self.tables = [tv.IntTable(g) for g in model["grams"]]
        self.contexts = [tv.IntTable(c) for c in model["contexts"]]

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        cost = self.costs(data, off)
        return np.stack([tv.sum_by(cost[:, j].astype(np.float64), off) for j in range(cost.shape[1])], 1) if cost.shape[1] else np.zeros((len(off) - 1, 0))

    def decide(self, data: np.ndarray, off: np.ndarray, max_bits: float, slack_bits: float) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text under each language, and whether the best one accepts it.

        The test leaves out words with digits: keys, hashes and numbers tell
        nothing about the language that they stand in.
        """
        n = len(off) - 1
        if not self.m["langs"] or not len(data):
            return np.zeros((n, len(self.m["langs"]))), np.zeros(n, bool)
        cost = self.costs(data, off)
        bits = np.stack([tv.sum_by(cost[:, j].astype(np.float64), off) for j in range(cost.shape[1])], 1)
        start, end, _ = tv.words(data, off, tv.NONSPACE)
        digits = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data >= 48) & (data <= 57), out=digits[1:])
        coded = digits[end] > digits[start]
        step = np.zeros(len(data) + 1, np.int8)
        step[start[coded]] = 1
        step[end[coded]] -= 1
        on = np.cumsum(step[:-1], dtype=np.int8) == 0
        own = cost[np.arange(len(data)), np.repeat(bits.argmin(1), np.diff(off))]
        low, size = tv.sum_by(np.where(on, own, 0).astype(np.float64), off), tv.sum_by(on.astype(np.int64), off)
        letters = tv.sum_by((on & _LETTER[data]).astype(np.int64), off)
        return bits, (letters > 0) & (low <= max_bits * size + slack_bits)

    def costs(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each byte under each language."""
        m, n_lang = self.m, len(self.m["langs"])
        if not len(data):
            return np.zeros((0, n_lang), np.float32)
        full = _grams(data, off, ORDER + 1)
        cost = np.zeros((len(data), n_lang), np.float32)
        left, k = np.arange(len(data)), ORDER
        while len(left):
            if k < 0:
                cost[left] += 8.0
                break
            g = full[left] & np.uint64((1 << (8 * (k + 1))) - 1)
            pos = self.tables[k].find(g)
            hit = pos >= 0
            if hit.all() and len(left) == len(data):
                cost = m["costs"][k][pos]
                break
            cost[left[hit]] += m["costs"][k][pos[hit]]
            left, g = left[~hit], g[~hit]
            ctx = self.contexts[k].find(g >> np.uint64(8))
            seen = ctx >= 0
            cost[left[seen]] += m["escapes"][k][ctx[seen]]
            k -= 1
        return cost


def identify(docs: DataFrame, model: dict, max_bits: float = 5.5, slack_bits: float = 64.0) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_id, bits_per_byte, margin_bits.

    lang_id is the language of the shortest code. It is ``und`` where no model
    compresses the text less its words with digits: more than ``max_bits`` a
    byte beyond ``slack_bits`` for the begin (uniform bytes cost 8); where what
    is left has no letter, or the text is empty or null; and where the table has
    no labelled text at all. Ties go to the first language by
    name. margin_bits is the second shortest code less the shortest (null with
    fewer than two languages). Repeated rows each get their row; texts of any
    length are read entire; an empty table gives no row; other columns of
    ``docs`` are ignored, whatever their names; a null doc_id stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        langs = shared.value["langs"]
        for b in tv.batches(batches):
            ids, texts = tv.column(b, 0), tv.column(b, 1)
            for lo, hi in tv.slices(texts):
                data, off = tv.buffer(texts.slice(lo, hi - lo), lower=True)
                size = np.diff(off)
                bits, accepted = scorer.decide(data, off, max_bits, slack_bits)
                if langs:
                    best = bits.argmin(1)
                    low = bits[np.arange(len(best)), best]
                    margin = np.partition(bits, 1, 1)[:, 1] - low if len(langs) > 1 else np.full(len(best), np.nan)
                else:
                    best, low, margin = np.zeros(hi - lo, int), np.zeros(hi - lo), np.full(hi - lo, np.nan)
                name = [langs[i] if x else UNKNOWN for x, i in zip(accepted, best)]
                per = np.where(size > 0, low / np.maximum(size, 1), np.nan)
                yield pa.record_batch([ids.slice(lo, hi - lo), pa.array(name, pa.string()), pa.array(per, from_pandas=True), pa.array(margin, from_pandas=True)], ["doc_id", "lang_id", "bits_per_byte", "margin_bits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_id string, bits_per_byte double, margin_bits double")


def keep_identified(docs: DataFrame, model: dict, max_bits: float = 5.5, slack_bits: float = 64.0) -> DataFrame:
    """Rows of ``docs`` whose text a model compresses, by the rule of ``identify``, with all their columns.

    Null and empty texts have no language and go, as all do where the table has
    no labelled text; repeated rows share their fate; texts of any length are
    judged entire; columns may have any names. The test runs beside the row, so
    nothing is joined or shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(shared.value)
        for b in tv.batches(batches):
            texts = tv.column(b, at)
            for lo, hi in tv.slices(texts):
                data, off = tv.buffer(texts.slice(lo, hi - lo), lower=True)
                _, keep = scorer.decide(data, off, max_bits, slack_bits)
                if keep.any():
                    yield b.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and code length of every document."""
    text_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
