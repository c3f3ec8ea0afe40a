"""Near-duplicate groups from SetSketch registers.

Every text becomes the set of its word 3-grams. Register i of its sketch is the
exponentially spaced, truncated minimum ``clip(floor(1 - log_b(min h_i)), 0, q + 1)``
with ``h_i`` exponentially distributed of rate ``A``; sketches merge by an
element-wise maximum, and equal registers are about as likely as the Jaccard
similarity. Bands of registers name buckets, pairs within a bucket are estimated
jointly by maximum likelihood from the counts of larger, smaller and equal
registers, and what may reach the threshold is verified on the texts themselves.
Groups are the connected components of verified pairs.

Only groups are wanted, so a bucket's members are first compared with one of
them, its pivot, the one whose buckets are largest: what is verified with the
pivot is one group, and pairs within it need no look. Pairs of the others, with
one another and with that group, are all compared, whatever the bucket's size.
A bucket of n copies takes n comparisons, in one task or many: members are cut
into blocks of about ``BLOCK`` and blocks meet pair by pair.

Sizes: the sketch pass moves nothing; (band, doc_id) pairs are aggregated by
bucket; buckets of two or more move ids, and registers travel once for each
distinct pair or member of a block, not for each band; a bucket with the same
members as another is looked at once. Texts of documents in likely pairs alone
are shuffled, once for each pair's end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import materialize, text_batches

M, BAND, BASE, A, Q = 96, 3, 1.001, 20.0, 65534
SHINGLE, THRESHOLD, MARGIN, BLOCK, BROADCAST_IDS = 3, 0.5, 0.16, 4096, 4_000_000
_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(1 << 62, 1 << 63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, M, dtype=np.uint64)


def registers(minima: np.ndarray) -> np.ndarray:
    """SetSketch registers from the minima of uniform 32-bit hashes (documents x M)."""
    u = (minima.astype(np.float64) + 0.5) / 2.0**32
    x = -np.log1p(-u) / A
    return np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def cardinality(regs: np.ndarray) -> np.ndarray:
    """Estimated number of distinct elements."""
    return M * (1 - 1 / BASE) / (A * np.log(BASE) * np.exp(-regs.astype(np.float64) * np.log(BASE)).sum(-1))


def joint_estimate(more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from counts of registers that are larger and smaller in u, and the sizes."""
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    equal, step, log_b = M - more - less, (BASE - 1) / BASE, np.log(BASE)
    top = np.minimum(u / v, v / u)
    # In the limit of base 1 the maximum is the root of a quadratic; for this base it is next to it.
    lin = equal * (u * u + v * v) + more * v * v + less * u * u
    j = np.minimum(2 * equal * u * v / np.maximum(lin + np.sqrt(np.maximum(lin * lin - 4 * u * u * v * v * M * equal, 0)), 1e-300), top)
    lo, hi = np.maximum(j - 0.02, 0), np.minimum(j + 0.02, top)
    for _ in range(9):  # halve the bracket where the concave log-likelihood still rises
        j = (lo + hi) / 2
        x, y = np.clip(u - v * j, 1e-12, 1), np.clip(v - u * j, 1e-12, 1)
        p, q = -np.log1p(-x * step) / log_b, -np.log1p(-y * step) / log_b
        dp, dq = v * step / ((1 - x * step) * log_b), u * step / ((1 - y * step) * log_b)
        rises = equal * (dp + dq) / np.maximum(1 - p - q, 1e-12) > more * dp / p + less * dq / q
        lo, hi = np.where(rises, j, lo), np.where(rises, hi, j)
    return (lo + hi) / 2


def sketch_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word counts, two hashes of the word sequence, and the registers of each text (zeros where it has no word)."""
    data, off = tv.buffer(texts, lower=True)
    start, end, tok = tv.words(data, off)
    h = tv.span_hash(data, start, end)
    n = np.diff(tok)
    g, goff = tv.shingles(h, tok, SHINGLE)
    regs, full = np.zeros((len(n), M), np.uint16), n > 0
    if full.any():
        at = goff[:-1][full]
        minima = np.empty((int(full.sum()), M), np.uint32)
        for i in range(M):
            minima[:, i] = np.minimum.reduceat(((g * _MULT[i] + _ADD[i]) >> np.uint64(32)).astype(np.uint32), at)
        regs[full] = registers(minima)
    return n, tv.run_hash(h, tok, 1), tv.run_hash(h, tok, 2), regs


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2, regs, bands of every row with an id and a word."""

    def run(batches):
        for b in tv.batches(batches):
            ids, texts = tv.column(b, 0), tv.column(b, 1)
            for lo, hi in tv.slices(texts):
                n, h1, h2, regs = sketch_texts(texts.slice(lo, hi - lo))
                keep = n > 0
                r = regs[keep]
                band = np.zeros((len(r), M // BAND), np.uint64)
                for j in range(BAND):
                    band = band * np.uint64(65537) + r[:, j::BAND].astype(np.uint64)
                band = tv.mix(band * np.uint64(M) + np.arange(M // BAND, dtype=np.uint64))
                flat = pa.array(band.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, M // BAND), pa.int32()), flat)
                regs_col = pa.array([x.tobytes() for x in r], pa.binary())
                yield pa.record_batch([ids.slice(lo, hi - lo).filter(pa.array(keep)), pa.array(h1[keep].view(np.int64)), pa.array(h2[keep].view(np.int64)), regs_col, lists], ["doc_id", "h1", "h2", "regs", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, regs binary, bands array<long>")


def _compare(regs: np.ndarray, card: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joint estimates of pairs; pairs too unlike in equal registers get 0 without the likelihood."""
    out = np.zeros(len(i))
    for lo in range(0, len(i), 1 << 16):
        a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        x, y = regs[a], regs[b]
        near = np.flatnonzero((x == y).sum(1) >= M * (THRESHOLD - 2 * MARGIN))
        if len(near):
            x, y = x[near], y[near]
            out[lo + near] = joint_estimate((x > y).sum(1), (x < y).sum(1), card[a[near]], card[b[near]])
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], 0)
    return np.flatnonzero(new)


def _block_pairs(t: pa.Table) -> pa.RecordBatch:
    """Likely pairs a < b of rows (key, p, q, side, label, doc_id, regs) sorted by (key, p, q).

    Rows of one key, p and q are compared if their labels differ and, where p
    and q do, their sides.
    """
    key, p, q, side, label, doc = (t.column(i).to_numpy() for i in range(6))
    regs = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint16).reshape(-1, M)
    card = cardinality(regs)
    first = _runs(key, p, q)
    size = np.diff(np.append(first, len(key)))
    ahead = np.repeat(first + size, size) - np.arange(len(key)) - 1  # partners after each row
    ends = np.cumsum(ahead)
    found, at = [], 0
    while at < len(key):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + (1 << 20), "right")))
        n = ahead[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        on = (label[i] != label[j]) & ((p[i] == q[i]) | (side[i] != side[j])) & (doc[i] != doc[j])
        i, j = i[on], j[on]
        on = _compare(regs, card, i, j) >= THRESHOLD - MARGIN
        found.append(np.stack([np.minimum(doc[i[on]], doc[j[on]]), np.maximum(doc[i[on]], doc[j[on]])], 1))
        at = stop
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _pairs_of_sorted(batches):
    """Likely pairs from sorted rows: blocks lie together, whatever the batches' limits."""
    held: list[pa.RecordBatch] = []
    for b in tv.batches(batches):
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        if t.num_rows < 20000:
            continue
        cut = int(_runs(*(t.column(i).to_numpy() for i in range(3)))[-1])
        if cut:
            yield _block_pairs(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield _block_pairs(pa.Table.from_batches(held))


def members(reps: DataFrame) -> DataFrame:
    """(key, doc_id, n, pivot): members of buckets of two or more; of buckets with the same members there is one.

    The pivot is the member with the most fellows in all its buckets, of equal ones the least.
    """
    bands = reps.select("doc_id", F.explode("bands").alias("key"))
    h = F.xxhash64("doc_id")
    buckets = bands.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(h).alias("s1"), F.sum(F.shiftright(h, 8)).alias("s2")).where("n > 1")
    once = buckets.groupBy("n", "s1", "s2").agg(F.min("key").alias("key")).select("key", "n")
    rows = materialize(bands.join(once, "key").select("key", "doc_id", "n"), "members")
    fellows = rows.join(rows.groupBy("doc_id").agg(F.sum("n").alias("fellows")), "doc_id")
    pivots = fellows.groupBy("key").agg((-F.max(F.struct("fellows", (-F.col("doc_id")).alias("least")))["least"]).alias("pivot"))
    return materialize(rows.join(pivots, "key"), "pivots")


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches may be of texts that reach the threshold."""
    regs = reps.select(F.col("doc_id"), "regs")
    both = pairs.join(regs.select(F.col("doc_id").alias("a"), F.col("regs").alias("x")), "a").join(regs.select(F.col("doc_id").alias("b"), F.col("regs").alias("y")), "b")

    def run(batches):
        for t in tv.batches(batches):
            n = t.num_rows
            regs = np.frombuffer(b"".join([*tv.column(t, 2).to_pylist(), *tv.column(t, 3).to_pylist()]), np.uint16).reshape(-1, M)
            keep = pa.array(_compare(regs, cardinality(regs), np.arange(n), np.arange(n, 2 * n)) >= THRESHOLD - MARGIN)
            yield pa.record_batch([tv.column(t, 0).filter(keep), tv.column(t, 1).filter(keep)], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def beyond_pivots(buckets: DataFrame, near: DataFrame, reps: DataFrame) -> DataFrame:
    """Likely pairs (a, b) of members that aren't both verified with their bucket's pivot; ``near`` has what is."""
    joined = near.select(F.col("a").alias("pivot"), F.col("b").alias("doc_id")).union(near.select(F.col("b"), F.col("a"))).withColumn("with", F.lit(True))
    rows = buckets.where("doc_id <> pivot and n > 2").join(joined, ["pivot", "doc_id"], "left").withColumn("with", F.coalesce("with", F.lit(False)))
    rows = materialize(rows.select("key", "doc_id", "with"), "sided")
    count = rows.groupBy("key").agg(F.count_if("with").alias("n_with"), F.count_if(~F.col("with")).alias("n_rest")).where("n_rest > 0 and n_with + n_rest > 1")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    rows = rows.join(count, "key").withColumns({"b_with": blocks("n_with"), "b_rest": blocks("n_rest")})
    block = F.pmod(F.xxhash64("doc_id"), F.when(F.col("with"), F.col("b_with")).otherwise(F.col("b_rest"))).cast("int")
    rows = rows.withColumn("block", block)
    # Meetings of a block of the rest with one of the pivot's group (q below 0), and with one of the rest.
    of_with = F.transform(F.sequence(F.lit(0), F.col("b_rest") - 1), lambda p: F.struct(p.alias("p"), (-1 - F.col("block")).alias("q")))
    of_rest = F.concat(
        F.when(F.col("n_with") > 0, F.transform(F.sequence(F.lit(0), F.col("b_with") - 1), lambda q: F.struct(F.col("block").alias("p"), (-1 - q).alias("q")))).otherwise(F.array().cast("array<struct<p: int, q: int>>")),
        F.transform(F.sequence(F.lit(0), F.col("b_rest") - 1), lambda o: F.struct(F.least("block", o).alias("p"), F.greatest("block", o).alias("q"))),
    )
    meet = rows.select("key", "doc_id", "with", "block", F.explode(F.when(F.col("with"), of_with).otherwise(of_rest)).alias("x"))
    side = F.when(F.col("with"), F.lit(-1)).otherwise(F.col("block"))
    label = F.when(F.col("with"), F.lit(-1).cast("long")).otherwise(F.xxhash64("doc_id"))
    meet = meet.select("key", "x.p", "x.q", side.alias("side"), label.alias("label"), "doc_id")
    meet = meet.join(reps.select("doc_id", "regs"), "doc_id").select("key", "p", "q", "side", "label", "doc_id", "regs")
    # A fixed number of tasks: comparing costs far more than the few bytes that AQE would size tasks by.
    tasks = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return meet.repartition(tasks, "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_pairs_of_sorted, "a long, b long").distinct()


def jaccard_of_texts(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Exact Jaccard similarity of the word 3-gram sets of paired texts."""
    sets = []
    for texts in (left, right):
        data, off = tv.buffer(texts, lower=True)
        start, end, tok = tv.words(data, off)
        sets.append(tv.shingles(tv.span_hash(data, start, end), tok, SHINGLE))
    out = np.zeros(len(left))
    for i in range(len(left)):
        x, y = (np.unique(g[off[i] : off[i + 1]]) for g, off in sets)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out[i] = both / max(1, len(x) + len(y) - both)
    return out


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose texts reach the threshold, with the exact similarity. Texts in no pair aren't moved."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    if ends.count() <= BROADCAST_IDS:  # else every text is shuffled for the two joins
        texts = texts.join(F.broadcast(ends), "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for t in tv.batches(batches):
            x, y = tv.column(t, 2), tv.column(t, 3)
            for lo, hi in tv.slices(x):
                sim = jaccard_of_texts(x.slice(lo, hi - lo), y.slice(lo, hi - lo))
                keep = pa.array(sim >= THRESHOLD)
                yield pa.record_batch([tv.column(t, 0).slice(lo, hi - lo).filter(keep), tv.column(t, 1).slice(lo, hi - lo).filter(keep), pa.array(sim).filter(keep)], ["a", "b", "jaccard"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, jaccard double")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, group_id) of every end of an edge; group_id is the least doc_id that it is connected to.

    Alternates large-star and small-star steps until nothing changes; each round
    is written to the shared folder.
    """
    e = materialize(edges.select(F.col("b").alias("x"), F.col("a").alias("y")).where("x <> y").distinct(), "edges")
    while True:
        # Large star: link larger neighbours to the least neighbour.
        both = e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m"))
        big = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        # Small star: link smaller neighbours and the node itself to the least neighbour.
        down = big.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct()
        low = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).union(low.select("x", F.col("m").alias("y"))).where("x <> y").distinct()
        new = materialize(small, "edges")
        # Done when a star step gives the same edges: as many, and none that is new.
        if new.count() == e.count() and new.join(e, ["x", "y"], "left_anti").isEmpty():
            break
        e = new
    return new.select(F.col("x").alias("doc_id"), F.col("y").alias("group_id")).union(new.select(F.col("y"), F.col("y")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, group_id, keep for every document in a group of two or more.

    group_id is the least doc_id of the group, and keep is true for that one
    alone. Texts compare by their lower-cased words: two texts of the same words
    in the same order are copies whatever their punctuation. Rows with a null
    doc_id or text, and texts without a word, are in no group. Rows that repeat
    a doc_id count as one document (of any of its texts that matches). Texts of
    any length are read entire; texts that just reach the threshold belong
    together. An empty table gives no row. Other columns are ignored, whatever
    their names.
    """
    sk = materialize(sketches(docs), "sketches")
    rep = sk.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    exact = sk.select("doc_id", "h1", "h2").join(rep.where("n > 1"), ["h1", "h2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    exact = materialize(exact.distinct(), "copies")
    reps = sk.join(exact.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_anti").dropDuplicates(["doc_id", "h1", "h2"])
    buckets = members(reps)
    star = buckets.where("doc_id <> pivot").select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct()
    near = materialize(verify(materialize(likely(star, reps), "pairs"), docs).select("a", "b").distinct(), "near")
    rest = verify(materialize(beyond_pivots(buckets, near, reps).join(near, ["a", "b"], "left_anti"), "pairs"), docs).select("a", "b")
    groups = components(exact.union(near).union(rest))
    return groups.select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` less all but the first document of each near-duplicate group, with all columns.

    Rows in no group stay, null and empty texts and null ids included. Rows that
    repeat the doc_id and text of a kept row are copies too: one stays. An empty
    table stays empty; columns may have any names.
    """
    gone = near_duplicates(docs).where("not keep").select(F.col("doc_id").alias("__gone"))
    rest = docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
    # Only ids that really repeat pay for being ranked.
    again = docs.groupBy(F.col("doc_id").alias("__again")).count().where("count > 1 and __again is not null").select("__again")
    twice = materialize(again, "repeated")
    if twice.isEmpty():
        return rest
    single = rest.join(twice, rest["doc_id"] == twice["__again"], "left_anti")
    many = rest.join(twice, rest["doc_id"] == twice["__again"], "left_semi")
    return single.unionByName(many.dropDuplicates(["doc_id", "text"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    text_batches(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
