import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from treeloom.llm import neardup

from .conftest import prose


def shingle_set(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute_groups(rows):
    """Components of pairs of exact Jaccard similarity of the threshold or more."""
    sets = {i: shingle_set(t) for i, t in rows if i is not None and t}
    sets = {i: s for i, s in sets.items() if s}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    inv = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inv[g].append(i)
    pairs = {p for l in inv.values() for p in combinations(sorted(l), 2)}
    for a, b in pairs:
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= neardup.THRESHOLD:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    out = defaultdict(set)
    for i in sets:
        out[root(i)].add(i)
    return {min(v): v for v in out.values() if len(v) > 1}


def groups_of(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.group_id].add(r.doc_id)
        assert r.keep == (r.doc_id == r.group_id)
    return dict(out)


def test_against_brute_force(docs):
    got, want = groups_of(neardup.near_duplicates(docs)), brute_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    mine = {p for v in got.values() for p in combinations(sorted(v), 2)}
    true = {p for v in want.values() for p in combinations(sorted(v), 2)}
    assert len(mine & true) >= 0.95 * len(true) and mine <= true


def test_recall_of_edited_copies(spark):
    import random

    r = random.Random(5)
    rows, copies = [], 0
    for k in range(150):
        w = prose(1000 + k, 200).split()
        rows.append((2 * k, " ".join(w)))
        e = list(w)
        for _ in range(r.choice([2, 6, 12, 20])):
            e[r.randrange(len(e))] = f"zq{r.randrange(10**6)}"
        rows.append((2 * k + 1, " ".join(e)))
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        copies += len(a & b) / len(a | b) >= neardup.THRESHOLD
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = groups_of(neardup.near_duplicates(df))
    assert len(got) >= 0.97 * copies and set(got) <= set(brute_groups(rows))


def test_sketches_merge_and_estimate():
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 3000), (1000, 4000), (0, 4000))]
    _, _, _, regs = neardup.sketch_texts(pa.array(texts))
    inner = neardup.merge(regs[0], regs[1])
    assert (inner <= regs[2]).all() and (inner == regs[2]).mean() > 0.98
    card = neardup.cardinality(regs)
    assert np.allclose(card, [2998, 2998, 3998], rtol=0.4)
    est = neardup.joint_estimate(np.array([(regs[0] > regs[1]).sum()]), np.array([(regs[0] < regs[1]).sum()]), card[:1], card[1:2])
    assert abs(est[0] - 0.5) < 0.17


def test_joint_estimate_is_the_maximum():
    rng = np.random.default_rng(3)
    log_b, step = np.log(neardup.BASE), (neardup.BASE - 1) / neardup.BASE
    for _ in range(300):
        more, less = rng.integers(0, neardup.M // 2, 2)
        n_u, n_v = rng.uniform(50, 200, 2)
        u, v, equal = n_u / (n_u + n_v), n_v / (n_u + n_v), neardup.M - more - less
        j = np.linspace(1e-6, min(u / v, v / u) - 1e-6, 20001)
        p, q = (-np.log1p(-x * step) / log_b for x in (u - v * j, v - u * j))
        best = j[np.argmax(more * np.log(p) + less * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-300)))]
        got = neardup.joint_estimate(np.array([more]), np.array([less]), np.array([n_u]), np.array([n_v]))[0]
        assert abs(got - best) < 2e-3


def test_hot_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    w = prose(77, 150).split()
    rows = [(i, " ".join([*w[: i % 7 + 1], f"x{i}", *w[i % 7 + 1 :]])) for i in range(100)]
    got = groups_of(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == {0: set(range(100))}


def test_blocks_lose_no_pair(spark, monkeypatch):
    """Buckets whose pivot is like few of the members, cut into blocks or not, against brute force."""
    import random

    r, rows = random.Random(9), []
    for g in range(12):
        base = prose(g, 120).split()
        for k in range(25):  # texts of a family share a part, so that bands collide; some are near copies, some aren't
            own = prose(100 * g + k // 3 + 5000, 130).split()
            w = base[: r.choice([40, 60, 90, 120])] + own[: r.choice([0, 30, 60, 130])]
            w[r.randrange(len(w))] = f"zq{k}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist()
    whole = groups_of(neardup.near_duplicates(df))
    monkeypatch.setattr(neardup, "BLOCK", 3)
    assert groups_of(neardup.near_duplicates(df)) == whole
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    assert groups_of(neardup.near_duplicates(df)) == whole
    want = brute_groups(rows)
    mine = {p for v in whole.values() for p in combinations(sorted(v), 2)}
    true = {p for v in want.values() for p in combinations(sorted(v), 2)}
    assert len(true) > 300 and len(mine & true) >= 0.95 * len(true) and mine <= true


def test_pairs_beyond_pivots_are_all_compared(spark):
    """Every pair of a bucket is either with the pivot, both verified with it, or compared."""
    texts = [prose(3, 100)] * 1 + [prose(3, 100) + f" tail{k} x{k} y{k}" for k in range(30)] + [prose(50 + k // 2, 100) for k in range(20)]
    _, _, _, regs = neardup.sketch_texts(pa.array(texts))
    reps = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(regs)], "doc_id long, regs binary")
    buckets = spark.createDataFrame([(7, i, len(texts), 0) for i in range(len(texts))], "key long, doc_id long, n long, pivot long")
    near = spark.createDataFrame([(0, k) for k in range(1, 31)], "a long, b long")
    got = {(r.a, r.b) for r in neardup.beyond_pivots(buckets, near, reps).collect()}
    assert got == {(31 + 2 * k, 32 + 2 * k) for k in range(10)}


def test_bucket_of_fifty_thousand(spark):
    """One template in 50,000 variants: comparisons are with the pivot alone, in well under a minute or two."""
    import time

    w = prose(77, 60).split()
    rows = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.lit(x) for x in w), F.concat(F.lit("x"), "id")).alias("text"))
    began = time.time()
    got = neardup.near_duplicates(rows)
    assert got.where("group_id = 0").count() == 50_000 and got.where("keep").count() == 1
    assert time.time() - began < 240


def test_odd_rows(odd, empty):
    got = groups_of(neardup.near_duplicates(odd))
    assert got == {1: {1, 2, 3}, 9: {9, 12}}
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(map(str, [1, 4, 5, 6, None, None, 7, 8, 9, 10, 11]))
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)]
    got = {r.doc_id: r.group_id for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (100, 101, 102)} == {100}
