import random
import re

import numpy as np

from treeloom.llm import decontam


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def edits(item, text):
    """Least edits of the item to any stretch of the text, cell by cell."""
    prev = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        cur = [i]
        for j, x in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (w != x)))
        prev = cur
    return min(prev)


def test_edit_fit():
    r = random.Random(1)
    for _ in range(200):
        item, text = [r.randrange(4) for _ in range(r.randrange(1, 8))], [r.randrange(4) for _ in range(r.randrange(0, 15))]
        cost, b, e = decontam.edit_fit(np.array(item, np.uint64), np.array(text, np.uint64))
        assert cost == edits(item, text) and 0 <= b <= e <= len(text)
        assert cost >= abs(len(item) - (e - b)) and edits(item, text[b:e]) == cost


def test_against_brute_force(spark, small, docs):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.contaminated(docs, items).collect()}
    its = [(r.item_id, words(r.text)) for r in items.collect()]
    want = {}
    for r in docs.select("doc_id", "text").collect():
        w = words(r.text)
        have = set(w)
        for i, it in its:
            most = int(decontam.MAX_EDITS * len(it))
            if sum(x not in have for x in it) <= most and (c := edits(it, w)) <= most:
                want[r.doc_id, i] = c
    assert want and got == want


def test_recall_of_edited_items(spark, small, docs):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    its = [(r.item_id, words(r.text)) for r in items.collect()]
    hosts = [r.text.split() for r in docs.where("length(text) < 3000").select("text").limit(100).collect()]
    r = random.Random(4)
    rows, planted = [], []
    for k in range(300):
        i, it = its[k % len(its)]
        e = list(it)
        for _ in range(int(decontam.MAX_EDITS * len(it))):
            p, op = r.randrange(len(e)), r.random()
            if op < 0.4:
                e[p] = f"zz{r.randrange(999)}"
            elif op < 0.7:
                e.insert(p, f"zq{r.randrange(999)}")
            elif len(e) > 1:
                del e[p]
        h = r.choice(hosts)
        at = r.randrange(len(h) + 1)
        rows.append((k, " ".join([*h[:at], *e, *h[at:]])))
        planted.append((k, i))
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert np.mean([p in got for p in planted]) >= 0.95


def test_odd_rows(spark, odd, empty, monkeypatch):
    from tests.llm.conftest import prose

    item = " ".join(prose(1, 300).split()[40:80])
    items = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (2, None, "x"), (None, item, "x"), (3, "", "x"), (4, "…", "x"), (5, prose(555, 30), "x")], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id or -1, r.item_id, r.edits) for r in decontam.contaminated(odd, items).where("item_id = 1").collect())
    assert got == [(-1, 1, 0), (1, 1, 0), (2, 1, 0), (2, 1, 0), (3, 1, 0)]
    kept = decontam.drop_contaminated(odd, items)
    assert kept.columns == odd.columns
    hit = {r.doc_id for r in decontam.contaminated(odd, items).collect()}
    assert sorted(str(r.doc_id) for r in kept.where("text is not null").collect()) == sorted(str(r.doc_id) for r in odd.where("text is not null").collect() if r.doc_id not in hit)
    assert kept.where("text is null").count() == 2
    assert decontam.contaminated(empty, items).count() == 0
    none = items.where("false")
    assert decontam.contaminated(odd, none).count() == 0 and decontam.drop_contaminated(odd, none).count() == odd.count()
    monkeypatch.setattr(decontam, "SHARD_WORDS", 5)
    again = sorted((r.doc_id or -1, r.item_id, r.edits) for r in decontam.contaminated(odd, items).where("item_id = 1").collect())
    assert again == got


def test_recall_by_length_and_place(spark):
    """All the edits that are allowed at the head, in the middle, at the tail, evenly spread or anywhere, for items of any length."""
    r = random.Random(8)
    lengths, places = (1, 4, 5, 9, 12, 15, 19, 27, 45, 59, 100, 300, 1000), ("head", "middle", "tail", "spread", "anywhere")
    items, rows, cell = [], [], []
    for n in lengths:
        for place in places:
            for _ in range(20 if n < 300 else 8):
                k, most = len(items), int(decontam.MAX_EDITS * n)
                it = [f"w{r.randrange(10**6)}" for _ in range(n)]
                e, zone = list(it), max(1, 2 * most)
                for j in range(most):
                    lo = {"head": 0, "middle": (len(e) - zone) // 2, "tail": len(e) - zone}.get(place, 0)
                    p = j * len(e) // most if place == "spread" else r.randrange(len(e)) if place == "anywhere" else lo + r.randrange(zone)
                    p, op = max(0, min(len(e) - 1, p)), r.random()
                    if op < 0.4:
                        e[p] = f"zz{r.randrange(999)}"
                    elif op < 0.7:
                        e.insert(p, f"zq{r.randrange(999)}")
                    else:
                        del e[p]
                pad = [[f"v{r.randrange(5000)}" for _ in range(r.randrange(40))] for _ in range(2)]
                items.append((k, " ".join(it)))
                rows.append((k, " ".join([*pad[0], *e, *pad[1]])))
                cell.append((n, place))
    found = {(x.doc_id, x.item_id) for x in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert np.mean([(k, k) in found for k in range(len(cell))]) >= 0.97
    for c in dict.fromkeys(cell):
        assert np.mean([(k, k) in found for k, x in enumerate(cell) if x == c]) >= 0.9, c
    assert all(a == b or len(items[b][1].split()) <= 5 for a, b in found)


def test_repetitions_follow_the_target():
    counts = [decontam.repetitions("long", t) for t in (0.5, 0.9, 0.97, 0.995)]
    assert counts == sorted(counts) and counts[0] < counts[-1]


def test_many_candidates_and_long_stretches():
    """A text that is one item over and over, and items that are nearly the same."""
    base = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(base[:k] + ["x"] + base[k + 1 :])) for k in range(30)]
    m = decontam.Matcher(decontam.item_index(items))
    import pyarrow as pa

    got = m.match(pa.array([" ".join(base * 400), "nothing", None, ""]))
    assert [(r, i, c) for r, i, c, _, _ in got] == [(0, k, 1) for k in range(30)]
