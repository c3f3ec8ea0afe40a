import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.llm import packing


def best_fit(lengths, capacity):
    """Best-fit decreasing, document by document."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            r = min(fit)
            rooms.remove(r)
            rooms.append(r - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def unfold(slots, bins, capacity):
    used = defaultdict(list)
    for length, first, n, bin_, per, off in slots:
        for k in range(n):
            used[bin_ + k // per].append((off + k % per * length, length))
    assert set(used) == set(range(bins))
    for v in used.values():
        v.sort()
        at = 0
        for o, n in v:
            assert o == at
            at += n
        assert at <= capacity
    return sorted(capacity - sum(n for _, n in v) for v in used.values())


@given(st.lists(st.integers(1, 30), max_size=200), st.integers(30, 40))
@settings(max_examples=300, deadline=None)
def test_plan_is_best_fit_decreasing(lengths, capacity):
    slots, bins = packing.plan(Counter(lengths), capacity)
    assert unfold(slots, bins, capacity) == best_fit(lengths, capacity)
    ranks = defaultdict(list)
    for length, first, n, *_ in slots:
        ranks[length].append((first, n))
    for length, runs in ranks.items():
        at = 0
        for first, n in sorted(runs):
            assert first == at
            at += n
        assert at == Counter(lengths)[length]


def test_large_counts():
    r = random.Random(1)
    counts = {n: r.randrange(10**7) for n in range(1, 2049)}
    slots, bins = packing.plan(counts, 2048)
    total = sum(k * v for k, v in counts.items())
    assert sum(s[2] for s in slots) == sum(counts.values()) and bins <= 1.01 * total / 2048 + 1 and len(slots) < 20_000


def check(df, lengths, capacity):
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in df.collect():
        got[r.doc_id].append((r.piece, r.first_token, r.n_tokens))
        bins[r.bin_id].append((r.bin_offset, r.n_tokens))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    assert set(bins) == set(range(len(bins)))
    return got, bins


def test_documents(docs):
    cap = 500
    lengths = {r.doc_id: len(r.text.split()) for r in docs.select("doc_id", "text").collect()}
    got, bins = check(packing.pack(docs, cap), lengths, cap)
    assert len(bins) == len(best_fit([n % cap for n in lengths.values() if n % cap], cap)) + sum(n // cap for n in lengths.values())
    for i, n in lengths.items():
        at = 0
        for k, (piece, first, m) in enumerate(sorted(got[i])):
            assert (piece, first) == (k, at)
            at += m
        assert at == n


def test_odd_rows(odd, empty):
    got, _ = check(packing.pack(odd, 64), None, 64)
    assert sum(m for _, _, m in got[7]) == 200_000 and sum(m for _, _, m in got[2]) == 600
    assert set(got) == {1, 2, 3, 7, 8, 9, 10, 11, 12}
    assert packing.pack(empty).count() == 0
