import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm.packing import best_two_fit, pack


def naive(lengths, capacity):
    left, bins = sorted(lengths), []
    while left:
        held, gap = [], capacity
        while fits := [x for x in left if x <= gap]:
            left.remove(fits[-1])
            held.append(fits[-1])
            gap -= fits[-1]
        if gap and len(held) > 1:
            small, room = held[-1], gap + held[-1]
            pairs = [(left[i] + left[j], -left[min(i, j)]) for i in range(len(left)) for j in range(i) if left[i] + left[j] <= room]
            best = max((p[0] for p in pairs), default=0)
            if best > small:
                a = min(left[i] for i in range(len(left)) for j in range(len(left)) if i != j and left[i] + left[j] == best)
                held.pop()
                left.remove(a)
                left.remove(best - a)
                left.append(small)
                left.sort()
                held += [a, best - a]
        bins.append(held)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_bins_equal_the_naive_packing(lengths):
    got = best_two_fit(np.array(lengths, dtype=np.int64), 30) if lengths else []
    assert [sorted(b) for b in got] == [sorted(b) for b in naive(lengths, 30)]
    assert Counter(x for b in got for x in b) == Counter(lengths)
    assert all(sum(b) <= 30 for b in got)


def test_pack_places_every_piece_once(docs_of):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(1, 900)) for i in range(400)] + [(500, None), (501, ""), (None, "abc"), (None, "abcd"), (7, "again"), (502, "é" * 5000)]
    for shard_pieces in (1 << 15, 50):
        got = pack(docs_of(rows), capacity=64, bytes_per_token=4, shard_pieces=shard_pieces).collect()
        want = defaultdict(int)
        for d, t in rows:
            want[d] += -(-len((t or "").encode()) // 4)
        have, bins = defaultdict(int), defaultdict(list)
        for r in got:
            have[r.doc_id] += r.length
            bins[r.bin].append(r)
        assert have == {d: n for d, n in want.items() if n}
        assert len({(r.doc_id, r.copy, r.piece) for r in got}) == len(got)
        for members in bins.values():
            at = 0
            for r in sorted(members, key=lambda r: r.slot):
                assert r.start == at
                at += r.length
            assert at <= 64


def test_nothing_to_pack(docs_of, spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pack(docs_of([(1, None), (2, "")])).count() == 0


def test_lengths_are_tokens_and_hot_ids_are_dealt(docs_of):
    from citeloom.llm.bpe import token_counts

    rng = random.Random(2)
    rows = [(None if i % 3 == 0 else i, " ".join(rng.choice(["one", "forty", "unbelievable", "x9"]) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    docs = docs_of(rows)
    want = defaultdict(int)
    for r in token_counts(docs).collect():
        want[r.doc_id] += r.n_tokens
    got = pack(docs, capacity=64, shard_pieces=20).collect()
    have = defaultdict(int)
    for r in got:
        have[r.doc_id] += r.length
    assert have == want and len({(r.doc_id, r.copy, r.piece) for r in got}) == len(got)
    assert len({r.bin >> 32 for r in got if r.doc_id is None}) > 3
