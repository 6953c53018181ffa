import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm.counts import squeeze, unsqueeze
from citeloom.llm.lm import DISCOUNT, EliasFano, lm_scores, train


@given(st.lists(st.integers(0, 1 << 40), max_size=60))
def test_runs_round_trip(values):
    a, b = np.sort(np.array(values, np.uint64)), np.arange(len(values), dtype=np.uint32)
    got = unsqueeze(squeeze(a, b))
    assert (got[0] == a).all() and (got[1] == b).all()


@settings(deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=80), st.integers(0, 3100), st.data())
def test_elias_fano_access_and_successor(values, x, data):
    v = np.sort(np.array(values, np.uint64))
    arrays, (n, low) = EliasFano.encode(v, "v")
    ef = EliasFano(arrays, "v", n, low)
    assert (ef.access(np.arange(n)) == v).all()
    start = data.draw(st.integers(0, n))
    end = data.draw(st.integers(start, n))
    got = ef.successor(np.array([x], np.uint64), np.array([start]), np.array([end]))[0]
    assert got == next((i for i in range(start, end) if v[i] >= x), end)


def brute(texts, least):
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    known = {w for w, n in Counter(w for t in words for w in t).items() if n >= least}
    words = [[w if w in known else None for w in t] for t in words]
    c1 = Counter(w for t in words for w in t)
    c2 = Counter(x for t in words for x in zip(t, t[1:]))
    c3 = Counter(x for t in words for x in zip(t, t[1:], t[2:]))
    c2 = {k: n for k, n in c2.items() if n >= 2}
    c3 = {k: n for k, n in c3.items() if n >= 2 and k[:2] in c2}
    total, size = sum(c1.values()), len(known) + 1
    left1, left2 = Counter(), Counter()
    for k, n in c2.items():
        left1[k[0]] += (n - DISCOUNT) / c1[k[0]]
    for k, n in c3.items():
        left2[k[:2]] += (n - DISCOUNT) / c2[k[:2]]

    def p(t, i):
        out = (c1[t[i]] + DISCOUNT) / (total + DISCOUNT * size)
        if i:
            out = max(0, c2.get((t[i - 1], t[i]), 0) - DISCOUNT) / c1[t[i - 1]] + (1 - left1[t[i - 1]]) * out
        if i > 1:
            h = (t[i - 2], t[i - 1])
            out = max(0, c3.get((*h, t[i]), 0) - DISCOUNT) / c2.get(h, 1) + (1 - left2[h]) * out
        return out

    return [sum(math.log(p(t, i)) for i in range(len(t))) for t in words]


def test_scores_equal_brute_force(docs_of):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.6, rng.integers(1, 60)) if x < 40) or "w1" for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " ... "), (None, texts[3]), (3, texts[3])]
    for shard_bytes in (1 << 20, 2000):
        got = lm_scores(docs_of(rows), 3, shard_bytes).collect()
        want = brute([t or "" for _, t in rows], 3)
        by = sorted(((d, w) for (d, _), w in zip(rows, want)), key=str)
        assert len(got) == len(rows)
        for r, (d, w) in zip(sorted(got, key=lambda r: str((r.doc_id, r.log_probability))), sorted(by, key=str)):
            assert r.doc_id == d
        for d, w in by:
            mine = [r for r in got if r.doc_id == d]
            assert any(abs(r.log_probability - w) < 0.02 * max(1, abs(w)) for r in mine)
        assert all((r.perplexity is None) == (r.words == 0) for r in got)


def test_probabilities_sum_to_one(docs_of):
    rows = [(i, "a b c a b d a b c b c") for i in range(4)]
    model = train(docs_of(rows), 1)
    from citeloom.llm.counts import word_ids

    for context in ("a b", "b c", "d a"):
        total = 0
        for w in ("a", "b", "c", "d", "zzz"):
            ids, counts = word_ids(pa.array([f"{context} {w}"]), model.vocab)
            total += math.exp(model.log_probabilities(ids, counts)[-1])
        assert total == pytest.approx(1, abs=1e-4)


def test_empty_table(docs_of, spark):
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
