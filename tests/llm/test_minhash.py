import random
import re

import numpy as np
import pyarrow as pa

from citeloom.llm.minhash import PERMUTATIONS, components, connected, near_dedup, near_groups, signatures


def documents():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(900)]
    rows, n = [], 0
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        rows.append((n, " ".join(base)))
        n += 1
        for _ in range(rng.choice([0, 0, 0, 1, 3])):
            rows.append((n, " ".join(rng.choice(vocab) if rng.random() < rng.choice([0.01, 0.04]) else w for w in base).title()))
            n += 1
    hot = [rng.choice(vocab) for _ in range(150)]
    for _ in range(150):  # one node that branching cannot make small
        rows.append((n, " ".join(rng.choice(vocab) if rng.random() < 0.02 else w for w in hot)))
        n += 1
    return rows


def trigrams(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def test_recall_and_precision_against_all_pairs(docs_of):
    rows = documents()
    sets = [trigrams(t) for _, t in rows]
    got = {r.doc_id: r.group_id for r in near_groups(docs_of(rows), small=16).collect()}
    pairs = hits = 0
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            sim = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if sim >= 0.5:
                pairs += 1
                hits += got.get(i, -1) == got.get(j, -2)
            if sim >= 0.3:
                parent[root(i)] = root(j)
    assert pairs > 5000 and hits >= 0.95 * pairs
    assert all(root(d) == root(g) for d, g in got.items())  # clean documents are left alone
    kept = {r.doc_id for r in near_dedup(docs_of(rows), small=16).collect()}
    assert kept == {d for d, _ in rows if got.get(d, d) == d}


def test_defined_cases(docs_of, spark):
    rows = [(1, None), (2, ""), (3, " . "), (4, "Hi"), (5, "hi!"), (6, "hi"), (6, "hi"), (None, "hi"), (7, "two words"), (8, "x y z " * 4000), (9, "x y z " * 4001)]
    got = {r.doc_id: (r.group_id, r.group_size) for r in near_groups(docs_of(rows)).collect()}
    assert got == {4: (4, 3), 5: (4, 3), 6: (4, 3), 8: (8, 2), 9: (8, 2)}
    df = docs_of(rows)
    kept = near_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, None, 7, 8], key=str)
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert near_dedup(spark.createDataFrame([], "text string, doc_id long, node int")).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 102), (101, 102)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


def test_connected_searches_past_reached_members():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, PERMUTATIONS).astype(np.uint16)
    chain = [base.copy()]
    for _ in range(9):  # each is near the next only
        nxt = chain[-1].copy()
        nxt[rng.choice(PERMUTATIONS, 50, replace=False)] = rng.integers(0, 1 << 16, 50)
        chain.append(nxt)
    a, b = connected(np.arange(10), np.stack(chain), 0.5)
    assert len(a) == 9 and set(a) | set(b) == set(range(10))


def test_signature_estimates_the_similarity():
    sig, has = signatures(pa.array(["a b c d e f g h i j", None, "a b c d e f g h i x"]))
    assert has.tolist() == [0, 2]
    assert abs((sig[0] == sig[1]).mean() - 7 / 9) < 0.15
