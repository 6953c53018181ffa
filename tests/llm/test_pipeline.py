"""Every stage against a brute-force version on its own input, and run() against the stages one by one."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from citeloom.llm import bpe, classifier, minhash, rules
from citeloom.llm.packing import CAPACITY
from tests.llm.test_packing import naive

WORDS = "the small garden behind our old house was full of apple trees and in autumn children came from every street to help with picking them before first frost while neighbours told long stories about winters past".split()
JUNK = "buy cheap pills online now click here free offer winner cash bonus casino deal".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 200)), "en") for i in range(160)]
    rows += [(200 + i, " ".join(rng.choice(JUNK + WORDS[:8]) for _ in range(100)), "en") for i in range(60)]
    rows += [(300 + i, "zq9 " * 150, "en") for i in range(4)] + [(310, None, "en"), (311, " ", None)]
    rows += [(400 + i, rows[i][1], "en") for i in range(20)] + [(500 + i, rows[i + 30][1] + " one more word", "en") for i in range(20)]
    at = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(d, t, g, "s", len(t or "")) for d, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 160, 2)] + [(200 + i, 0, 0) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def steps(spark, folder):
    """The input and the output of every stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        after = corpus_pipeline.staged(f(spark, docs, folder), name)
        out.append((docs.collect(), after.collect()))
        docs = after
    return out


def brute_measures(text):
    """The four measures of one text, token by token."""
    enc, (model, is_byte) = rules.byte_bpe(rules.TOKENIZERS), rules.piece_bpe(rules.TOKENIZERS)
    words = (text or "").split()
    tokens = [t for w in words for t in enc.encode_ordinary(" " + w)]
    pieces = [p for w in words for p in model.encode(w)]
    if not tokens:
        return None
    chars, counts = sum(len(w) + 1 for w in words), np.array(list({t: tokens.count(t) for t in tokens}.values()))
    p = counts / len(tokens)
    entropy = -(p * np.log2(p)).sum() / np.log2(len(tokens)) if len(tokens) > 1 else 1.0
    return chars / len(tokens), chars / len(pieces), sum(is_byte[i] for i in pieces) / len(pieces), entropy, len(tokens)


def quartile(values, q):
    return sorted(values)[max(0, int(np.ceil(q * len(values))) - 1)]


def test_quality_rules(steps):
    before, after = steps[0]
    measured = {r.doc_id: brute_measures(r.text) for r in before}
    known = [m for m in measured.values() if m]
    keep = set()
    for d, m in measured.items():
        if m is None:
            continue
        wide, fine = np.sqrt(1 + rules.SHORT / m[4]), True
        for k, name in enumerate(rules.MEASURES):
            a, b, c = (quartile([x[k] for x in known], q) for q in (0.25, 0.5, 0.75))
            slack = max(abs(b) * 0.015, 0.01)
            fine &= name == "byte_fallback_share" or not m[k] < b - max(b - a, slack) * rules.REACH * wide
            fine &= name == "token_entropy" or not m[k] > b + max(c - b, slack) * rules.REACH * wide
        keep |= {d} if fine else set()
    assert {r.doc_id for r in after} == keep and not keep & {300, 301, 310, 311} and len(keep) > 200


def brute_vectors(texts):
    """Context sums of every bucket, occurrence by occurrence."""
    place, sign = classifier.index_vectors()
    sums = defaultdict(lambda: np.zeros(classifier.DIM + 1))
    for t in texts:
        buckets, _ = classifier.bucketed(pa.array([t]))
        for i, w in enumerate(buckets):
            sums[w][-1] += 1
            for j in range(max(0, i - classifier.WINDOW), min(len(buckets), i + classifier.WINDOW + 1)):
                for k in range(2):
                    sums[w][place[buckets[j], k]] += sign[buckets[j], k]
    return sums


def test_word_vectors(spark, steps):
    texts = [r.text for r in steps[1][0]]
    got = classifier.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    sums = brute_vectors(texts)
    total = sum(s[-1] for s in sums.values())
    for w, s in sums.items():
        v = s[:-1] / max(np.linalg.norm(s[:-1]), 1e-9)
        assert np.allclose(got[w], [*v, 1e-3 / (1e-3 + s[-1] / total)], atol=1e-5)


def test_quality_classifier(steps):
    before, after = steps[1]
    kept = {r.doc_id for r in after}
    good, bad = [r.doc_id for r in before if r.doc_id < 160 or r.doc_id >= 400], [r.doc_id for r in before if 200 <= r.doc_id < 260]
    # Odd ones were never labelled.
    assert sum(d in kept for d in good if d % 2) >= 0.95 * sum(d % 2 for d in good)
    assert sum(d in kept for d in bad if d % 2) <= 0.1 * sum(d % 2 for d in bad) and len(bad) > 30


def test_exact_dedup(steps):
    before, after = steps[2]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    assert {r.doc_id for r in after} == set(first.values()) and len(after) < len(before)


def test_near_dedup(steps):
    before, after = steps[3]
    sig, _ = minhash.signatures(pa.array([r.text for r in before]))
    ids, root = [r.doc_id for r in before], {r.doc_id: r.doc_id for r in before}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(ids)):
        for j in np.flatnonzero((sig == sig[i]).mean(1) >= minhash.THRESHOLD):
            a, b = sorted((find(ids[i]), find(ids[j])))
            root[b] = a
    assert {r.doc_id for r in after} == {d for d in ids if find(d) == d} and not any(r.doc_id >= 500 for r in after)


def test_best_fit_packing(steps):
    before, after = steps[4]
    enc, pieces = rules.byte_bpe(rules.TOKENIZERS), []
    for r in before:
        n = len(enc.encode_ordinary(r.text))
        pieces += [CAPACITY] * (n // CAPACITY) + ([n % CAPACITY] if n % CAPACITY else [])
    bins = defaultdict(list)
    for r in after:
        bins[r.bin].append(r.length)
    assert sorted(map(sorted, bins.values())) == sorted(map(sorted, naive(pieces, CAPACITY)))


def test_run_is_the_stages_in_turn(spark, folder, steps):
    assert sorted(corpus_pipeline.run(spark, folder).collect()) == sorted(steps[-1][1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "exact_dedup", "near_dedup", "best_fit_packing"]
    assert bpe.TOKENIZERS == rules.TOKENIZERS
