import os
import random

from citeloom.llm.common import table
from citeloom.llm.toxicity import toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def scores(spark, docs_of, rows, labels):
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    return {r.doc_id: r for r in toxicity(docs_of(rows), known).collect()}


def test_a_few_labels_give_seeds(spark, docs_of):
    rows = [(1, "you utter oaf"), (2, "what an oaf he is"), (3, "a fine day in may"), (4, "he is in the garden"), (5, "the day is fine"), (6, "that oaf again"), (7, None)]
    got = scores(spark, docs_of, rows, [(1, 1, 0), (2, 1, 0), (3, 0, 1), (4, 0, 1), (5, 0, 1)])
    assert {d for d, r in got.items() if r.toxic} == {1, 2, 6}
    assert got[7].score == 0 and got[4].score == 0


def test_walks_reach_a_common_word_that_is_no_seed(spark, docs_of):
    rng = random.Random(5)
    clean = [f"word{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(clean) for _ in range(n))
    rows = [(i, f"{say(6)} {rng.choice(['oaf', 'lout'])} {say(6)}" if i < 30 else say(13)) for i in range(200)]
    labels = [(i, int(i < 30), 1) for i in range(200)]
    # Of no labelled document, but always beside the seeds; 'boor' is over 1 % of all words.
    rows += [(1000 + i, f"{say(4)} oaf boor lout {say(4)}") for i in range(100)] + [(2000, "boor"), (2001, "word1 word2")]
    got = scores(spark, docs_of, rows, labels)
    assert got[2000].score > 0.3 and got[2001].score == 0
    assert all(got[i].toxic for i in range(30)) and not any(got[i].toxic for i in range(30, 200))


def test_labelled_documents_of_the_small_tables(spark):
    labels = table(spark, SF, "labels")
    found = {r.doc_id for r in toxicity(table(spark, SF, "documents"), labels).filter("toxic").collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    hit = sum(truth.get(d, 0) for d in found)
    assert hit >= sum(truth.values()) / 2 and not any(truth.get(d) == 0 for d in found)


def test_no_contrast_no_scores(spark, docs_of):
    rows = [(1, "you oaf"), (2, "oaf"), (3, None)]
    for toxic in (0, 1):
        got = scores(spark, docs_of, rows, [(1, toxic, 0), (2, toxic, 0)])
        assert all(r.score == 0 and not r.toxic for r in got.values()) and len(got) == 3


def test_graph_and_walks_equal_brute_force(spark, docs_of):
    """All words of a small corpus, in stripes that hold few of them each."""
    import numpy as np

    from citeloom.llm.common import hashed
    from citeloom.llm.toxicity import RESTART, STEPS, WINDOW, lexicon

    rng = random.Random(9)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.15)), 40)}" for _ in range(rng.randint(3, 25))) for _ in range(120)]
    words = sorted({w for t in texts for w in t.split()})
    at = {w: i for i, w in enumerate(words)}
    pairs, count = np.zeros((len(words),) * 2), np.zeros(len(words))
    for t in (t.split() for t in texts):
        for i, w in enumerate(t):
            count[at[w]] += 1
            for k in range(1, WINDOW + 1):
                if i + k < len(t) and t[i + k] != w:
                    pairs[at[w], at[t[i + k]]] += 1
                    pairs[at[t[i + k]], at[w]] += 1
    with np.errstate(divide="ignore"):
        graph = np.where(pairs >= 2, np.maximum(0, np.log(pairs * count.sum() / (2 * WINDOW * np.outer(count, count)))), 0)
    bad, good = ["w3", "w7", "w20"], ["w0", "w1"]
    mass = {}
    for name, side in (("bad", bad), ("good", good)):
        start = np.zeros(len(words))
        start[[at[w] for w in side]] = 1 / len(side)
        x = start
        for _ in range(STEPS):
            x = (1 - RESTART) * graph @ (x / np.maximum(graph.sum(0), 1e-9)) + RESTART * start
        mass[name] = x * len(side) / RESTART
    want = np.clip((mass["bad"] - mass["good"]) / (mass["bad"] + mass["good"] + 1), 0, 0.999)
    for block_bytes in (1 << 20, 300):
        grid = lexicon(docs_of(list(enumerate(texts))).select("text"), hashed(bad), hashed(good), block_bytes)
        codes, known = grid.codes(hashed([*words, "unseen"]))
        assert known.tolist() == [True] * len(words) + [False] and grid.stripes == (1 if block_bytes > 300 else 4)
        assert np.allclose(grid.values(f"step{STEPS}", "weight", codes[:-1]), want, atol=1e-4)
    assert (want > 0.05).sum() > len(bad)
