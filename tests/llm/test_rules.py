import random

from citeloom.llm.common import table
from citeloom.llm.rules import quality_rules

SF = "/root/testdata/sf0.01"
WORDS = "the small garden behind our old house was full of apple trees and in autumn children came from every street to help with picking them before first frost".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_labelled_junk(spark):
    """Of 58 labelled bad documents and 341 good ones."""
    truth = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    got = {r.doc_id: r.keep for r in quality_rules(table(spark, SF, "documents")).filter("tokens > 0").collect()}
    bad = [d for d, q in truth.items() if q == 0 and d in got]
    good = [d for d, q in truth.items() if q == 1 and d in got]
    assert sum(not got[d] for d in bad) >= 0.8 * len(bad)
    assert sum(not got[d] for d in good) <= 0.02 * len(good)


def test_a_language_of_few_documents_is_judged_by_its_script(docs_of):
    rng = random.Random(3)
    rows = [(i, prose(rng, 120), "en") for i in range(60)] + [(100, prose(rng, 120), "xx"), (101, "qzxj vwkq " * 60, "xx"), (103, prose(rng, 120), None)]
    got = {r.doc_id: r for r in quality_rules(docs_of(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100].keep and got[100].band == "latin" and not got[101].keep
    assert got[103].keep and all(got[i].band == "en" for i in range(60))


def test_few_documents_in_all_are_still_judged(docs_of):
    rng = random.Random(4)
    rows = [(i, prose(rng, 120), "en") for i in range(10)] + [(50, "spam " * 200, "en")]
    got = {r.doc_id: r for r in quality_rules(docs_of(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[50].keep and all(got[i].keep and got[i].band == "all" for i in range(10))
