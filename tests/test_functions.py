"""Passages, search, extraction, records and streams on small cases."""

import hashlib
import random
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from citeloom.functions import fuzzy, links, model, relation, strain, text
from citeloom.operators import extract, match, store, verify
from citeloom.sources import citations
from citeloom.streaming.drift import drift_stream


def brute_fingerprint(exact, before, after):
    def norm(s):
        s = unicodedata.normalize("NFC", s)
        for c in "\t\n\r":
            s = s.replace(c, " ")
        while "  " in s:
            s = s.replace("  ", " ")
        return s.strip()

    side = lambda s: norm(s)[:50].ljust(50)
    return "sha256:" + hashlib.sha256(f"{side(before)}|{norm(exact)}|{side(after)}".encode()).hexdigest()


CASES = [("plain words", "a b", "c"), ("", "", ""), ("  été\t\n x ", "", "y" * 80), ("Å|한", " edge ", "中文"), ("\U0001f600 emoji", "x" * 49, "x" * 51)]


def test_fingerprint_against_brute_force(spark):
    df = spark.createDataFrame(CASES, "exact string, before string, after string")
    got = df.select(text.fingerprint("exact", "before", "after")).collect()
    assert [r[0] for r in got] == [brute_fingerprint(*c) for c in CASES]


def test_fuzzy_prefers_the_first_of_equal_places():
    source = "one two three four five six seven. " * 2
    target = "one two threa four five six seven."
    start, end, ratio = fuzzy.search(source, target)
    assert start == 0 and ratio == SequenceMatcher(None, target, source[start:end]).ratio() >= 0.85
    assert fuzzy.search(source, "two words") is None and fuzzy.search("", target) is None
    assert fuzzy.search("nothing of the kind is here at all", target) is None


def test_locate_goes_from_exact_to_fuzzy(spark):
    rows = [(1, "He said the cat sat on the mat today.", "the cat  sat"), (2, "He said THE CAT SAT on it.", "the cat sat"), (3, "He said the cat sat on the matt today, they say.", "the cat sat on the mat today"), (4, "Other words here.", "the cat sat on it"), (5, None, "x"), (6, "x", " ")]
    df = match.locate(spark.createDataFrame(rows, "id int, s string, p string"), "s", "p")
    got = {r.id: (r.match_type, r.norm_char_start) for r in df.collect()}
    assert got == {1: ("exact", 8), 2: ("normalized", 8), 3: ("fuzzy", got[3][1]), 4: (None, None), 5: (None, None), 6: ("exact", 0)}


def test_statuses(spark):
    fp = brute_fingerprint("the cat sat", "He said ", " down.")
    base = dict(text_exact="the cat sat", text_before="He said ", text_after=" down.", hash=fp, doi=None, url="http://a", archive_url=None, fragment_url=None, captured_by="model", source_text="He said the cat sat down.", fetch_error=None)
    cases = {"verified": {}, "insufficient_metadata": {"url": ""}, "source_unavailable": {"fetch_error": "404"}, "passage_not_found": {"source_text": "no"}, "passage_verified": {"source_text": "They said the cat sat still."}, "hash_mismatch": {"hash": "sha256:0"}}
    rows = [(k, *(base | v).values()) for k, v in cases.items()]
    df = spark.createDataFrame(rows, "want string, text_exact string, text_before string, text_after string, hash string, doi string, url string, archive_url string, fragment_url string, captured_by string, source_text string, fetch_error string")
    for r in verify.verify(df).collect():
        assert r.status == r.want and "model-captured without an archived copy" in r.warnings
    assert not verify.all_good(verify.verify(df)).first()[0]


def test_first_source(spark):
    c = spark.createDataFrame([("a", ["u1", "u2", "u3"]), ("b", ["u1"])], "citation_id string, urls array<string>")
    f = spark.createDataFrame([("u1", None, "404"), ("u2", "two", None), ("u3", "three", None)], "url string, text string, error string")
    got = {r.citation_id: (r.source_url, r.source_text, r.fetch_error) for r in verify.with_first_source(c, f).collect()}
    assert got == {"a": ("u2", "two", None), "b": (None, None, "u1: 404")}


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert strain._lcs(a, b) == brute_lcs(a, b)


def test_relations_and_levels(spark):
    texts = {"It is defined as x": "defines", "They refute it": "contradicts", "Ten percent": "quantifies", "A risk": "cautions", "The model": "method", "Its history": "contextualizes", "Plain": "supports"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", relation.infer_relation("t")).collect()
    assert {r[0]: r[1] for r in got} == texts


def test_fragment_links(spark):
    rows = [("https://a.b/c#x", "Deep learning models generalise surprisingly well after long training", "", ""), ("ftp://a", "Deep learning models", "", ""), ("http://a", "it is the", "", ""), ("http://a", "Deep learning models", "some words stand before", "after words come here")]
    got = spark.createDataFrame(rows, "u string, e string, b string, a string").select(links.text_fragment_url("u", "e", "b", "a")).collect()
    assert [r[0] for r in got] == ["https://a.b/c#x:~:text=Deep%20learning%20models,after%20long%20training", None, None, "http://a#:~:text=words%20stand%20before-,Deep%20learning%20models,-after%20words%20come"]


HTML = """<p>As they put it, "a passage that is long enough" (Smith &amp; Jones, 2019). Others disagree
with this claim (Lee, 2001; Park et al., 2010). See Brown (2015; 2016) on that.</p><script>"never seen by anyone here"</script>"""


def test_html_extraction():
    got = [(q[0], q[3]) for q in extract.from_html(HTML)]
    claim = "Others disagree with this claim (Lee, 2001; Park et al., 2010)."
    assert ("a passage that is long enough", "Smith & Jones, 2019") in got
    assert [g for g in got if g[0] == claim] == [(claim, "Lee, 2001"), (claim, "Park et al., 2010")]
    assert [g[1] for g in got if g[0].startswith("See")] == ["Brown, 2015", "Brown, 2016"]
    assert not any("never seen" in g[0] for g in got)


def test_markdown_and_latex_extraction():
    got = extract.from_markdown('Text "short" and\n> a quoted block of\n> two whole lines\n\nand “curly quotes around this text” (Doe, 1999).')
    assert [q[0] for q in got] == ["a quoted block of two whole lines", "curly quotes around this text"] and got[1][3] == "Doe, 1999"
    tex = r"He \emph{said} ``that this is a \textbf{long} quotation'' \citep[p.~3]{doe1999}. % ``a comment that nobody ever reads''" + "\n" + r"\enquote{a nested {brace} stays within the text}"
    assert [(q[0], q[3]) for q in extract.from_latex(tex)] == [("that this is a long quotation", "doe1999"), ("a nested brace stays within the text", "doe1999")]


def test_extraction_of_nulls_and_records(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "doc_id long, body string")
    quotes = extract.extract(df, "body", "html")
    built = model.build_citations(quotes).cache()
    assert {r.doc_id for r in built.collect()} == {1} and built.first().id == "cite-001"
    assert built.filter(~model.internal_valid()).isEmpty()
    good, bad = model.split_valid(built)
    assert bad.isEmpty() and good.count() == built.count()
    page = built.select(F.concat(F.lit('<script type="application/ld+json">['), model.citation_jsonld("http://x", "Cite"), F.lit("]</script>")).alias("h"))
    back = citations.from_html(page, "h", "Cite")
    assert sorted(r.target.hash for r in back.collect()) == sorted(r.target.hash for r in built.collect())


def test_drift_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"u{rng.randint(0, 3)}", i, i, rng.choice("abc"), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "url string, t long, seq long, content_hash string, content_length long").withColumn("ts", F.timestamp_seconds("t"))
    for k in range(3):
        df.filter((F.col("t") >= 20 * k) & (F.col("t") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = drift_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("drift").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    want = store.drift_events(df).collect()
    assert sorted(want) == sorted(spark.table("drift").collect()) and len(want) == 8


@pytest.mark.parametrize("name", ["content_hash_dups", "drift_events"])
def test_queries_are_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries() and name in __spark_entry__.oracle_sql()
