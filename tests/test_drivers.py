"""Drivers, writers, readers and rendering on small cases."""

import json
import math
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from citeloom.functions import html, labels, strain, text
from citeloom.operators import enrich, extract, match, render, resolve, store, verify
from citeloom.operators import strain as operators_strain
from citeloom.plans.drivers import analysed
from citeloom.sources import citations, writers

SF = "/root/testdata/sf0.001"


def brute_context(article, exact, before, after):
    at = article.find(exact)
    at = at if at >= 0 else article.lower().find(exact.lower())
    if at < 0:
        return before + exact + after
    region = article[max(0, at - 200) : at + len(exact) + 200]
    parts = re.split(r"(?<=[.!?])\s+", region)
    hits = [exact[:30].lower() in p.lower() or exact[-30:].lower() in p.lower() for p in parts]
    if True not in hits:
        return region.strip()
    first = hits.index(True)
    last = next((i for i in range(first, len(parts)) if not hits[i]), len(parts) - 1)
    return " ".join(parts[first : last + 1]).strip()


def brute_score(passage, claim):
    tokens = lambda t: [w for w in re.findall(r"[a-zÀ-ɏЀ-ӿ']+|\d+", t.lower()) if len(w) > 1 and w not in strain.STOPWORDS]
    a, b = tokens(passage), tokens(claim)
    shared = len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    rouge = 2 * table[-1][-1] / (len(a) + len(b)) if table[-1][-1] else 0.0
    x, y = list(zip(a, a[1:])), list(zip(b, b[1:]))
    apart = 1.0
    if x and y:
        every, apart = set(x) | set(y), 0.0
        for w in every:
            p, q = (x.count(w) + 1) / (len(x) + len(every)), (y.count(w) + 1) / (len(y) + len(every))
            apart += 0.5 * p * math.log2(2 * p / (p + q)) + 0.5 * q * math.log2(2 * q / (p + q))
        apart = min(apart, 1.0)
    return min(max((1 - (0.3 * shared + 0.4 * rouge + 0.3 * shared) + 0.2 * apart) / 1.2, 0), 1)


def test_analysis_equals_brute_force(spark):
    got = analysed(spark, SF)
    local = got["local"].collect()
    by = {}
    for r in local:
        context = brute_context(r.article, r.text_exact, "", "")
        assert r.claiming_context == context
        mean, std = {"journalism": (0.28, 0.14), "social_science": (0.22, 0.12)}["journalism" if r.conv_id % 2 == 0 else "social_science"]
        want = 1 / (1 + math.exp(-(brute_score(r.text_exact, context) - mean) / std))
        assert r.score == pytest.approx(want, abs=1e-9)
        by.setdefault(r.conv_id, []).append((r.turn, r.source_key, want))
    assert len(local) > 20
    for d in got["documents"].collect():
        own = by[d.conv_id]
        keys = {}
        for _, k, s in own:
            keys.setdefault(k, []).append(s)
        several = [v for v in keys.values() if len(v) > 1]
        share = sum(max(v) - min(v) < 0.3 for v in several) / len(several) if several else 1.0
        assert (d.citation_count, d.consistency_score) == (len(own), pytest.approx(share)) and d.mean_local_strain == pytest.approx(sum(s for *_, s in own) / len(own))
    counts = {(r.conv_id, r.citation): r.obstructions for r in got["obstructions"].collect()}
    assert counts == {(d, t): sum(k == k2 and abs(s - s2) >= 0.3 for _, k2, s2 in own) for d, own in by.items() for t, k, s in own}
    reports = {r.conv_id: json.loads(r.report) for r in enrich.report_json(got, "conv_id", "turn").collect()}
    assert all(len(reports[d]["local_strains"]) == len(own) and sum(reports[d]["strain_distribution"].values()) == len(own) for d, own in by.items())


def test_pairs_and_counts_of_obstructions_agree(spark):
    rows = [("d", "s" if i % 3 else "t", i, (i * 37 % 100) / 100 + i * 1e-5) for i in range(60)]  # no two just 0.3 apart
    df = spark.createDataFrame(rows, "doc string, src string, id int, score double")
    pairs = operators_strain.obstructions(df, "doc", "src", "id").collect()
    counts = {r.citation: r.obstructions for r in operators_strain.obstruction_counts(df, "doc", "src", "id").collect()}
    assert counts == {i: sum(i in (p.citation_a, p.citation_b) for p in pairs) for i in range(60)}


def test_enrichment_online(spark):
    fp = text.fingerprint("text_exact", "text_before", "text_after")
    rows = [("a", "the cat sat", "He said ", " down.", "He said the cat sat down.", "web"), ("b", "a dog ran", "", "", None, "web"), ("c", "the cat sat on the mat today", "", "", "So the cat sat on the matt today, they say.", None)]
    df = spark.createDataFrame(rows, "id string, text_exact string, text_before string, text_after string, source_text string, source_type string")
    df = df.withColumns({"doc_id": F.lit(1), "url": F.lit("http://a"), "source_url": F.lit("http://a"), "relation": F.lit("supports"), "article": F.concat(F.lit("As it is: "), "text_exact", F.lit(". Yes. No.")), "hash": fp, "captured_by": F.lit("model")})
    got = {r.id: {k: json.loads(v) for k, v in r.enrichment.items()} for r in enrich.enrich(df, F.lit("T"), article="article").collect()}
    assert got["a"]["verification"] == {"status": "verified", "internal_hash_valid": True, "checked_at": "T", "source_hash_valid": True, "source_hash_recomputed": got["a"]["verification"]["source_hash_recomputed"], "source_checked_url": "http://a", "match_type": "exact", "match_similarity": 1.0, "warnings": ["model-captured without an archived copy"]}
    assert got["b"]["verification"]["status"] == "unreachable" and "match_type" not in got["b"]["verification"]
    assert got["c"]["verification"]["match_type"] == "fuzzy" and got["c"]["verification"]["status"] == "source-drift"
    s = got["a"]["strain"]
    assert s["discipline"] == "journalism" and s["claiming_context"] == "As it is: the cat sat. Yes." and s["calibrated"] and set(s["components"]) == {"jaccard_overlap", "rouge_l", "idf_overlap", "bigram_divergence"}
    again = enrich.enrich(df.withColumn("enrichment", F.create_map(F.lit("strain"), F.lit("1"), F.lit("other"), F.lit("2"))), F.lit("T"), offline=True).first().enrichment
    assert set(again) == {"strain", "other", "verification"} and again["strain"] == "1"


def test_zip_join_needs_equal_lists(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "doc int, n int, l string")
    b = a.select("doc", "n", F.upper("l").alias("r"))
    assert sorted(map(tuple, enrich.zipped(a, b, "doc", "n").select("l", "r").collect())) == [("x", "X"), ("y", "Y")]
    with pytest.raises(Exception, match="differ in length"):
        enrich.zipped(a, b.filter("n = 0"), "doc", "n").collect()


PAGE = '<html><head><title>t</title></head><body class="x"><p>He <b>said</b> that the cat\n sat on the mat today &amp; slept.</p><p>First words of it stand here and then come other last words in this place.</p></body></html>'


def test_places_in_markup():
    find = lambda t: (lambda p: p and PAGE[p[0] : p[1]])(render.locate(PAGE, t))
    assert find("sat on the mat") == "sat on the mat"
    assert find("today & slept") == "today &amp; slept"
    assert find("the cat sat on") == "the cat\n sat on"
    assert find("said that the cat") == "said</b> that the cat"
    assert find("First words of it stand there and then came other last words in this place.").startswith("First words of it") and find("none of these words are here") is None


def test_rendering_twice_renews(spark):
    c = [dict.fromkeys(render.FIELDS) | {"id": i, "text_exact": t, "position": p, "title": "T <i>", "record": json.dumps({"id": i, "x": "</script>"})} for i, t, p in (("a", "the cat sat on", 5), ("b", "the cat sat on", 5), ("z", "not there at all", 1))]
    once = render.render(PAGE, c)
    assert once.count('class="cl-mark"') == 1 and once.count('class="cl-badge"') == 2 and once.count('class="cl-panel"') == 3 and 'data-cites="a,b"' in once
    assert render.render(once, c) == once and render.cleaned(once) == PAGE == render.render(once, [])
    block = spark.createDataFrame([(once,)], "h string").select(F.regexp_extract("h", r'(?s)<script data-cl type="application/ld\+json">(.*?)</script>', 1)).first()[0]
    assert [x["id"] for x in json.loads(block)] == ["z", "a", "b"] and render.render("no body", c[:1]).startswith("<!doctype html>")


def test_citation_files(spark, tmp_path):
    good = {"@type": "Cite", "version": "1.0", "id": "c1", "source": {"title": "T"}, "target": {"text_exact": "some text"}, "relation": "supports", "captured_by": "author"}
    bad = good | {"id": "c2", "relation": "nonsense"}
    block = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    (tmp_path / "a.html").write_text(f"<p>{block([good, bad])}{block({'@type': 'Other'})}<script type='application/ld+json'>broken</script>")
    (tmp_path / "b.json").write_text(json.dumps(good | {"id": "c3"}))
    (tmp_path / "c.txt").write_text(json.dumps([good | {"id": "c4"}]))
    (tmp_path / "d.page").write_text(block(good | {"id": "c5"}))
    got = citations.read_files(spark, str(tmp_path), "Cite").collect()
    assert sorted(r.id for r in got) == ["c1", "c3", "c4", "c5"]
    filled = citations.read_json(spark, str(tmp_path / "b.json")).first()
    assert filled.target.hash == spark.range(1).select(text.fingerprint(F.lit("some text"), F.lit(""), F.lit(""))).first()[0]
    read = {r.path.rpartition("/")[2]: r.text for r in citations.read_articles(spark, str(tmp_path)).collect()}
    assert read["a.html"] == "" and read["c.txt"].startswith("[{")
    row = spark.createDataFrame([("x", "", -1, [], False, None)], "a string, b string, n int, l array<string>, f boolean, z string")
    assert json.loads(row.select(citations.compact_json("a", "b", "n", "l", "f", "z")).first()[0]) == {"a": "x", "f": False}


def test_store_of_results(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([{"citation_id": "a", "status": "verified", "passage_match": {"found": True, "matched_text": "m"}}, {"citation_id": "b", "status": "hash_mismatch", "warnings": ["w"]}]))
    rows = writers.read_results(spark, str(tmp_path / "one.json"))
    assert {(r.citation_id, r.source_title, r.internal_hash_valid, r.source_hash_valid, tuple(r.warnings)) for r in rows.collect()} == {("a", "", False, None, ()), ("b", "", False, None, ("w",))}
    at = str(tmp_path / "store")
    for _ in range(2):
        writers.append_results(rows, at, "one.json")
    kept = writers.stored_results(spark, at)
    assert kept.count() == 4 and kept.select("id").distinct().count() == 4 and store.latest(kept).count() == 2


def test_corpus_search_of_short_and_altered_passages(spark):
    sources = [(i, t) for i, t in enumerate(["The cat sat on the mat and slept all day long.", "Another day, another dog: no cats.", "THE CAT  sat elsewhere", "", "He wrote that the quick brown foxes jump over lazy dogs again."])]
    passages = [(0, "cat"), (1, "the cat"), (2, "cat sat on"), (3, "at sat o"), (4, "day lo"), (5, "mat and slept all"), (6, "quick brown foxes jumped over lazy dogs"), (7, ""), (8, "nope nope nope")]
    p, s = spark.createDataFrame(passages, "pid int, text string"), spark.createDataFrame(sources, "sid long, text string")
    norm = lambda t: " ".join(t.split())
    want = {(i, j) for i, x in passages for j, y in sources if x and norm(x).lower() in norm(y).lower()}
    got = {(r.pid, r.sid) for r in match.search_corpus(p, s, "pid", "sid").collect()}
    assert got == want and len(want) > 8
    plan = match.search_corpus(p, s, "pid", "sid")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    near = {(r.pid, r.sid): r for r in match.search_corpus(p, s, "pid", "sid", fuzzy=True).collect()}
    assert set(near) == want | {(6, 4)} and near[6, 4].match_type == "fuzzy"
    assert near[6, 4].similarity == SequenceMatcher(None, passages[6][1].lower(), near[6, 4].matched_text.lower()).ratio()


def test_fetched_bodies(spark):
    rows = [("café".encode("latin-1"), "text/plain; charset=ISO-8859-1"), ("<p>é</p>".encode(), "text/html"), (b"\xff", None), (b"<!doctype html><p>x", ""), (b"a", "text/plain; charset=nonsense"), (None, None)]
    df = spark.createDataFrame(rows, "b binary, t string")
    assert [r[0] for r in df.select(html.fetched_text("b", "t")).collect()] == ["café", "é", "�", "x", "a", None]
    assert spark.range(1).select(html.escape(F.lit("<a b='c'>&"))).first()[0] == "&lt;a b=&#x27;c&#x27;&gt;&amp;"


def test_notation_and_groups(spark):
    df = spark.createDataFrame([(1, "x [[cite:a-1|sha256:0f|http://a|supports]] y [[cite:b|sha256:1||]]"), (2, None)], "doc_id int, t string")
    assert sorted(map(tuple, extract.from_notation(df, "t").collect())) == [(1, "cite", "a-1", "sha256:0f", "http://a", "supports"), (1, "cite", "b", "sha256:1", "", "")]
    q = spark.createDataFrame([(1, "p", 9, "B"), (1, "p", 5, "A"), (1, "q", 7, "C")], "doc_id int, text_exact string, position int, citation_hint string")
    assert [(r.text_exact, r.position, r.hints) for r in extract.grouped(q).collect()] == [("q", 7, ["C"]), ("p", 5, ["A", "B"])]


def test_labels(spark):
    df = spark.createDataFrame([("verified", "low"), ("source-drift", "EXTREME"), ("what", "odd"), (None, None)], "b string, s string")
    got = df.select(labels.verification_label("b").alias("v"), labels.strain_label("s").alias("t")).collect()
    assert [(r.v.kind, r.t.label) for r in got] == [("ok", "Low claim distance"), ("drift", "Extreme claim distance"), ("muted", "Strain: odd"), ("muted", "Strain: ")]
    row = spark.createDataFrame([("fuzzy", 0.9, False, "http://a?b&c", "", ["w"])], "m string, s double, h boolean, u string, e string, w array<string>")
    assert row.select(labels.verification_title("m", "s", "h", "u", "e", "w")).first()[0] == "Match: fuzzy (0.90) — Source hash recomputed — DIFFERS from captured hash — Source: http://a?b&amp;c — Warning: w"
    where = spark.createDataFrame([("", "10.1/x", "http://a", "p. 3", None, "http://w")], "f string, d string, u string, p string, s string, a string")
    assert [tuple(x) for x in where.select(labels.locators("f", "d", "u", "p", "s", "a")).first()[0]] == [("doi", "10.1/x"), ("page", "p. 3"), ("archive", "http://w")]


def test_resolution_tiers_and_tags(spark):
    refs = spark.createDataFrame([("Smith, 2020", 0, ["Smith, A."], 2020, "First"), ("Smith and Lee, 2020", 1, ["Smith, B."], 2020, "Second"), ("Odd, 1999", 2, ["Odd, O."], 1999, "Third")], "ref_key string, ord int, authors array<string>, year int, title string")
    sources = spark.createDataFrame([("Found", ["Doe, J."], 2001, "10.1000/a", "http://a", 5.0), ("Less", ["Doe, K."], 2001, None, None, 0.5)], "title string, authors array<string>, year int, doi string, url string, score double")
    quotes = spark.createDataFrame([(1, "Smith  and Lee, 2020"), (2, "the Smith paper, 2020a"), (3, "by Unusual"), (4, "Doe et al., 2002"), (5, ""), (6, "Nobody, 1950"), (7, "10.1000/A")], "k int, citation_hint string")
    out = resolve.resolve(quotes, refs, sources, {"title": "Own", "authors": ["Me"], "year": 2024}, "k", aliases={"Unusual": "Odd, 1999"})
    got = {r.k: (r.resolution, r.title, r.year) for r in out.collect()}
    assert got == {1: ("matched", "Second", 2020), 2: ("matched", "First", 2020), 3: ("matched", "Third", 1999), 4: ("searched", "Found", 2001), 5: ("self", "Own", 2024), 6: ("unresolved", "[UNRESOLVED: Nobody, 1950]", None), 7: ("searched", "Found", 2001)}
    assert {r.resolution: r.n for r in resolve.tally(out).collect()} == {"matched": 3, "searched": 2, "self": 1, "unresolved": 1}
    tags = spark.createDataFrame([("A",), ("Unknown",), ("",), (None,)], "t string").select(resolve.resolution_tag("t")).collect()
    assert [r[0] for r in tags] == ["curated", "unresolved", "unresolved", "unresolved"]
    words = spark.range(1).select(resolve.context_words(F.lit("The Quick Brown foxes from Berlin met Smith in Paris"), F.lit("smith"))).first()[0]
    assert words == ["Quick", "Brown", "Berlin"]


def test_history_and_drift_in_order(spark):
    rows = [("a", 1, 1, "x", 1), ("a", 2, 2, "y", None), ("a", 3, 3, "x", 1), ("b", 4, 4, "z", 2), ("a", 5, 5, "w", 3)]
    f = spark.createDataFrame(rows, "url string, t long, seq long, content_hash string, content_length long").withColumn("ts", F.timestamp_seconds("t"))
    drift = store.drift_events(f)
    assert [r.new_hash for r in store.drift_of(drift, "a").collect()] == ["y", "w"] and [r.new_hash for r in store.drift_of(drift, newest_first=True).collect()] == ["w", "y"]
    assert [r.content_hash for r in store.history_of(store.source_history(f), "a").collect()] == ["x", "y", "w"]


def test_report_of_a_result(spark):
    df = spark.createDataFrame([("c1", "a b c", "http://a", "x a b c y")], "citation_id string, text_exact string, url string, source_text string").withColumns({"hash": text.fingerprint("text_exact", F.lit(""), F.lit("")), "source_title": F.lit("S"), "page_ref": F.lit("p. 1"), "relation": F.lit("supports"), "source_url": F.col("url")})
    got = verify.verify(df).select(writers.result_text()).first()[0].split("\n")
    assert got[0] == "  [~] c1: PASSAGE FOUND" and '      Found: "a b c"' in got and "      Source hash: differs" in got and "      Location: p. 1" in got
