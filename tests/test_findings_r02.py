"""Rows that once differed from SQL, or took time that grew with the square of a text."""

import duckdb
from pyspark.sql import functions as F

from citeloom.functions import html, strain, text
from citeloom.operators import match
from citeloom.plans.drivers import document_strain, strain_reports
from citeloom.plans.queries import ORACLE_SQL, html_to_text_pages, source_verify_fuzzy, source_verify_lines, source_verify_status


def oracle(name, tmp_path, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    return sorted(con.execute(ORACLE_SQL[name]).fetchall())


def test_entities_without_semicolon_stay(spark, tmp_path):
    pages = ["<p>&lt;a&amp</p>b", "<title>x&amp;&amp</title>y", "&copy 1 &nbsp; &ampx", "a &lt b &gt"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, html_to_text_pages(spark, str(tmp_path)).collect())) == oracle("html_to_text_pages", tmp_path, "pages")
    assert html.parsed_text("&copy 1 &ampx; &eacute; &#233; &#x27; &nosuch; & &") == "&copy 1 &ampx; é é ' &nosuch; & &"


def test_case_goes_code_point_by_code_point(spark, tmp_path):
    lines = ["weiß alles", "ﬁn ŉ ᾳ", "İstanbul", "ΟΔΟΣ", "plain"]
    docs = [(i, f"first\n{x}\nlast {x}ab", "fr", "u") for i, x in enumerate(lines)] + [(9, "Größe\nmaß", "en", "u")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, source_verify_status(spark, str(tmp_path)).collect()))
    assert got == oracle("source_verify_status", tmp_path, "documents") and all(r[1] != "passage_not_found" for r in got)
    df = spark.createDataFrame([("xİ ΟΔΟΣΑ THE END", "οδοσ the"), ("xİ ΟΔΟΣ the end", "THE end")], "s string, p string")
    assert {r.p: (r.match_type, r.matched_text) for r in match.locate(df, "s", "p").collect()} == {"οδοσ the": (None, None), "THE end": ("normalized", "the end")}
    c = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(x,) for x in c], "x string").select("x", text.upper("x").alias("u"), text.lower("x").alias("l"))
    con = duckdb.connect()
    want = dict((x, (u, l)) for x, u, l in con.execute("SELECT x, upper(x), lower(x) FROM (SELECT chr(CAST(i AS INT)) AS x FROM range(1, 131072) t(i) WHERE i NOT BETWEEN 55296 AND 57343)").fetchall())
    assert {r.x: (r.u, r.l) for r in df.collect() if r.x != "\0"} == want


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contexts_are_computed_once(spark):
    df = spark.createDataFrame([("One. A cat. Two.", "a cat", "b", "a")], "t string, x string, b string, a string").select(strain.claiming_context("t", "x", "b", "a").alias("c"))
    assert df.first().c == "A cat. Two." and planned(df).count("split(") == 1
    for f in (document_strain, strain_reports):  # scored once, before
        assert "sequence_measures" not in planned(f(spark, "/root/testdata/sf0.001"))


def test_passages_of_one_source_are_searched_together(spark, tmp_path):
    source = "The cat  sat\non the mat today, THE END. Weiß İx ΟΔΟΣ the end. " + "cafe\u0301 " * 3
    passages = ["the cat sat", "the end", "cat sat on", "café", "", " ", None, "weiß i", "the cat sat on the matt today", "no such thing at all", "οδοσ THE", "cat"]
    rows = [(1, source, passages), (2, None, passages), (3, "", passages), (4, source, []), (5, source, None)]
    df = spark.createDataFrame([(i, s, None if p is None else [(k, x) for k, x in enumerate(p)]) for i, s, p in rows], "id int, s string, ps array<struct<k: int, p: string>>")
    for fuzzy in (False, True):
        shown = ["id", "k", "p", *[F.when(F.col("match_type").isNotNull(), F.col(n)) for n in match.MATCH]]
        got = match.locate_each(df, "s", "ps", "p", fuzzy).select(*shown)
        want = match.locate(df.select("id", "s", F.inline("ps")), "s", "p", fuzzy).select(*shown)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 36
    wanted = ["a", "ab", "", "bab", "x", "abab"]
    one_by_one, at_once = match._firsts("cababab", wanted), match._firsts("cababab" + "c" * (match.SEARCHED // 5), wanted[:5] + ["ba"])
    assert one_by_one == {"a": 1, "ab": 1, "": 0, "bab": 2, "abab": 1} and at_once == {"a": 1, "ab": 1, "": 0, "bab": 2, "ba": 2}
    spark.createDataFrame([(1, "a\nb", "en", "u")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for f in (source_verify_lines, source_verify_fuzzy):
        plan = planned(f(spark, str(tmp_path)))
        assert plan.count("split(") == 1 and plan.count("Generate inline") == 1
