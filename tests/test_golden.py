"""Published fingerprints, and cases worked out by hand for the rules that a generated SQL cannot check."""

import pytest
from pyspark.sql import functions as F

from citeloom.functions import html, relation, text
from citeloom.operators import match, verify

#: (before, exact, after, hexadecimal digest); the two published ones with long sentences are left out.
VECTORS = [
    ("The rate is ", "exactly 42%", " as measured", "f2d30080cf6f2dd31c4e160673b427742c132bd7fe6b014e0b5026daea80bbf5"),
    ("café au lait ", "résumé complet", " du rapport", "c9ac6f27318e7f3a7d27b85a9823ac7644e6a02d2f58c2abd1801ae99a9a53e4"),
    ("  multiple   ", "  spaces  here  ", "  trimmed  ", "ad4c8f44cc63c1d34451eab399094657961632d044a29c9c852d2bac064f3948"),
    ("", "Only exact, no context", "", "d8ea2d1c308a3d38328362479c1a97dbdf5a9a87ca64a6a4b3fdd430853edd8b"),
    ("", "AI-generated text often cannot be verified or retrieved by anyone other than the original author", "", "b8ba02cbee19230434c6a5b1431c0f8bfab8e00eb13b670875faa874959fb298"),
    ("", "Hello, world!", "", "cad437fb7351553fe2d565e4b67e59713e063222a2c65a2f768cce73352a1586"),
    ("", "Hello,   world!\n\ttest", "", "f97fd0de4198f3a6ba7dbfb83e7cc1c45b23905f9fa4330c12c15a260f1a1542"),
    ("", "cafe\u0301", "", "b433ffec5f0511a6d43881e4fb8bed86ba6616a16608477478c0cdd872b48285"),
    ("", "caf\u00e9", "", "b433ffec5f0511a6d43881e4fb8bed86ba6616a16608477478c0cdd872b48285"),
    ("", "\u4f60\u597d\u4e16\u754c", "", "784d8327eb064ca62d2bfbfd5542f42336d154c885bfe98dda565b76606065ed"),
    ("", "\U0001F600\U0001F4A1", "", "313603505a6cde53ee7148c3bfadb403e10036c2612be9783dac874d4c70fc6d"),
    ("A" * 50, "test", "A" * 50, "deb6e1e50d10560c7e65a4c48c1e7d7c58bf212935c091043b735fbefb317d4c"),
    ("B" * 100, "test", "B" * 100, "86309984bf5222c0dbdb2611a75ad25df73e852f7f8d697414b880be6a97d4b4"),
    ("short", "test", "ctx", "a16f3204c5229ddd197e60ad3cfeefe38ce956ec586825f83671bcabbb329980"),
    ("", "", "", "da6f851a04676cd01c5e80335da666433c880012982d53cb022336bf565acfbd"),
    ("", "a|b|c", "", "277e31e19888f6d24cd513dcd3b4850518c0fc55966ebc52dd87288863ca421a"),
    ("", "\u212B", "", "e89cc1c9076e00a3ec13fd451c04aef915732b0cf25cc3d26478552198ab2c6e"),
    ("", "\u1100\u1161", "", "17a436bf3abdb0060ee3ba7e6c0208d688354386a8042679a22fb660740066cf"),
    ("", "hello\u00a0world", "", "2eceb2ef315fb702311c91140076a43159d6e99b5b738f035cff65d08daeab1f"),
    ("", "   \t\n  ", "", "da6f851a04676cd01c5e80335da666433c880012982d53cb022336bf565acfbd"),
    ("X" * 49, "test", "", "ec71a933caf02232061eaec28ba101e856d1a97a9ba1232acb77223beb1fa1ac"),
]


def test_published_fingerprints(spark):
    df = spark.createDataFrame(VECTORS, "b string, e string, a string, h string")
    got = df.select("h", text.fingerprint("e", "b", "a").alias("f")).collect()
    assert len(got) == 21 and all(r.f == "sha256:" + r.h for r in got)


PAGES = {
    "<nav><nav>a</nav>b</nav>c": "c",
    "caf&eacute; &#233; &#x27;": "café é '",
    "<p>x<script>var a = 1; <b>": "x",
    "<!-- <script> --><p>hi</p>": "hi",
    '<a title="x>y">t</a>': "t",
    "<P>A &amp; B</P>\n<ul><li>one</li></ul>": "A & B\n\none",
    "a < b &amp; c > d": "a < b & c > d",
    "</nav>x": "x",
    "<header>h<div>i</div></header><footer>f</footer>z": "z",
    "<style>p{}</style>line\nwrap  two<br>new": "line wrap two\n\nnew",
    "": "",
}


def test_html_to_text(spark):
    df = spark.createDataFrame([(h,) for h in [*PAGES, None]], "h string")
    assert {r.h: r.t for r in df.select("h", html.html_to_text("h").alias("t")).collect()} == PAGES | {None: None}


@pytest.mark.parametrize(
    "exact, before, after, want",
    [
        ("We define trust here", "", "", "supports"),
        ("Trust grows", "To define it:", "", "defines"),
        ("Trust grows", "", "by the Definition of trust", "defines"),
        ("Trust refers to hope", "", "", "defines"),
        ("They disagree on the rate", "", "", "contradicts"),
        ("7 % of them", None, None, "quantifies"),
        ("A risky model", "", "", "cautions"),
    ],
)
def test_relation_looks_for_definitions_around(spark, exact, before, after, want):
    df = spark.createDataFrame([(exact, before, after)], "e string, b string, a string")
    assert df.select(relation.infer_relation("e", "b", "a")).first()[0] == want


def test_an_empty_passage_is_found_nowhere(spark):
    df = spark.createDataFrame([(1, "some text", ""), (2, "some text", " "), (3, "some text", None), (4, "", "x")], "id int, s string, p string")
    got = {r.id: r.match_type for r in match.locate(df, "s", "p").collect()}
    assert got == {1: None, 2: "exact", 3: None, 4: None}


def test_badges_of_online_runs_and_warnings(spark):
    rows = [(1, None, "a b c d", "x"), (2, "http://a", "a b c d", "x"), (3, "http://a", "the cat sat on the mat today", "So the cat sat on the matt today, they say.")]
    df = spark.createDataFrame(rows, "id int, url string, text_exact string, source_text string").withColumn("hash", text.fingerprint("text_exact", F.lit(""), F.lit("")))
    got = {r.id: r for r in verify.verify(df).collect()}
    assert (got[1].status, got[1].badge) == ("insufficient_metadata", "unreachable")
    assert (got[2].status, got[2].badge) == ("passage_not_found", "partial")
    assert got[3].match_type == "fuzzy" and got[3].warnings == ["found only approximately"]
