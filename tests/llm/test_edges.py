"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing column names: no operator fails on them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeloom.llm import bpe, classifier, exact, license, lm, minhash, packing, rules, toxicity, warc

LONG = "a long story about the old mill by the river " * 8000
TEXTS = [(1, "a plain text of some words"), (1, "a plain text of some words"), (None, "a plain text of some words"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG), (None, None), (7, "…!?"), (8, "x"), (9, "é日本 \U0001f600"), (10, "word " * 40)]
CLASHES = {"_0": "1", "_1": "'x'", "id": "string(null)", "node": "2.0D", "sig": "binary('s')", "shard": "'s'", "n": "int(null)", "bucket": "'b'", "word": "'w'", "__id": "0", "__route": "'r'", "__tokens": "1", "score": "'s'", "tokens": "'t'"}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(d, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else "s", None) for i, (d, t) in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({k: F.expr(v) for k, v in CLASHES.items()})
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, None, None), (None, 1, 1), (8, 1, 0), (10, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("id", F.lit(None).cast("long"))
    return docs, labels


PER_ROW = {
    "exact": lambda d, k: exact.exact_groups(d),
    "bpe": lambda d, k: bpe.bpe_encode(d),
    "toxicity": lambda d, k: toxicity.toxicity(d, k),
    "lm": lambda d, k: lm.lm_scores(d),
    "classifier": lambda d, k: classifier.quality_classifier(d, k),
    "rules": lambda d, k: rules.quality_rules(d),
}
OTHERS = {
    "minhash": lambda d, k: minhash.near_groups(d),
    "license": lambda d, k: license.license_scan(d, closest=True),
    "packing": lambda d, k: packing.pack(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_for_every_row(tables, name):
    got = PER_ROW[name](*tables).collect()
    assert len(got) == len(TEXTS) and sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in TEXTS)


@pytest.mark.parametrize("name", [*PER_ROW, *OTHERS])
def test_nothing_from_nothing(tables, name):
    docs, labels = tables
    assert (PER_ROW | OTHERS)[name](docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", [*PER_ROW, *OTHERS])
def test_all_null(tables, spark, name):
    docs = spark.createDataFrame([(None,) * 5] * 3, COLUMNS)
    assert (PER_ROW | OTHERS)[name](docs, tables[1]).count() == (3 if name in PER_ROW else 0)


def test_defined_results(tables):
    docs, labels = tables
    near = {r.doc_id: r.group_id for r in minhash.near_groups(docs).collect()}
    assert near == {5: 5, 6: 5}
    long = sum(r.length for r in packing.pack(docs).filter("doc_id = 5").collect())
    assert long == bpe.token_counts(docs).filter("doc_id = 5").first().n_tokens > 60_000
    assert {r.doc_id for r in rules.quality_rules(docs).filter("reason = 'empty'").collect()} == {None, 2, 3, 4}
    probabilities = classifier.quality_classifier(docs, labels).filter("probability is null")
    assert {r.doc_id for r in probabilities.collect()} == {None, 2, 3, 4} and probabilities.filter("not keep").isEmpty()
    assert toxicity.toxicity(docs, labels).filter("doc_id in (2, 3, 4)").agg(F.max("score")).first()[0] == 0
    groups = {(r.doc_id, r.first_id, r.copies) for r in exact.exact_groups(docs).collect()}
    assert {(1, 1, 3), (None, 1, 3), (2, 2, 1), (None, None, 1), (5, 5, 2), (6, 5, 2)} <= groups


def test_pages(spark):
    rows = [(None, None, None), (1, "http://a", ""), (1, "http://a", ""), (2, None, "<p>" + LONG), (3, "http://b\r\nx", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash")).withColumn("record_no", F.lit(7))
    got = warc.page_index(pages).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows) and all(r.status == "ok" for r in got)
    assert warc.page_index(pages.limit(0)).count() == 0 and warc.page_round_trip(pages).count() == 5


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_the_columns(tables, spark, tmp_path, stage):
    docs, labels = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    name, f = corpus_pipeline.STAGES[stage]
    got = f(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and got.count() <= len(TEXTS)
    assert f(spark, docs.limit(0), str(tmp_path)).count() == 0
