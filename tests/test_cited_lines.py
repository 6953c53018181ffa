"""Every line of every document is verified against its whole source."""

from citeloom.plans.queries import source_verify_fuzzy, source_verify_lines


def test_all_lines(spark, tmp_path):
    rows = [(1, "only line", "en", "u1"), (2, "first\nsecond\nthird", "de", "u2"), (3, "un\ndeux", "fr", "u3"), (4, "uno\ndos", "es", "u4")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for f in (source_verify_lines, source_verify_fuzzy):
        got = {(r.doc_id, r.pos): r.status for r in f(spark, str(tmp_path)).collect()}
        assert set(got) == {(d, i) for d, t, *_ in rows for i in range(t.count("\n") + 1)}
        assert got[1, 0] == got[2, 0] == got[2, 1] == got[2, 2] == "verified"
        assert got[3, 0] != "passage_not_found" and got[4, 1] == "source_unavailable"
