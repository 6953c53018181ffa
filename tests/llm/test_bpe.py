import base64

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm import bpe

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def reference(name):
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{bpe.TOKENIZERS}/{name}", "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ids, special_tokens={})


def tokens_of(texts, name):
    flat, counts = bpe.encode_batch(pa.array(texts, pa.string()), bpe.ranks(bpe.TOKENIZERS, name))
    out, at = [], 0
    for n in counts:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


@pytest.mark.parametrize("name", FILES)
def test_tokens_equal_the_library(name):
    lib = reference(name)

    @settings(max_examples=120, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(list("ab eaAé日\n\t  　'st1½!?\x1f\x85")), max_size=30) | st.text(max_size=15), max_size=5))
    def check(texts):
        assert tokens_of(texts, name) == [lib.encode_ordinary(t) for t in texts]

    check()


def test_long_runs_and_prose(spark):
    lib = reference(FILES[0])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(80).collect()
    texts = ["a" * 5001, " " * 301 + "x", "the the " * 3000, "", *[r.text for r in docs]]
    assert tokens_of(texts, FILES[0]) == [lib.encode_ordinary(t) for t in texts]


def test_round_trip_through_tables(docs_of, spark):
    rows = [(1, "Hello  wörld\n"), (2, ""), (3, None), (None, "x"), (1, "Hello  wörld\n")]
    got = bpe.bpe_encode(docs_of(rows))
    assert {(r.doc_id, r.n_tokens is None, r.round_trip) for r in got.collect()} == {(1, False, True), (2, False, True), (3, True, None), (None, False, True)}
    assert sorted(map(tuple, bpe.bpe_decode(got).collect()), key=str) == sorted(rows, key=str)
    assert bpe.bpe_encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_dictionary_of_the_corpus_gives_the_library_s_tokens(spark, docs_of):
    """In buckets and files of few words, and with a text that holds every mark."""
    lib = reference(FILES[0])
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + [bpe.MARKS + " all marks", "a " * 5000, ""]
    got = bpe.bpe_encode(docs_of(list(enumerate(texts))), bucket_bytes=20_000, file_words=500).collect()
    assert {r.doc_id: list(r.tokens) for r in got} == {i: lib.encode_ordinary(t) for i, t in enumerate(texts)} and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(docs_of(list(enumerate(texts)))).collect()} == {i: len(lib.encode_ordinary(t)) for i, t in enumerate(texts)}
