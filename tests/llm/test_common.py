import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm.common import chunks, pick, words

TEXT = st.text(alphabet=st.sampled_from(list("abÉß9_ .,!\n\t　é字²")), max_size=30)


@settings(deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8), st.booleans())
def test_words_equal_the_regex(texts, marks):
    w = words(pa.array(texts, pa.string()), marks=marks)
    pattern = r"\w+|[^\w\s]+" if marks else r"\w+"
    want = [re.findall(pattern, (t or "").lower()) for t in texts]
    assert [w.names[c] for c in w.codes] == [x for t in want for x in t]
    assert w.counts.tolist() == [len(t) for t in want]


@settings(deadline=None)
@given(st.lists(st.none() | st.text(max_size=9), max_size=9), st.integers(1, 20))
def test_chunks_lose_nothing(texts, limit):
    rb = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    parts = list(chunks([rb], "t", limit))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(0).to_pylist()) <= limit for p in parts)


def test_pick_takes_exact_names(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, Text string")
    assert pick(df, "text", "doc_id").first() == ("a", 1)
    assert np.array(pick(df, "Text").first())[0] == "b"
