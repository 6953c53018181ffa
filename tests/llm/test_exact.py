import random
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from citeloom.llm.exact import exact_dedup, exact_groups, radix_classes


@given(st.lists(st.binary(max_size=40).map(lambda b: b * 3)))
def test_classes_are_those_of_equality(texts):
    by = defaultdict(list)
    for i, t in enumerate(texts):
        by[len(t), t].append(i)
    for length in {len(t) for t in texts}:
        own = [i for i, t in enumerate(texts) if len(t) == length]
        got = sorted(sorted(own[j] for j in c) for c in radix_classes([texts[i] for i in own]))
        assert got == sorted(v for (n, _), v in by.items() if n == length)


def rows():
    rng = random.Random(3)
    long = "".join(rng.choice("abc ") for _ in range(50_000))
    out = [(1, "a"), (2, "a"), (3, ""), (4, ""), (5, None), (6, None), (None, "a"), (7, long), (8, long), (9, long[:-1] + "z"), (2, "a"), (None, "n"), (10, "é" * 40), (11, "é" * 40)]
    return out + [(100 + i, f"{'p' * 70}{i % 7:03d}") for i in range(60)]


def brute(rows):
    by = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        by[("null", i) if t is None else t].append(d)
    out = []
    for members in by.values():
        first = min((m for m in members if m is not None), default=None)
        out += [(m, first, len(members)) for m in members]
    return sorted(out, key=str)


def test_groups_equal_brute_force(docs_of):
    for task_bytes in (256 << 20, 500):  # the second makes routes split over several rounds
        got = exact_groups(docs_of(rows()), task_bytes).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows())


def test_dedup_keeps_one_row_of_each_group_and_every_column(docs_of):
    df = docs_of(rows())
    got = exact_dedup(df).collect()
    assert exact_dedup(df).columns == df.columns
    texts = [r.text for r in got if r.text is not None]
    assert sorted(texts) == sorted({t for _, t in rows() if t is not None})
    assert sum(r.text is None for r in got) == 2
    assert next(r.doc_id for r in got if r.text == "a") == 1


def test_empty_table(docs_of, spark):
    df = spark.createDataFrame([], "doc_id long, text string, _0 int")
    assert exact_groups(df).count() == 0
    assert exact_dedup(df).count() == 0


def test_a_text_repeated_without_end_is_counted_where_it_lies(docs_of):
    long = "q" * 900
    many = [(i if i % 7 else None, long) for i in range(300)] + [(400 + i, long[:-1] + str(i % 10)) for i in range(40)] + [(500, "b" * 20), (501, "b" * 20), (502, None), (503, "")]
    got = exact_groups(docs_of(many), 4000).collect()
    assert sorted(map(tuple, got), key=str) == brute(many)
    kept = exact_dedup(docs_of(many), 4000).collect()
    assert sorted(r.text for r in kept if r.text is not None) == sorted({t for _, t in many if t is not None})
    assert next(r.doc_id for r in kept if r.text == long) == 1 and sum(r.text is None for r in kept) == 1
