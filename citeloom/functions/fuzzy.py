"""Approximate passage search: anchors of three words propose places, a sequence ratio decides.

Arrow batches go to Python only for the rows that exact and case-folded search left over.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD, WIDEST, LONGEST_TARGET, LONGEST_SOURCE = 0.85, 200, 500, 50_000
RESULT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("similarity", T.DoubleType())])


def _starts(source: str, target: str) -> list[int]:
    """Where a match could begin, by occurrences of the target's anchors, else all over a short source."""
    names, length = target.lower().split(), len(target)
    anchors = [names[:3]] + ([names[len(names) // 2 :][:3]] if len(names) >= 6 else [])
    low, out = source.lower(), set()
    for anchor in map(" ".join, anchors):
        at = low.find(anchor)
        while at >= 0:
            out.add(max(0, at - length))
            out.update(max(0, at - k) for k in range(0, min(length, WIDEST), 20))
            at = low.find(anchor, at + 1)
    if not out and length <= LONGEST_TARGET and len(source) <= LONGEST_SOURCE:
        out.update(range(0, max(0, len(source) - length) + 1, max(1, length // 4)))
    return sorted(out)


def search(source: str | None, target: str | None, threshold: float = THRESHOLD) -> tuple[int, int, float] | None:
    """(start, end, ratio) of the best stretch; of equal ones the first start, then the plain length."""
    if not source or not target or len(target.split()) < 3:
        return None
    length, spare, best = len(target), int(len(target) * 0.2), None
    matcher = SequenceMatcher()
    low, wanted = source.lower(), target.lower()
    exact_case = len(low) == len(source)
    for start in _starts(source, target):
        for n in (length, length - spare, length + spare):
            if n <= 0 or start + n > len(source):
                continue
            piece = low[start : start + n] if exact_case else source[start : start + n].lower()
            matcher.set_seqs(wanted, piece)
            if best is not None and matcher.real_quick_ratio() <= best[2]:
                continue  # an upper bound: this stretch cannot be strictly better
            ratio = matcher.ratio()
            if best is None or ratio > best[2]:
                best = (start, start + n, ratio)
    return best if best is not None and best[2] >= threshold else None


@F.pandas_udf(RESULT)
def fuzzy_match(source: pd.Series, target: pd.Series) -> pd.DataFrame:
    found = [search(s, t) or (None, None, None) for s, t in zip(source, target)]
    return pd.DataFrame(found, columns=["start", "end", "similarity"]).astype({"start": "Int32", "end": "Int32", "similarity": "float64"})
