import random
import re
from collections import Counter

from citeloom.llm.license import TEMPLATES, license_scan


def grams(words):
    return list(zip(words, words[1:]))


def brute(text, template, threshold):
    """Every stretch of the text, as (dice, first word), the best and first of them."""
    words, want = re.findall(r"\w+", (text or "").lower()), grams(re.findall(r"\w+", template.lower()))
    g, best = grams(words), None
    for i in range(len(g)):
        for j in range(i + 1, len(g) + 1):
            shared = sum((Counter(g[i:j]) & Counter(want)).values())
            dice = 2 * shared / (len(want) + j - i)
            if dice >= threshold and (best is None or dice > best[0] + 1e-12):
                best = (dice, i)
    return best


def test_scan_equals_all_stretches(docs_of):
    rng = random.Random(2)
    short = [t for t in TEMPLATES if len(t[1]) < 120]
    rows = [(None, short[0][1]), (1, None), (2, ""), (3, "mit"), (4, "released under the the MIT licence"), (4, short[0][1])]
    for i in range(60):
        words = [rng.choice(["a", "b", "the", "license", "under"]) for _ in range(rng.randint(0, 25))]
        notice = re.findall(r"\w+", rng.choice(short)[1])
        for _ in range(rng.randint(0, 2)):
            notice[rng.randrange(len(notice))] = "x"
        at = rng.randint(0, len(words))
        rows.append((10 + i, " ".join(words[:at] + notice + words[at:])))
    got = Counter((r.doc_id, r.license, round(r.dice, 9)) for r in license_scan(docs_of(rows), 0.7, short).collect())
    want = Counter()
    for d, text in rows:
        best = {}
        for name, template in short:
            b = brute(text, template, 0.7)
            if b and b[0] > best.get(name, 0):
                best[name] = b[0]
        want.update((d, n, round(v, 9)) for n, v in best.items())
    assert got == want


def test_whole_licence_inside_a_long_text(docs_of):
    mit, bsd = TEMPLATES[0][1], next(t for n, t in TEMPLATES if n == "BSD-3-Clause")
    filler = "lorem ipsum dolor " * 2000
    got = license_scan(docs_of([(1, filler + mit.replace("hereby ", "") + filler), (2, filler), (3, bsd)])).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "MIT"), (3, "BSD-3-Clause"), (3, "BSD-2-Clause")} or {(r.doc_id, r.license) for r in got} == {(1, "MIT"), (3, "BSD-3-Clause")}
    first = next(r for r in got if r.doc_id == 1)
    assert first.first_word == 6000 and first.dice > 0.97


def test_empty_table(docs_of, spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
