"""License scans: Dice coefficient of word bigrams between texts and licence templates.

Texts and templates are lower-cased words without punctuation. A template of n words is compared
with every stretch of a document that could match it: by the size bounds of the coefficient, a
stretch of m bigrams can only reach the threshold t for a template of n when
n t / (2 - t) <= m <= n (2 - t) / t, so templates longer than the whole text allows are pruned, and so
are places with too few of the template's bigrams. The best stretch of each cluster of bigrams
shared with the template is returned, with the words where it starts and ends.

Defined results: null and empty texts and texts of one word match nothing and return no row. A
document returns a row for each licence it holds, its best stretch (the first, of equal ones); with
closest, not the licences whose stretch overlaps that of one with a higher coefficient, as those of a
kindred licence do. Rows repeated with one doc_id return theirs each. A null doc_id stays null. Texts
are taken whole, however long. An empty table gives no rows. ids are integers; other columns may have
any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import WORD, chunks, hashed, mixed, pick, words

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution. """
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission. """
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""

_LGPL_NOTICE = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version {} of the License, or (at your
option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General
Public License for more details."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_CC0_NOTICE = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to
this work."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more
information, please refer to <https://unlicense.org/>"""


def _full(name: str) -> str:
    return (Path(__file__).parent / "licenses" / f"{name}.txt").read_text()


def _creative_commons() -> list[tuple[str, str]]:
    """Short form, notice and identifier of each of the six licences in each version."""
    kinds = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
    versions = {"4.0": " International", "3.0": " Unported", "2.5": " Generic", "2.0": " Generic", "1.0": " Generic"}
    out = []
    for code, kind in kinds.items():
        for version, port in versions.items():
            name = f"CC-{code}-{version}"
            out += [(name, f"Licensed under CC {code} {version}."), (name, f"This work is licensed under a Creative Commons {kind} {version}{port} License."), (name, f"SPDX-License-Identifier: {name}")]
    return out


#: (licence, template); a licence may have several forms.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", _GPL_NOTICE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", _ISC),
    ("Apache-2.0", _full("Apache-2.0")),
    ("GPL-3.0", _full("GPL-3.0")),
    ("GPL-2.0", _full("GPL-2.0")),
    ("GPL-2.0", _GPL_NOTICE.replace("software:", "software;").replace("version 3", "version 2")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-2.1", _full("LGPL-2.1")),
    ("LGPL-2.1", _LGPL_NOTICE.format("2.1")),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-3.0", _full("LGPL-3.0")),
    ("LGPL-3.0", _LGPL_NOTICE.format("3")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0", _GPL_NOTICE.replace("General Public", "Affero General Public")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("MPL-2.0", _full("MPL-2.0")),
    ("MPL-2.0", _MPL_NOTICE),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC0-1.0", _full("CC0-1.0")),
    ("CC0-1.0", _CC0_NOTICE),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", "Released under the Unlicense."),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    *_creative_commons(),
]


def _bigrams(h: np.ndarray) -> np.ndarray:
    return mixed(mixed(h[:-1], 1) ^ h[1:], 2)


def _template(text: str) -> np.ndarray:
    return _bigrams(hashed(WORD.findall(text.lower())))


def best_stretch(grams: np.ndarray, template: np.ndarray, threshold: float) -> tuple[float, int, int] | None:
    """(dice, first, end) of the best stretch of grams against template, as multisets; None below threshold."""
    n = len(template)
    low, high = int(np.ceil(n * threshold / (2 - threshold) - 1e-9)), int(n * (2 - threshold) / threshold + 1e-9)
    kinds, quota = np.unique(template, return_counts=True)
    at = np.minimum(np.searchsorted(kinds, grams), len(kinds) - 1)
    hits = np.flatnonzero(kinds[at] == grams)
    need = int(np.ceil(threshold * (n + low) / 2 - 1e-9))  # shared by any stretch that is long enough
    if len(grams) < low or len(hits) < max(1, need):
        return None
    best = None
    kind = at[hits]
    # How many of its kind stand before each hit.
    order = np.argsort(kind, kind="stable")
    first = np.searchsorted(kind[order], np.arange(len(kinds)))
    rank = np.empty(len(hits), np.int64)
    rank[order] = np.arange(len(hits)) - first[kind[order]]
    before = np.zeros(len(kinds), np.int64)
    for i in range(len(hits) - max(1, need) + 1):
        # The best stretch begins and ends with a shared bigram.
        if i:
            before[kind[i - 1]] += 1
        stop = int(np.searchsorted(hits, hits[i] + high))
        if stop - i < need:
            continue
        own, size = kind[i:stop], hits[i:stop] - hits[i] + 1
        dice = 2 * np.cumsum(rank[i:stop] - before[own] < quota[own]) / (n + size)
        dice[size < low] = 0
        j = int(np.argmax(dice))
        if dice[j] >= threshold and (best is None or dice[j] > best[0]):
            best = (float(dice[j]), int(hits[i]), int(hits[i + j]) + 1)
    return best


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] | None = None, closest: bool = False) -> DataFrame:
    """(doc_id, license, dice, first_word, end_word) of every licence found in every document."""
    forms = [(name, _template(text)) for name, text in (TEMPLATES if templates is None else templates)]
    forms = [(name, grams) for name, grams in forms if len(grams)]
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna(subset=["text"])
    # Each bigram of each template with the template it is of.
    pairs = sorted({(int(g), i) for i, (_, grams) in enumerate(forms) for g in grams})
    keys, owner = np.array([g for g, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in chunks(batches, "text"):
            w = words(rb.column(1))
            h = hashed(w.names)[w.codes]
            start = np.cumsum(w.counts) - w.counts
            grams = _bigrams(h) if len(h) > 1 else np.zeros(0, np.uint64)
            docs_of = w.docs
            inside = docs_of[1:] == docs_of[:-1]
            lo, hi = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
            places = np.flatnonzero(inside & (hi > lo))
            each = hi[places] - lo[places]
            form = owner[np.repeat(lo[places] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))] if len(places) else np.zeros(0, np.int64)
            doc = np.repeat(docs_of[places], each)
            pair, shared = np.unique(doc * len(forms) + form, return_counts=True)
            out: dict[tuple[int, str], tuple[float, int, int]] = {}
            for p, m in zip(pair, shared):
                d, i = divmod(int(p), len(forms))
                name, template = forms[i]
                n = len(template)
                least = n * threshold / (2 - threshold)
                # By the size bounds, the document is too short or shares too little.
                if w.counts[d] - 1 < least - 1e-9 or m < threshold * (n + least) / 2 - 1e-9:
                    continue
                got = best_stretch(grams[start[d] : start[d] + w.counts[d] - 1], template, threshold)
                if got and (got[0], -got[1]) > (out[d, name][0], -out[d, name][1]) if (d, name) in out else got:
                    out[d, name] = got
            if closest:
                held: dict[int, list[tuple[float, int, int]]] = {}
                for (d, _), v in out.items():
                    held.setdefault(d, []).append(v)
                out = {(d, name): v for (d, name), v in out.items() if not any(o[0] > v[0] and o[1] < v[2] + 1 and v[1] < o[2] + 1 for o in held[d])}
            ids = rb.column(0).take(pa.array([d for d, _ in out], pa.int64()))
            cols = [ids, pa.array([n for _, n in out], pa.string()), pa.array([v[0] for v in out.values()], pa.float64()), pa.array([v[1] for v in out.values()], pa.int64()), pa.array([v[2] + 1 for v in out.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "license", "dice", "first_word", "end_word"])

    return rows.mapInArrow(run, "doc_id long, license string, dice double, first_word long, end_word long")
