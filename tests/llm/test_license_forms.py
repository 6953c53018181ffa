import pytest

from citeloom.llm.license import TEMPLATES, license_scan

PLANTED = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 3.0.": "CC-BY-SA-3.0",
    "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0",
    "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
    "Licensed under CC0 1.0.": "CC0-1.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
}


def test_each_planted_line(docs_of):
    texts = list(PLANTED)
    got = license_scan(docs_of([(i, f"some words before\n{t}\nand after them") for i, t in enumerate(texts)]), closest=True).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(i, PLANTED[t]) for i, t in enumerate(texts)]


def test_every_template_finds_its_licence(docs_of):
    got = license_scan(docs_of([(i, f"lorem ipsum {t} dolor sit") for i, (_, t) in enumerate(TEMPLATES)]), closest=True).collect()
    found = {(r.doc_id, r.license): r.dice for r in got}
    for i, (name, _) in enumerate(TEMPLATES):
        assert found[i, name] == pytest.approx(1), name


def test_two_licences_apart_are_both_returned(docs_of):
    text = "Licensed under CC BY 4.0. " + "lorem ipsum " * 10 + "Licensed under CC BY-NC 4.0."
    got = license_scan(docs_of([(1, text)]), closest=True).collect()
    assert {r.license for r in got} == {"CC-BY-4.0", "CC-BY-NC-4.0"}
