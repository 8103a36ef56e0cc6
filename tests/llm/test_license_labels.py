"""Labels of notices that differ by one word, or by its absence."""

from __future__ import annotations

import pytest

from loomtab.llm.license_scan import NOTICES, PHRASES, license_scan, telling

CASES = {
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "Licensed under CC BY 4.0.": "cc-by",
    "Licensed under CC BY-SA 4.0": "cc-by-sa",
    "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa",
    "released under the terms of the BSD License": "bsd",
    "Released under the terms of the GNU General Public License": "gpl",
    "Licensed under the MIT License, Version 2.0": "mit",
    "Released under the terms of the MIT License": "mit,mit-notice",
    "Licensed under the Apache License, Version 2.0": "apache,apache-notice",
    "License the terms of MIT under released the of": "",
    "": "",
    NOTICES[[n.label for n in NOTICES].index("lgpl")].text: "gpl,lgpl",
    next(n.text for n in NOTICES if n.label == "gpl-notice" and len(n.text) > 90): "gpl,gpl-notice",
}


@pytest.fixture(scope="module")
def found(spark):
    rows = list(enumerate(CASES))
    return {CASES_LIST[r["doc_id"]]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


CASES_LIST = list(CASES)


@pytest.mark.parametrize("text", CASES_LIST)
def test_labels(found, text):
    assert found[text]["labels"] == CASES[text]
    assert (found[text]["score"] > 0) == bool(CASES[text])


def test_every_template_has_its_own_label_alone(spark):
    """A template's text is found as its label, and as no other notice."""
    rows = [(i, n.text) for i, n in enumerate(NOTICES)]
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    phrases = {p.label for p in PHRASES}
    for i, notice in enumerate(NOTICES):
        assert set(got[i]["labels"].split(",")) - phrases == {notice.label} and got[i]["score"] == 1.0


def test_telling_parts():
    templates = PHRASES + NOTICES
    parts = {templates[t].text: (words, runs) for t, words, runs in telling(templates, 0.7)}
    assert parts["licensed under CC BY 4.0"] == ([], [[3]])
    assert all(not w and not r for t, (w, r) in parts.items() if t in {p.text for p in PHRASES})
