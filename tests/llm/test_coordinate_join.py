"""Near duplicates by signature coordinates against all pairs, with lists of every length."""

from __future__ import annotations

import random

import numpy as np
import pytest

from loomtab.llm import coordinate_join as cj
from tests.llm.test_operators import ROWS, SCHEMA, UNIQUE, by_id, jaccard_classes


def test_least_matches_is_the_largest_safe_threshold():
    assert cj.least_matches(32, 85) == 16 and cj.least_matches(32, 100) == 32 and cj.least_matches(4, 1) == 1


def test_signatures_agree_as_often_as_the_sets():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 1 << 63, 400).astype(np.uint64)
    owner = np.repeat([0, 1], [300, 300])
    both = np.concatenate([np.sort(values[:300]), np.sort(values[100:])])  # Jaccard 0.5
    sign = cj.signature(owner, both, 512)
    assert abs((sign[0] == sign[1]).mean() - 0.5) < 0.1
    assert cj.signature(owner[:0], both[:0], 8).shape == (0, 8)


@pytest.mark.parametrize(("short", "block", "dense"), [(8, 512, 1), (1, 4, 16), (1, 4, 0)])
def test_components_equal_all_pairs(spark, monkeypatch, short, block, dense):
    monkeypatch.setattr(cj, "SHORT_LIST", short)
    monkeypatch.setattr(cj, "BLOCK", block)
    monkeypatch.setattr(cj, "DENSE", dense)
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    for percent in (85, 75) if short == 8 else (85,):
        want = jaccard_classes(percent=percent)
        got = by_id(cj.coordinate_join(docs, percent=percent))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items() if i is not None} == want
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items() if i is not None)
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert got[UNIQUE.__iter__().__next__()]["n_shingles"] >= 0


def test_chains_and_hot_groups(spark):
    """A chain of copies, each near the next alone, beside one text that most rows repeat."""
    rng = random.Random(3)
    words = [f"c{i}" for i in range(200)]
    rows = []
    for step in range(12):
        rows.append((100 + step, " ".join(words)))
        at = step * 12
        words[at : at + 2] = [f"n{step}", f"m{step}"]
    rows += [(1000 + i, "the same text said again and again by nearly every row") for i in range(300)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in cj.coordinate_join(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert {got[100 + i] for i in range(12)} == {100} and {got[1000 + i] for i in range(300)} == {1000}


def test_empty_table(spark):
    assert cj.coordinate_join(spark.createDataFrame([], SCHEMA)).count() == 0
