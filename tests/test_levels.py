"""Manhattan neighbours by levels: the answers of the plain double loop, with most pairs never measured coordinate by coordinate."""

from __future__ import annotations

import numpy as np
import pytest

from loomtab.operators import pairs
from loomtab.operators.pairs import Points, Rule, Search, pair_distances


def _found(vectors: np.ndarray, asked: int, k: int) -> tuple[Search, np.ndarray]:
    ids = np.arange(len(vectors))[::-1].copy()
    search = Search(vectors[:asked], ids[:asked], Rule("manhattan", 2.0, k=k, excluding=True))
    for start in range(0, len(vectors), 5000):
        part = slice(start, start + 5000)
        search.see(Points(ids[part], vectors[part], np.zeros(len(ids[part])), ids[part]))
    far = np.round(pair_distances(vectors[:asked], np.nan_to_num(vectors, nan=np.inf), "manhattan", 2.0), 9)
    far[ids[:asked, None] == ids[None, :]] = np.inf
    return search, np.array([ids[np.lexsort((ids, row))[:k]] for row in far])


def test_most_pairs_are_settled_by_levels(monkeypatch):
    looked_at, take = [], pairs._Strip._take

    def counted(self, out, gap, spare):
        looked_at.append(out.size)
        return take(self, out, gap, spare)

    monkeypatch.setattr(pairs._Strip, "_take", counted)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(30000, 32))
    search, expected = _found(vectors, 200, 5)
    assert search.ids.tolist() == expected.tolist()
    assert sum(looked_at) < 0.25 * 200 * 30000 * 32


@pytest.mark.parametrize("kind", ["equal", "far out", "few values", "one coordinate differs", "holes", "wide"])
def test_odd_vectors(kind):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(6000, 12))
    if kind == "equal":
        vectors[:] = 0.25
    elif kind == "far out":
        vectors[::7] *= 1e6
        vectors[::11] += 1e4
    elif kind == "few values":
        vectors = np.round(vectors)
    elif kind == "one coordinate differs":
        vectors[:, 1:] = 3.0
    elif kind == "holes":
        vectors[5::9, 2] = np.nan
    else:
        vectors = rng.normal(size=(600, 1200))
    search, expected = _found(vectors, 60, 4)
    whole = np.isfinite(vectors[:60]).all(1)
    assert search.ids[whole].tolist() == expected[whole].tolist()
    assert np.isinf(search.far[~whole]).all()
