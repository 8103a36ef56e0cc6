"""Points of few coordinates: boxes give the answers of the plain double loop and leave most pairs unmeasured."""

from __future__ import annotations

import numpy as np
import pytest

from loomtab.operators import pairs
from loomtab.operators.neighbors import Side, knn_join
from loomtab.operators.pairs import Points, Rule, Search, pair_distances


def _points(n: int) -> Points:
    rng = np.random.default_rng(7)
    vectors = np.stack([rng.normal(size=n), rng.integers(0, 2, n).astype(float)], axis=1)
    return Points(rng.permutation(n), vectors, rng.normal(size=n), np.arange(n) % 5)


@pytest.fixture
def looked_at(monkeypatch) -> list[int]:
    sizes, against = [], pairs._Strip.against

    def counted(self, points):
        sizes.append(len(points) * len(self.queries))
        return against(self, points)

    monkeypatch.setattr(pairs._Strip, "against", counted)
    return sizes


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev", "minkowski"])
def test_nearest_by_boxes(looked_at, metric):
    points = _points(12000)
    search = Search(points.vectors[:6000], points.exclude[:6000], Rule(metric, 3.0, k=4, excluding=True))
    search.see(points)
    assert sum(looked_at) < 0.5 * 6000 * 12000
    far = np.round(pair_distances(points.vectors[:300], points.vectors, metric, 3.0), 9)
    far[points.exclude[:300, None] == points.exclude[None, :]] = np.inf
    for row in range(300):
        assert search.ids[row].tolist() == points.ids[np.lexsort((points.ids, far[row]))[:4]].tolist()


@pytest.mark.parametrize("weighted", [False, True])
def test_sums_by_boxes(looked_at, weighted):
    points = _points(40000)
    search = Search(points.vectors[:4000], points.exclude[:4000], Rule("euclidean", 2.0, radius=1.0, weighted=weighted))
    search.see(points)
    assert sum(looked_at) < 0.5 * 4000 * 40000
    far = pair_distances(points.vectors[:300], points.vectors, "euclidean", 2.0)
    near = np.round(far, 9)
    inside = near <= 1.0
    assert search.sums[:300, 0].tolist() == inside.sum(1).tolist()
    assert np.allclose(search.sums[:300, 1], inside @ points.values, rtol=1e-10, atol=1e-9)
    if weighted:
        share = np.where(inside & (near > 0), 1.0 / np.where(far > 0, far, 1.0), 0.0)
        assert search.sums[:300, 2].tolist() == (near == 0).sum(1).tolist()
        assert np.allclose(search.sums[:300, 4], share.sum(1), rtol=1e-10, atol=0)
        assert np.allclose(search.sums[:300, 5], share @ points.values, rtol=1e-9, atol=1e-7)


def test_holes_and_equal_coordinates(spark):
    rows = spark.range(5000).selectExpr("id", "array(1.0D, if(id % 1000 = 0, double('NaN'), double(id % 7))) as v", "double(id) as y")
    side = Side(rows, "id", "v", "y", "id")
    found = {r["id"]: [n["id"] for n in r["neighbors"]] for r in knn_join(side, side, 3).collect()}
    assert len(found) == 5000 and found[1000] == []
    assert found[1] == [8, 15, 22] and found[8] == [1, 15, 22]
