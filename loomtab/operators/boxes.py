"""Points of few coordinates cut into boxes, which rule out or add up most pairs of a block without measuring them.

A box farther than a bound holds no neighbour, and one wholly within a radius is known by its sums. Sums of inverse
distances over a box well apart from the queries come from Chebyshev moments: the kernel is smooth there, and 16 nodes a
coordinate leave an error near rounding (Fong and Darve, "The black-box fast multipole method", J. Comput. Phys. 2009).
"""

from __future__ import annotations

import numpy as np

NARROW = 4  # coordinates up to which boxes rule out enough to pay
LEAF = 256
NODES = 16  # interpolation nodes a coordinate
APART = 3.0  # a box is well apart from this many of its half-widths on: the error falls by 6 a node


def gaps(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray, metric: str, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance between points of the boxes and points of the other box."""
    near = np.maximum(0.0, np.maximum(low - other_high, other_low - high))
    far = np.maximum(high - other_low, other_high - low)
    if metric == "chebyshev":
        return near.max(1), far.max(1)
    power = {"manhattan": 1.0, "euclidean": 2.0}.get(metric, p)
    return tuple((side**power).sum(1) ** (1.0 / power) for side in (near, far))


class Boxes:
    """A tree of boxes halved at the middle of their widest side; ``order`` lists the rows so that a box's are a run."""

    def __init__(self, vectors: np.ndarray, values: np.ndarray | None = None, leaf: int = LEAF):
        order, spans, left, low, high = np.arange(len(vectors)), [(0, len(vectors))], [0], [], []
        for at, (start, end) in enumerate(spans):  # spans grows
            rows = order[start:end]
            x = vectors[rows]
            low.append(x.min(0)), high.append(x.max(0))
            wide = int((high[-1] - low[-1]).argmax())
            if end - start > leaf and high[-1][wide] > low[-1][wide]:
                half = (end - start) // 2
                order[start:end] = rows[np.argpartition(x[:, wide], half)]
                left[at] = len(spans)
                spans += [(start, start + half), (start + half, end)]
                left += [0, 0]
        self.order, self.left, self.low, self.high = order, np.array(left), np.array(low), np.array(high)
        self.start, self.end = np.array(spans).T
        self.leaves = np.flatnonzero(self.left == 0)
        self.half = (self.high - self.low).max(1) / 2.0
        self.nodes = NODES ** (self.high > self.low).sum(1)
        self.vectors, self.values, self.moments = vectors[order], None, {}
        if values is not None:
            self.values = values[order]
            sums = np.concatenate([[0.0], np.cumsum(self.values)])
            self.n, self.total = self.end - self.start, sums[self.end] - sums[self.start]

    def rows(self, boxes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.order[s:e] for s, e in zip(self.start[boxes], self.end[boxes])])

    def nearest(self, queries: np.ndarray, metric: str, p: float, most: int):
        """(least distance, rows) of runs of up to ``most`` rows, by rising distance of their boxes from the queries' box."""
        near, _ = gaps(self.low[self.leaves], self.high[self.leaves], queries.min(0), queries.max(0), metric, p)
        by = np.argsort(near, kind="stable")
        cut = (np.cumsum((self.end - self.start)[self.leaves[by]]) - 1) // most
        for part in np.split(by, np.flatnonzero(np.diff(cut)) + 1):
            yield near[part[0]], self.rows(self.leaves[part])

    def around(self, queries: np.ndarray, radius: float, slack: float, metric: str, p: float, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
        """Boxes wholly within the radius of all queries (well apart from them too, if weighted), and leaves to be measured."""
        low, high, whole, measured, open_ = queries.min(0), queries.max(0), [], [], np.zeros(1, int)
        while len(open_):
            near, far = gaps(self.low[open_], self.high[open_], low, high, metric, p)
            inside = far < radius - slack
            if weighted:
                inside &= (near > slack) & (near >= APART * self.half[open_]) & (self.nodes[open_] < self.end[open_] - self.start[open_])
            whole.append(open_[inside])
            rest = open_[~inside & (near <= radius + slack)]
            measured.append(rest[self.left[rest] == 0])
            rest = self.left[rest[self.left[rest] > 0]]
            open_ = np.concatenate([rest, rest + 1])
        return np.concatenate(whole), np.concatenate(measured)

    def inverse_sums(self, queries: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """[query, (sum of 1 / distance, sum of value / distance)] over the points of boxes well apart from the queries."""
        if not len(boxes):
            return np.zeros((len(queries), 2))
        points, shares = (np.concatenate(side) for side in zip(*(self._moments(int(b)) for b in boxes)))
        square = sum((q[:, None] - t[None, :]) ** 2 for q, t in zip(queries.T, points.T))
        return (1.0 / np.sqrt(square)) @ shares

    def _moments(self, box: int) -> tuple[np.ndarray, np.ndarray]:
        """Interpolation nodes of a box, and what its points' ones and values weigh at each of them."""
        if box not in self.moments:
            part = slice(self.start[box], self.end[box])
            x, low, high = self.vectors[part], self.low[box], self.high[box]
            angles = (np.arange(NODES) + 0.5) * np.pi / NODES
            spread = np.cos(np.outer(angles, np.arange(NODES))) * np.where(np.arange(NODES) == 0, 1.0, 2.0) / NODES
            nodes, shares = [], np.stack([np.ones(len(x)), self.values[part]])[:, :, None]  # [what, point, node so far]
            for i in range(x.shape[1]):
                middle, half = (low[i] + high[i]) / 2.0, (high[i] - low[i]) / 2.0
                nodes.append(middle + half * np.cos(angles) if half else np.array([middle]))
                if half:
                    here = np.cos(np.arccos(np.clip((x[:, i] - middle) / half, -1.0, 1.0))[:, None] * np.arange(NODES)) @ spread.T
                    shares = (shares[:, :, :, None] * here[None, :, None, :]).reshape(2, len(x), -1)
            grid = np.stack([g.ravel() for g in np.meshgrid(*nodes, indexing="ij")], axis=1)
            self.moments[box] = grid, shares.sum(1).T
        return self.moments[box]
