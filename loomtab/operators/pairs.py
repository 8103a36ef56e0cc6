"""Blocks of queries against blocks of points: what one task of a neighbour join computes.

Distances are screened first, in single precision and (euclidean) by one matrix product, under a level that allows
for every rounding error; pairs under it are measured again in double precision, coordinate by coordinate, so the
answers are those of the plain double loop. Manhattan distances, which no matrix product gives, are bounded from below
first, by coordinates rounded to a few levels: bytes, of which one instruction takes many. Tiles fit a core's cache and
nothing grows with the number of points. Vectors of few coordinates are put into boxes first (``boxes``), so that most tiles are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np

from loomtab.functions.distance import check_metric
from loomtab.operators.boxes import NARROW, Boxes

DIGITS = 9  # distances are compared after rounding, so summation order cannot reorder neighbours
STRIP, WIDE = 256, 2048  # queries and points of a tile
BOXED = 64  # queries of a tile whose points come by boxes
STAGE, SPARSE = 8, 16  # coordinates between two looks at a tile, and one pair in how many is few
PENDING = 65_536  # pairs measured together
MERGED = 1024  # pairs that wait to be merged, times k: the sooner a bound tightens, the fewer pairs follow
EPS, EPS64 = 2.0**-23, 2.0**-52
LEVELS, SUMMED = 31, 8  # levels of a coordinate less one, and coordinates whose levels add up within a byte
SPREAD = 2.5  # deviations from the mean at which the levels end
LONGEST = 1000  # coordinates whose levels add up within two bytes, twice
GATHERED, GATHER_SHARE = 4096, 4  # pairs whose vectors are laid side by side, and one pair in how many is too many for it

# Columns of the partial sums a block returns for a radius query.
SUMS = ["n", "total", "n_zero", "zero_total", "weight", "weighted_total"]


@dataclass(frozen=True)
class Rule:
    """What a query keeps: the k nearest, or sums over everything within a radius."""

    metric: str
    p: float
    k: int = 0
    radius: float = 0.0
    excluding: bool = False
    weighted: bool = True  # whether sums within a radius are also taken by inverse distance

    def check(self) -> None:
        check_metric(self.metric, self.p)
        if self.k < 0 or self.radius < 0 or (self.k == 0) == (self.radius == 0):
            raise ValueError("give either a positive number of neighbours or a positive radius")


@dataclass
class Points:
    """A block of train rows as arrays."""

    ids: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    exclude: np.ndarray
    boxes: Boxes | None = None
    sides: dict | None = None  # what strips about one centre need of a tile, worked out once

    def boxed(self) -> Boxes | None:
        """The boxes of the points, where these have few coordinates."""
        if self.boxes is None and 0 < self.vectors.shape[1] <= NARROW and len(self.ids) > WIDE:
            self.boxes = Boxes(self.vectors, self.values)
        return self.boxes

    def take(self, rows: np.ndarray) -> Points:
        return Points(self.ids[rows], self.vectors[rows], self.values[rows], self.exclude[rows])

    def tiles(self) -> Iterator[Points]:
        for start in range(0, len(self.ids), WIDE):
            part = slice(start, start + WIDE)
            yield Points(self.ids[part], self.vectors[part], self.values[part], self.exclude[part], sides={})


def pair_distances(queries: np.ndarray, points: np.ndarray, metric: str, p: float) -> np.ndarray:
    """All distances between two small blocks, summed coordinate by coordinate."""
    sides = ((x[:, None], y[None, :]) for x, y in zip(queries.T, points.T)) if len(queries) and len(points) else ()
    return _measured(sides, (len(queries), len(points)), metric, p)


def _measured(sides: Iterable[tuple[np.ndarray, np.ndarray]], shape: tuple[int, ...], metric: str, p: float) -> np.ndarray:
    """Distances from the two sides' values, coordinate by coordinate."""
    out = np.zeros(shape)
    for x, y in sides:
        gap = np.abs(x - y)
        if metric == "chebyshev":
            np.maximum(out, gap, out=out)
        elif metric == "manhattan":
            out += gap
        else:
            out += gap * gap if metric == "euclidean" else gap**p
    if metric == "euclidean":
        return np.sqrt(out)
    return out ** (1.0 / p) if metric == "minkowski" else out


class _Strip:
    """A strip of queries against tiles of points: ``screen`` gives, pair by pair, a number near a power of the distance.

    For the euclidean metric it is |b|^2 - 2ab of the vectors less ``centre``; |a|^2 stands in ``own``. A pair within
    ``bound`` is never over ``level(bound)``, and ``reach`` turns a screened number into an upper bound on the distance.
    """

    def __init__(self, queries: np.ndarray, exclude: np.ndarray, centre: np.ndarray, rule: Rule, double: bool = False):
        self.queries, self.exclude, self.centre, self.rule = queries, exclude, centre, rule
        self.kind, self.eps = (np.float64, EPS64) if double else (np.float32, EPS)
        self.power = {"euclidean": 2.0, "minkowski": rule.p}.get(rule.metric, 1.0)
        self.width = max(1, queries.shape[1])
        self.moved = queries - centre
        if rule.metric == "euclidean":
            self.own = np.einsum("ij,ij->i", self.moved, self.moved)
            self.left = np.hstack([-2.0 * self.moved, np.ones((len(queries), 1))]).astype(self.kind)
            self.size = np.sqrt(self.own)
        else:
            self.own = np.zeros(len(queries))
            self.left = np.ascontiguousarray(self.moved.T).astype(self.kind)
            self.size = np.abs(self.moved).max(1, initial=0.0)

    def against(self, points: np.ndarray) -> bool:
        """Takes a tile of points; False if its numbers do not fit the screen."""
        return self._against(self._side(points))

    def faces(self, tile: Points) -> bool:
        """``against`` the vectors of a tile, which may hold its side already."""
        if tile.sides is None:
            return self.against(tile.vectors)
        kind = self.rule.metric, self.kind
        if kind not in tile.sides:
            tile.sides[kind] = self._side(tile.vectors)
        return self._against(tile.sides[kind])

    def _side(self, points: np.ndarray) -> tuple[np.ndarray, float, float]:
        """The tile as the screen reads it, its reach from the centre and its largest number."""
        moved = points - self.centre
        if self.rule.metric == "euclidean":
            norms = np.einsum("ij,ij->i", moved, moved)
            right = np.vstack([moved.T, norms[None, :]]).astype(self.kind)
            far = np.sqrt(norms.max(initial=0.0))
        else:
            right = np.ascontiguousarray(moved.T).astype(self.kind)
            far = np.abs(moved).max(initial=0.0)
        return right, far, np.abs(points).max(initial=0.0)

    def _against(self, side: tuple[np.ndarray, float, float]) -> bool:
        self.right, far, largest = side
        raw = largest + np.abs(self.queries).max(initial=0.0) + 2.0 * np.abs(self.centre).max(initial=0.0)
        both = self.size + far
        # What casting and moving can change of a distance, and what rounding can change of the sums.
        self.shift = 2.0 * self.width * (self.eps * both + EPS64 * raw)
        self.slip = 2.0 * (self.width + 8) * self.eps * both * both if self.rule.metric == "euclidean" else np.zeros(len(both))
        self.share = 0.0 if self.rule.metric == "euclidean" else 2.0 * (self.width + 4.0 * self.power + 16.0) * self.eps
        most = 30.0 if self.kind is np.float32 else 280.0
        return bool(self.power * np.log10(max(2.0 * both.max(initial=0.0), 1.0)) + np.log10(self.width) < most)

    def screen(self) -> np.ndarray:
        if self.rule.metric == "euclidean":
            return self.left @ self.right
        out = np.zeros((self.left.shape[1], self.right.shape[1]), self.kind)
        gap, spare = np.empty_like(out), np.empty_like(out)
        for x, y in zip(self.left, self.right):
            np.subtract(x[:, None], y[None, :], out=gap)
            self._take(out, gap, spare)
        return out

    def _take(self, out: np.ndarray, gap: np.ndarray, spare: np.ndarray) -> None:
        """One coordinate's differences join the screened numbers, which never fall by it."""
        np.abs(gap, out=gap)
        if self.rule.metric == "chebyshev":
            np.maximum(out, gap, out=out)
            return
        if self.power > 1 and self.power == int(self.power) and self.power <= 4:
            np.copyto(spare, gap)
            for _ in range(int(self.power) - 1):
                gap *= spare
        elif self.power > 1:
            gap **= self.kind(self.power)
        out += gap

    def under(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the tile whose screened number is at most their query's level.

        Numbers only grow coordinate by coordinate, so once few pairs are left the rest is done for these alone.
        """
        width = self.right.shape[1]
        if self.rule.metric == "euclidean":
            return np.divmod(np.flatnonzero((self.screen() <= level[:, None]).ravel()), width)
        out = np.zeros((self.left.shape[1], width), self.kind)
        gap, spare = np.empty_like(out), np.empty_like(out)
        for at, (x, y) in enumerate(zip(self.left, self.right), 1):
            np.subtract(x[:, None], y[None, :], out=gap)
            self._take(out, gap, spare)
            if at % STAGE == 0 or at == self.width:
                alive = out <= level[:, None]
                if at == self.width or np.count_nonzero(alive) * SPARSE <= out.size:
                    break
        left = np.flatnonzero(alive.ravel())
        return self.among(level, *np.divmod(left, width), out.ravel()[left], at)

    def among(self, level: np.ndarray, rows: np.ndarray, cols: np.ndarray, found: np.ndarray | None = None, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Of some pairs, screened up to coordinate ``at``, those whose whole number is at most their query's level."""
        found = np.zeros(len(rows), self.kind) if found is None else found
        for start in range(at, self.width, STAGE):
            for x, y in zip(self.left[start : start + STAGE], self.right[start : start + STAGE]):
                some = x[rows] - y[cols]
                self._take(found, some, np.empty_like(some))
            keep = found <= level[rows]
            rows, cols, found = rows[keep], cols[keep], found[keep]
        return rows, cols

    def level(self, bound: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            top = (bound + self.shift) ** self.power * (1.0 + self.share) + self.slip - self.own
            return (top + 4.0 * self.eps * np.abs(top) + 1e-37).astype(self.kind)

    def reach(self, screened: np.ndarray) -> np.ndarray:
        whole = np.maximum(screened.astype(float) + self.own + self.slip, 0.0) * (1.0 + self.share)
        return whole ** (1.0 / self.power) + self.shift

    def excluded(self, points: Points) -> np.ndarray:
        return self.exclude[:, None] == points.exclude[None, :]

    def distances(self, points: Points, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Exact distances of some pairs, in the order of ``pair_distances``."""
        sides = ((x[rows], y[cols]) for x, y in zip(self.queries.T, points.vectors.T))
        return _measured(sides, (len(rows),), self.rule.metric, self.rule.p)


class _Levels:
    """Lower bounds on manhattan distances, from coordinates rounded to levels.

    Levels end at ``SPREAD`` deviations: cutting coordinates off there brings no two of them further apart. Of the sum over
    |a - b| = 2 max(a, b) - a - b only the larger levels depend on the pair, and rounding changes no more than each side's residue.
    """

    def __init__(self, vectors: np.ndarray):
        middle = vectors.mean(0)
        half = SPREAD * np.sqrt(np.square(vectors - middle).mean())
        self.low, self.step = middle - half, 2.0 * half / LEVELS
        self.usable = bool(vectors.shape[1] <= LONGEST and np.isfinite(half) and self.step > 1e-9 * (np.abs(middle).max() + half))

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(levels, one line a coordinate; half of every vector's levels and residues)."""
        place = np.clip((vectors - self.low) / self.step, 0.0, LEVELS)
        level = np.rint(place)
        half = (level.sum(1) + np.abs(place - level).sum(1)) / 2.0 + 1e-6 * vectors.shape[1]
        return np.ascontiguousarray(level.astype(np.uint8).T), half

    def under(self, queries: tuple[np.ndarray, np.ndarray], tile: tuple[np.ndarray, np.ndarray], most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may be within ``most`` of their query."""
        (left, half), (right, other) = queries, tile
        width, taken = right.shape[1], np.ceil(other)
        top = int(taken.max())
        sums = np.empty((left.shape[1], width), np.uint16)
        sums[:] = (top - taken).astype(np.uint16)
        some, larger = np.empty(sums.shape, np.uint8), np.empty(sums.shape, np.uint8)
        for start in range(0, len(left), SUMMED):
            np.maximum(left[start][:, None], right[start][None, :], out=some)
            for x, y in zip(left[start + 1 : start + SUMMED], right[start + 1 : start + SUMMED]):
                np.maximum(x[:, None], y[None, :], out=larger)
                some += larger
            sums += some
        level = np.clip(np.floor(most / (2.0 * self.step) + half) + top, 0, 65535).astype(np.uint16)
        return np.divmod(np.flatnonzero((sums <= level[:, None]).ravel()), width)


def finite(points: Points) -> Points:
    keep = np.isfinite(points.vectors).all(1)
    return points if keep.all() else Points(points.ids[keep], points.vectors[keep], points.values[keep], points.exclude[keep])


class Search:
    """Queries held by a task; ``see`` takes blocks of points one after the other, in any order."""

    def __init__(self, queries: np.ndarray, exclude: np.ndarray, rule: Rule):
        self.queries, self.exclude, self.rule, self.placed = queries, exclude, rule, None
        self.whole = np.isfinite(queries).all(1)  # a query with a hole is far from everything
        self.centre = queries[self.whole].mean(0) if self.whole.any() else np.zeros(queries.shape[1])
        if rule.k:
            self.far = np.full((len(queries), rule.k), np.inf)
            self.ids = np.zeros((len(queries), rule.k), np.int64)
            self.values = np.zeros((len(queries), rule.k))
        else:
            self.sums = np.zeros((len(queries), len(SUMS)))
        self.tiles: list[Points] = []
        levels = _Levels(queries[self.whole]) if rule.k and rule.metric == "manhattan" and self.whole.any() else None
        self.levels = levels if levels is not None and levels.usable else None

    def see(self, points: Points) -> None:
        points = finite(points)
        if not len(points.ids):
            return
        with np.errstate(invalid="ignore", over="ignore"):
            boxes = points.boxed()
            self.tiles = [] if boxes else list(points.tiles())
            rows = self._by_place() if boxes else np.flatnonzero(self.whole)
            size = BOXED if boxes else STRIP
            for start in range(0, len(rows), size):
                part = rows[start : start + size]
                # Sums need every distance within the radius, and points by boxes lie too close, so their screens keep double precision.
                centre = self.queries[part].mean(0) if boxes else self.centre
                strip = _Strip(self.queries[part], self.exclude[part], centre, self.rule, double=boxes is not None or not self.rule.k)
                (self._nearest if self.rule.k else self._within)(strip, part, points)

    def _by_place(self) -> np.ndarray:
        """The queries without holes, those of a box together."""
        if self.placed is None:
            rows = np.flatnonzero(self.whole)
            self.placed = rows[Boxes(self.queries[rows], leaf=BOXED).order] if len(rows) else rows
        return self.placed

    def _tiles(self, strip: _Strip, points: Points) -> Iterator[tuple[float, Points]]:
        """Tiles with the least distance any of their points, or of those after them, may have."""
        if points.boxes is None:
            yield from ((0.0, tile) for tile in self.tiles)
        else:
            for gap, rows in points.boxes.nearest(strip.queries, self.rule.metric, self.rule.p, WIDE):
                yield gap, points.take(rows)

    def _nearest(self, strip: _Strip, part: np.ndarray, points: Points) -> None:
        bound = np.round(self.far[part, -1], DIGITS)
        # A p-norm over 2 is at least the euclidean norm over width^(1/2 - 1/p), and that one is a matrix product.
        wide = strip.width ** (0.5 - 1.0 / self.rule.p) if self.rule.metric == "minkowski" and self.rule.p > 2 else 0.0
        plain = _Strip(strip.queries, strip.exclude, strip.centre, replace(self.rule, metric="euclidean"), strip.kind is np.float64) if wide else None
        own = self.levels.of(strip.queries) if self.levels and points.boxes is None else None
        waiting: list[tuple[np.ndarray, ...]] = []
        for gap, tile in self._tiles(strip, points):
            if gap * (1.0 - 1e-12) > bound.max() + 10.0**-DIGITS:
                break
            found = self._near_levels(strip, own, tile, bound) if own else None
            rows, cols = self._near(strip, tile, bound, plain, wide) if found is None else found
            for start in range(0, len(rows), PENDING):
                r, c = rows[start : start + PENDING], cols[start : start + PENDING]
                far = strip.distances(tile, r, c)
                keep = np.isfinite(far) & (np.round(far, DIGITS) <= bound[r])
                if self.rule.excluding:
                    keep &= strip.exclude[r] != tile.exclude[c]
                r, c = r[keep], c[keep]
                waiting.append((r, far[keep], tile.ids[c], tile.values[c]))
                if sum(len(w[0]) for w in waiting) > MERGED * self.rule.k:
                    bound = np.minimum(bound, self._merge(part, waiting))
                    waiting = []
        self._merge(part, waiting)

    def _near_levels(self, strip: _Strip, own: tuple[np.ndarray, np.ndarray], tile: Points, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs of a tile that may lie within ``bound`` by their levels and then by their vectors; None where too many are left."""
        if np.isinf(bound).any():
            return None
        if "levels" not in tile.sides:
            tile.sides["levels"] = self.levels.of(tile.vectors)
        most = bound * (1.0 + 1e-12) + 10.0**-DIGITS
        rows, cols = self.levels.under(own, tile.sides["levels"], most)
        if len(rows) * GATHER_SHARE > len(bound) * len(tile.ids):
            return None
        keep = np.empty(len(rows), bool)
        for start in range(0, len(rows), GATHERED):
            part = slice(start, start + GATHERED)
            gap = strip.queries[rows[part]]
            gap -= tile.vectors[cols[part]]
            whole = np.abs(gap, out=gap).sum(1)
            keep[part] = whole <= most[rows[part]] + 1e-12 * whole
        return rows[keep], cols[keep]

    def _near(self, strip: _Strip, tile: Points, bound: np.ndarray, plain: _Strip | None, wide: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a tile that may lie within ``bound``, which is tightened where it is still infinite."""
        if not strip.faces(tile):
            return np.divmod(np.arange(len(bound) * len(tile.ids)), len(tile.ids))
        open_rows = np.flatnonzero(np.isinf(bound))
        if not len(open_rows):
            most = bound * (1.0 + 1e-12) + 10.0**-DIGITS
            if plain is not None and plain.faces(tile):
                rows, cols = plain.under(plain.level(wide * most * (1.0 + 1e-12)))
                if len(rows) * SPARSE <= len(bound) * len(tile.ids):
                    return strip.among(strip.level(most), rows, cols)
            return strip.under(strip.level(most))
        screened = strip.screen()
        if len(tile.ids) >= self.rule.k:
            first = screened[open_rows]
            if self.rule.excluding:
                first[strip.exclude[open_rows, None] == tile.exclude[None, :]] = np.inf
            least = np.full(len(bound), np.inf)
            least[open_rows] = np.partition(first, self.rule.k - 1, axis=1)[:, self.rule.k - 1]
            bound[open_rows] = strip.reach(least)[open_rows] * (1.0 + 1e-12) + 10.0**-DIGITS
        level = strip.level(bound * (1.0 + 1e-12) + 10.0**-DIGITS)
        return np.divmod(np.flatnonzero((screened <= level[:, None]).ravel()), len(tile.ids))

    def _merge(self, part: np.ndarray, waiting: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """Found pairs join the k nearest of their queries; equal distances go to the smaller key."""
        k = self.rule.k
        if waiting and sum(len(w[0]) for w in waiting):
            found, far, ids, values = (np.concatenate([w[i] for w in waiting]) for i in range(4))
            touched, at = np.unique(found, return_inverse=True)
            here = part[touched]
            held = np.isfinite(self.far[here])
            row = np.concatenate([np.repeat(np.arange(len(here)), held.sum(1)), at])
            far = np.concatenate([self.far[here][held], far])
            ids = np.concatenate([self.ids[here][held], ids])
            values = np.concatenate([self.values[here][held], values])
            order = np.lexsort((ids, np.round(far, DIGITS), row))
            row, far, ids, values = row[order], far[order], ids[order], values[order]
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(here)))[row]
            keep = place < k
            to = (here[row[keep]], place[keep])
            self.far[to], self.ids[to], self.values[to] = far[keep], ids[keep], values[keep]
        return np.round(self.far[part, -1], DIGITS)

    def _within(self, strip: _Strip, part: np.ndarray, points: Points) -> None:
        if points.boxes is not None and (rest := self._boxes_within(strip, part, points)) is not None:
            points = rest
        for tile in self.tiles if points.boxes is None and self.tiles else points.tiles():
            if self.rule.metric == "euclidean" and strip.faces(tile):
                self._within_screened(strip, part, tile)
            else:
                self._within_exact(strip, part, tile)

    def _boxes_within(self, strip: _Strip, part: np.ndarray, points: Points) -> Points | None:
        """Adds up the boxes that lie within the radius as a whole; returns the points that are left to measure."""
        rule, boxes = self.rule, points.boxes
        if rule.excluding or rule.weighted and rule.metric != "euclidean" or not np.isfinite(points.values).all():
            return None
        whole, measured = boxes.around(strip.queries, rule.radius, 1e-8 * max(1.0, rule.radius), rule.metric, rule.p, rule.weighted)
        self.sums[part, 0] += boxes.n[whole].sum()
        self.sums[part, 1] += boxes.total[whole].sum()
        if rule.weighted:
            self.sums[part, 4:6] += boxes.inverse_sums(strip.queries, whole)
        return points.take(boxes.rows(measured)) if len(measured) else points.take(measured)

    def _within_exact(self, strip: _Strip, part: np.ndarray, tile: Points) -> None:
        far = pair_distances(strip.queries, tile.vectors, self.rule.metric, self.rule.p)
        if self.rule.excluding:
            far[strip.excluded(tile)] = np.inf
        near = np.round(far, DIGITS)
        inside = near <= self.rule.radius
        self._add(part, inside & (near > 0), far, tile, inside & (near == 0))

    def _within_screened(self, strip: _Strip, part: np.ndarray, tile: Points) -> None:
        """Pairs near the radius and near zero are measured again; for the others the screened distance is exact to 1e-9."""
        square = strip.screen()
        square += strip.own[:, None]
        slack, shift, slip = 2.0 * 10.0**-DIGITS, strip.shift[:, None], strip.slip[:, None]
        upper = (self.rule.radius + slack + shift) ** 2 + slip
        lower = np.maximum(self.rule.radius - slack - shift, 0.0) ** 2 - slip
        tiny = 1e9 * slip + (1e9 * shift) ** 2
        unsure = (square <= upper) & ((square >= lower) | (square <= tiny))
        sure = (square < lower) & (square > tiny)
        if self.rule.excluding:
            other = ~strip.excluded(tile)
            sure &= other
            unsure &= other
        again = np.flatnonzero(unsure.ravel())
        if len(again) * 8 > square.size:
            return self._within_exact(strip, part, tile)
        far = np.sqrt(np.maximum(square, 0.0))
        rows, cols = np.divmod(again, len(tile.ids))
        exact = strip.distances(tile, rows, cols)
        near = np.round(exact, DIGITS)
        inside = near <= self.rule.radius
        far[rows, cols] = exact
        sure[rows, cols] = inside & (near > 0)
        zero = np.zeros_like(sure)
        zero[rows, cols] = inside & (near == 0)
        self._add(part, sure, far, tile, zero)

    def _add(self, part: np.ndarray, apart: np.ndarray, far: np.ndarray, tile: Points, zero: np.ndarray) -> None:
        touching = zero.any()
        inside = (apart | zero if touching else apart).astype(float)
        self.sums[part, 0] += inside.sum(1)
        self.sums[part, 1] += inside @ tile.values
        if not self.rule.weighted:
            return
        weight = np.zeros_like(far)
        np.divide(1.0, far, out=weight, where=apart)
        if touching:
            self.sums[part, 2] += zero.sum(1)
            self.sums[part, 3] += zero @ tile.values
        self.sums[part, 4] += weight.sum(1)
        self.sums[part, 5] += weight @ tile.values
