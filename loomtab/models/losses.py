"""Loss and gradient of each model family on one block of rows.

Each family turns (X, y, weights, theta) into the weighted loss sum and its gradient and
scores rows from theta. Blocks are Arrow batches inside tasks; sums over blocks and
partitions give the exact full-table gradient.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FACTORS = 512  # values from 1 to 2 whose product stays within a double
UNITS, LEAST_STRIP = 1 << 14, 64  # hidden units of the rows that pass together, and rows there at least


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Linear:
    """Linear scores with a logistic, softmax, squared-hinge, squared, Huber or squared-tube loss.

    theta holds, per output, one weight per feature and an intercept last.
    """

    features: int
    loss: str
    outputs: int = 1
    margin: float = 0.1  # tube half-width or Huber turning point

    @property
    def size(self) -> int:
        return (self.features + 1) * self.outputs

    def start(self, seed: int = 0) -> np.ndarray:
        return np.zeros(self.size)

    def penalised(self) -> np.ndarray:
        mask = np.ones((self.outputs, self.features + 1))
        mask[:, -1] = 0.0
        return mask.ravel()

    def scores(self, x: np.ndarray, theta: np.ndarray) -> np.ndarray:
        table = theta.reshape(self.outputs, -1)
        return x @ table[:, :-1].T + table[:, -1]

    def probabilities(self, x: np.ndarray, theta: np.ndarray) -> np.ndarray:
        z = self.scores(x, theta)
        if self.outputs > 1:
            return _softmax(z)
        p = _sigmoid(z[:, 0])
        return np.column_stack([1.0 - p, p])

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope, _ = self._parts(self.scores(x, theta), y, w)
        return value, np.column_stack([slope.T @ x, slope.sum(0)]).ravel()

    def curvature(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Second derivatives of the loss sum, size x size."""
        bend = self._parts(self.scores(x, theta), y, w)[2]
        wide = np.column_stack([x, np.ones(len(x))])
        out = np.empty((self.outputs, wide.shape[1], self.outputs, wide.shape[1]))
        for a in range(self.outputs):
            for b in range(a, self.outputs):
                out[a, :, b, :] = (wide * bend(a, b)[:, None]).T @ wide
                out[b, :, a, :] = out[a, :, b, :]
        return out.reshape(self.size, self.size)

    def _parts(self, z: np.ndarray, y: np.ndarray, w: np.ndarray):
        """Loss sum, its slope in every score, and the second derivative between two scores."""
        if self.loss == "softmax":
            p = _softmax(z)
            at = np.arange(len(y)), y.astype(int)
            value = -np.sum(w * np.log(np.maximum(p[at], 1e-300)))
            slope = p * w[:, None]
            slope[at] -= w
            return float(value), slope, lambda a, b: w * p[:, a] * ((a == b) - p[:, b])
        value, slope, bend = self._curves(z[:, 0], y)
        return float(np.sum(w * value)), (w * slope)[:, None], lambda a, b: w * bend

    def _curves(self, z: np.ndarray, y: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss of every score with its first and second derivative."""
        miss = z - y
        if self.loss == "logistic":
            p = _sigmoid(z)
            value, slope, bend = np.logaddexp(0.0, z) - y * z, p - y, p * (1.0 - p)
        elif self.loss == "squared_hinge":
            side = 2.0 * y - 1.0
            gap = np.maximum(0.0, 1.0 - side * z)
            value, slope, bend = gap * gap, -2.0 * side * gap, 2.0 * (gap > 0)
        elif self.loss == "squared":
            value, slope, bend = 0.5 * miss * miss, miss, np.ones_like(miss)
        elif self.loss == "huber":
            near = np.abs(miss) <= self.margin
            value = np.where(near, 0.5 * miss * miss, self.margin * (np.abs(miss) - 0.5 * self.margin))
            slope, bend = np.clip(miss, -self.margin, self.margin), near.astype(float)
        elif self.loss == "tube":
            over = np.sign(miss) * np.maximum(0.0, np.abs(miss) - self.margin)
            value, slope, bend = over * over, 2.0 * over, 2.0 * (over != 0)
        else:
            raise ValueError(f"unknown loss {self.loss!r}")
        return value, slope, bend

    def sums(self, z: np.ndarray, y: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(loss sum by line, slope, bend) of scores whose rows all have the target ``y``, one line a model.

        The logistic loss adds the logarithms up as that of products of ``FACTORS`` values from 1 to 2.
        """
        if self.loss != "logistic" or y not in (0.0, 1.0):
            value, slope, bend = self._curves(z, y)
            return value.sum(axis=1), slope, bend
        against = z if y == 0.0 else -z
        small = np.abs(against)
        np.exp(np.negative(small, out=small), out=small)
        whole = 1.0 + small
        loss = np.log(np.multiply.reduceat(whole, np.arange(0, z.shape[1], FACTORS), axis=1)).sum(axis=1)
        large = np.divide(1.0, whole, out=whole)
        small *= large
        slope = np.where(against >= 0, large, small)
        bend = np.multiply(small, large, out=large)
        loss += np.maximum(against, 0.0, out=small).sum(axis=1)
        return loss, slope if y == 0.0 else np.negative(slope, out=slope), bend


@dataclass(frozen=True)
class Network:
    """One hidden layer. ``output`` is logistic (two classes), softmax, or identity (regression)."""

    features: int
    hidden: int
    outputs: int
    activation: str = "tanh"
    output: str = "softmax"

    @property
    def size(self) -> int:
        return (self.features + 1) * self.hidden + (self.hidden + 1) * self.outputs

    def start(self, seed: int = 0) -> np.ndarray:
        """Uniform weights within sqrt(6 / (features + hidden)), four times that for logistic units."""
        reach = np.sqrt(6.0 / (self.features + self.hidden)) * (4.0 if self.activation == "logistic" else 1.0)
        return np.random.default_rng(seed).uniform(-reach, reach, self.size)

    def layers(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both layers as (inputs + 1) x units tables whose last row is the intercept."""
        cut = (self.features + 1) * self.hidden
        return theta[:cut].reshape(self.features + 1, -1), theta[cut:].reshape(self.hidden + 1, -1)

    def penalised(self) -> np.ndarray:
        first = np.ones((self.features + 1, self.hidden))
        second = np.ones((self.hidden + 1, self.outputs))
        first[-1] = second[-1] = 0.0
        return np.concatenate([first.ravel(), second.ravel()])

    def _forward(self, x: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = self.layers(theta)
        inner = x @ first[:-1] + first[-1]
        units = np.tanh(inner) if self.activation == "tanh" else _sigmoid(inner)
        return units, units @ second[:-1] + second[-1]

    def scores(self, x: np.ndarray, theta: np.ndarray) -> np.ndarray:
        return self._forward(x, theta)[1]

    def probabilities(self, x: np.ndarray, theta: np.ndarray) -> np.ndarray:
        z = self.scores(x, theta)
        if self.output == "softmax":
            return _softmax(z)
        if self.output == "identity":
            return z
        p = _sigmoid(z[:, 0])
        return np.column_stack([1.0 - p, p])

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Two numbers a row and unit are held; what is done number by number is done in place, by strips that fit a core's cache.

        Products and sums over rows are those of the whole block, so strips change no bit of the result.
        """
        first, second = self.layers(theta)
        strip = max(LEAST_STRIP, UNITS // self.hidden)
        strips = [slice(start, start + strip) for start in range(0, len(x), strip)]
        units = x @ first[:-1]
        for part in strips:
            here = np.add(units[part], first[-1], out=units[part])
            if self.activation == "tanh":
                np.tanh(here, out=here)
            else:
                here[:] = _sigmoid(here)
        value, slope = self._slope(units @ second[:-1] + second[-1], y, w)
        inner = slope @ second[:-1].T
        for part in strips:
            here = units[part]
            inner[part] *= 1.0 - here * here if self.activation == "tanh" else here * (1.0 - here)
        top = np.vstack([x.T @ inner, inner.sum(0)])
        bottom = np.vstack([units.T @ slope, slope.sum(0)])
        return value, np.concatenate([top.ravel(), bottom.ravel()])

    def _slope(self, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted loss sum of scores, and its slope in each of them."""
        if self.output == "softmax":
            p = _softmax(z)
            value = -np.sum(w * np.log(np.maximum(p[np.arange(len(y)), y.astype(int)], 1e-300)))
            slope = p.copy()
            slope[np.arange(len(y)), y.astype(int)] -= 1.0
        elif self.output == "logistic":
            value = np.sum(w * (np.logaddexp(0.0, z[:, 0]) - y * z[:, 0]))
            slope = _sigmoid(z) - y[:, None]
        else:
            slope = z - y[:, None]
            value = 0.5 * np.sum(w * slope[:, 0] ** 2)
        return float(value), slope * w[:, None]
