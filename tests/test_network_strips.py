"""The gradient of a network over many rows: the sums of the plain formula, worked out in place strip by strip."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from loomtab.models.losses import Network


def _plain(net: Network, x, y, w, theta):
    first, second = net.layers(theta)
    units = x @ first[:-1] + first[-1]
    units = np.tanh(units) if net.activation == "tanh" else 1.0 / (1.0 + np.exp(-units))
    z = units @ second[:-1] + second[-1]
    if net.output == "softmax":
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        value, slope = -np.sum(w * np.log(p[np.arange(len(y)), y.astype(int)])), p - np.eye(net.outputs)[y.astype(int)]
    elif net.output == "logistic":
        value, slope = np.sum(w * (np.logaddexp(0.0, z[:, 0]) - y * z[:, 0])), 1.0 / (1.0 + np.exp(-z)) - y[:, None]
    else:
        value, slope = 0.5 * np.sum(w * (z[:, 0] - y) ** 2), z - y[:, None]
    slope = slope * w[:, None]
    inner = (slope @ second[:-1].T) * (1.0 - units**2 if net.activation == "tanh" else units * (1.0 - units))
    parts = x.T @ inner, inner.sum(0)[None], units.T @ slope, slope.sum(0)[None]
    return value, np.concatenate([p.ravel() for p in parts])


@pytest.mark.parametrize("net", [Network(3, h, o, a, k) for h in (1, 70) for a in ("tanh", "logistic") for o, k in ((1, "logistic"), (3, "softmax"), (1, "identity"))], ids=str)
def test_strips_add_up(net):
    rng = np.random.default_rng(1)
    x, w, theta = rng.normal(size=(1500, 3)), rng.uniform(0.5, 2.0, 1500), net.start(4)
    y = rng.integers(0, 3 if net.outputs == 3 else 2, 1500).astype(float)
    value, gradient = net.loss_and_gradient(x, y, w, theta)
    expected, slope = _plain(net, x, y, w, theta)
    assert value == pytest.approx(expected, rel=1e-12)
    assert gradient == pytest.approx(slope, rel=1e-9, abs=1e-9)


def test_two_numbers_a_row_and_unit_are_held():
    rng = np.random.default_rng(2)
    net, x = Network(2, 64, 1, "tanh", "logistic"), rng.normal(size=(40000, 2))
    y, w, theta = rng.integers(0, 2, 40000).astype(float), np.ones(40000), net.start(1)
    tracemalloc.start()
    net.loss_and_gradient(x, y, w, theta)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * 40000 * 64 * 8
