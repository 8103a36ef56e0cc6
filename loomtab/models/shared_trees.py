"""Histogram trees and their ensembles, many models trained by the same reads of the data.

Features are binned once by quantile edges. A trainer is a coroutine: it asks for sums over the rows (histograms of a
tree level by node, feature and bin; leaf ranges and counts; errors), receives them and advances its model. All trainers
of a search, a forest or a cross-validation ask together, so one read answers every open model. Rows know a model only by
its arrays, and models are small, so a read sends models out and brings fixed-size sums back.

There are two ways to answer, and both give the same sums. Where a part of the table (all rows, or one horizon of a
forecast) has at most ``LOCAL_ROWS`` rows, its models are dealt in bundles to tasks that hold the part and answer their own
trainers without further jobs. A larger part is condensed first for models that ask only for counts of classes or sums of
the target: rows of equal bins become one weighted row, so what is left no longer grows with the table once every cell of
bins is taken. What stays too large is packed into blocks of rows and read by one distributed pass per question, partial
sums added up by executors; trees are followed by the distinct bins of a block, and where those are many, row states are
written forward every ``FORWARD`` rounds so that a pass replays few trees.

Every random choice (bootstrap weights, feature subsets, thresholds) is a function of row key, seed and node.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Generator, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from loomtab.models.arrays import FAN_IN, matrix, partition_totals, summed
from loomtab.models.base import TableModel, class_at, class_index, sorted_classes
from loomtab.session import checkpointed

BINS = 64
LOCAL_ROWS = 200_000
BUNDLE = 6
FORWARD = 20
PACKED = 262_144  # rows of a block
TASK_ROWS = 500_000
FEW_CELLS = 0.05  # distinct bins a row under which replaying trees over them costs less than keeping row states
HELD_CELLS = 100_000
REFINE = 128
REFINEMENTS = 4
LOSSES = ("squared", "lad", "huber", "quantile")
PENALTIES = ("linear", "square", "exponential")


@dataclass
class Tree:
    """Nodes in arrays: a row goes left where bin <= cut; feature -1 marks a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for v in values:
            self.feature.append(-1), self.cut.append(0), self.left.append(0), self.value.append(v)
        return self.left[node], self.left[node] + 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        rows = np.arange(len(bins))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            node[rows] = left[at] + (bins[rows, feature[at]] > cut[at])
        return node

    def answer(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass
class Spec:
    """One model to train. ``part`` and ``holdout`` choose its rows; -1 takes all parts and holds no fold out."""

    kind: str = "tree"  # tree, boost, samme or r2
    depth: int = 5
    rounds: int = 1
    rate: float = 1.0
    loss: str = "squared"
    quantile: float = 0.9
    classes: int = 0  # 0: regression
    splitter: str = "best"
    features: int = 0  # features tried at a node, 0 for all
    bootstrap: int = -1  # number of the bootstrap sample, -1 for the rows themselves
    seed: int = 0
    part: int = -1
    holdout: int = -1

    def __post_init__(self):
        known = {"kind": ("tree", "boost", "samme", "r2"), "splitter": ("best", "random"), "loss": PENALTIES if self.kind == "r2" else LOSSES}
        for name, allowed in known.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name}={getattr(self, name)!r}: choose one of {', '.join(allowed)}")


@dataclass
class Fitted:
    """Start value, trees and their weights; R2 members also know their largest error."""

    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    worst: list[float] = field(default_factory=list)


@dataclass
class Ask:
    """A question about the rows: its kind and parameters, beside the model so far and the tree being grown."""

    what: str
    tree: Tree | None = None
    nodes: list[int] = field(default_factory=list)
    shift: float = 0.0
    turn: float = 0.0
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    size: int = 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Draws in [0, 1) that depend on key and salt alone."""
    return (_mixed(keys.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))) >> np.uint64(11)) * 2.0**-53


def poisson(keys: np.ndarray, salt: int) -> np.ndarray:
    """Poisson(1) draws: bootstrap weights."""
    edges = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 20)])))
    return np.searchsorted(edges, uniform(keys, salt), "right").astype(float)


# --- answers -------------------------------------------------------------------------------------------------------


@dataclass
class Block:
    """Rows as arrays: bins, target, fold, part, hash of the key, and written states by model with the trees they hold.

    With ``cell``, bins are those of distinct cells and it names the cell of each row. Condensed rows stand for ``n`` rows
    each, of the bootstrap sample ``boot`` (-1: the rows themselves).
    """

    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    part: np.ndarray
    key: np.ndarray
    states: np.ndarray | None = None
    cell: np.ndarray | None = None
    n: np.ndarray | None = None
    boot: np.ndarray | None = None


class View:
    """A model's rows of a block, with the state its trees have brought them to: the score, or the log of the weight."""

    def __init__(self, block: Block, spec: Spec, number: int = 0, applied: int = 0):
        keep = np.ones(len(block.y), bool)
        if spec.part >= 0:
            keep &= block.part == spec.part
        if spec.holdout >= 0:
            keep &= block.fold != spec.holdout
        base = np.ones(len(block.y)) if block.n is None else block.n
        if block.boot is not None:
            keep &= block.boot == _sample(spec)
        elif spec.bootstrap >= 0:
            base = poisson(block.key, _sample(spec))
            keep &= base > 0
        self.spec, self.y, self.base = spec, block.y[keep], base[keep]
        self.bins, self.cell = (block.bins[keep], None) if block.cell is None else (block.bins, block.cell[keep])
        # Rows of equal bins have equal scores, so a boosted state without written rows is kept by cell.
        self.by_cell = self.cell is not None and spec.kind == "boost" and not applied
        self.state = block.states[keep, number].copy() if applied else np.zeros(len(self.bins) if self.by_cell else len(self.y))
        self.applied, self.started = applied, applied > 0
        self.tree, self.leaf = None, None

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values by cell as values by row."""
        return values if self.cell is None else values[self.cell]

    def advance(self, model: Fitted) -> None:
        """Take the trees the state does not hold yet."""
        if not self.started and self.spec.kind == "boost":
            self.state += model.start
            self.started = bool(model.weights) or model.start != 0
        for i in range(self.applied, len(model.weights)):
            tree, weight = model.trees[i], model.weights[i]
            answer = np.array(tree.value)[self.leaves(tree)]
            if not self.by_cell:
                answer = self.spread(answer)
            if self.spec.kind == "boost":
                self.state += weight * answer
            elif self.spec.kind == "samme":
                self.state += weight * (answer != self.y)
            elif self.spec.kind == "r2":
                self.state -= weight * (1.0 - penalty(self.spec.loss, np.abs(self.y - answer), model.worst[i]))
            self.started = True
        self.applied = len(model.weights)

    def leaves(self, tree: Tree) -> np.ndarray:
        """Leaf of every row, or of every cell; a tree that has grown a level since is followed from where they are."""
        if self.tree is not tree:
            self.tree, self.leaf = tree, tree.leaf_of(self.bins)
        else:
            feature = np.array(tree.feature)
            rows = np.flatnonzero(feature[self.leaf] >= 0)
            while len(rows):
                at = self.leaf[rows]
                self.leaf[rows] = np.array(tree.left)[at] + (self.bins[rows, feature[at]] > np.array(tree.cut)[at])
                rows = rows[feature[self.leaf[rows]] >= 0]
        return self.leaf

    def gap(self) -> np.ndarray:
        return self.y - (self.spread(self.state) if self.by_cell else self.state)

    def weight(self, shift: float) -> np.ndarray:
        return self.base if self.spec.kind in ("tree", "boost") else self.base * np.exp(self.state - shift)

    def targets(self, ask: Ask) -> np.ndarray:
        """What the next tree is fitted to, one row a target: shares of classes, the target or the loss's slope."""
        if self.spec.classes:
            return (self.y == np.arange(self.spec.classes)[:, None]).astype(float)
        if self.spec.kind != "boost":
            return self.y[None]
        gap = self.gap()
        if self.spec.loss == "huber":
            gap = np.clip(gap, -ask.turn, ask.turn)
        elif self.spec.loss == "lad":
            gap = np.sign(gap)
        elif self.spec.loss == "quantile":
            gap = np.where(gap > 0, self.spec.quantile, self.spec.quantile - 1.0)
        return gap[None]

    def answer(self, ask: Ask) -> np.ndarray:
        if ask.what == "level":
            return self.level(ask)
        weight = self.weight(ask.shift)
        gap = self.gap() if self.spec.kind == "boost" else self.y
        if ask.what == "miss":  # AdaBoost.R2: errors of the new tree
            return np.array([np.abs(self.y - self.spread(np.array(ask.tree.value)[self.leaves(ask.tree)])).max(initial=0.0)])
        if ask.what == "cost":
            off = np.abs(self.y - self.spread(np.array(ask.tree.value)[self.leaves(ask.tree)]))
            return np.array([weight.sum(), weight @ penalty(self.spec.loss, off, ask.turn)])
        if ask.what.endswith("size"):
            gap = np.abs(gap)
        if ask.tree is None:
            leaf = np.zeros(len(gap), np.int64)
        else:
            place = np.full(len(ask.tree.feature), -1)
            place[ask.nodes] = np.arange(len(ask.nodes))
            leaf = self.spread(place[self.leaves(ask.tree)])
        if ask.what.startswith("range"):  # (least negated, greatest): both are taken by maximum
            out = np.full((len(ask.nodes), 2), -np.inf)
            np.maximum.at(out[:, 0], leaf, -gap)
            np.maximum.at(out[:, 1], leaf, gap)
            return out.ravel()
        if ask.what.startswith("count"):
            step = (ask.high - ask.low) / REFINE
            slot = np.clip(np.ceil((gap - ask.low[leaf]) / np.where(step > 0, step, 1.0)[leaf]), 0, REFINE + 1).astype(np.int64)
            return np.bincount(leaf * (REFINE + 2) + slot, weight, len(ask.nodes) * (REFINE + 2))
        middle = gap - ask.low[leaf]  # "beyond": mean of the clipped distance from the leaf's median
        return np.concatenate([np.bincount(leaf, weight, len(ask.nodes)), np.bincount(leaf, weight * np.clip(middle, -ask.turn, ask.turn), len(ask.nodes))])

    def level(self, ask: Ask) -> np.ndarray:
        """[node, feature, bin, (weight, weighted targets)] of the asked nodes."""
        leaf, width = self.leaves(ask.tree), self.bins.shape[1]
        place = np.full(len(ask.tree.feature), -1)
        place[ask.nodes] = np.arange(len(ask.nodes))
        at = place[leaf]
        rows = np.flatnonzero(at >= 0)
        slots = ((at[rows, None] * width + np.arange(width)) * BINS + self.bins[rows]).ravel()
        weight, size = self.weight(ask.shift), len(ask.nodes) * width * BINS
        columns = [weight, *(weight * t for t in self.targets(ask))]
        if self.cell is not None:
            columns = [np.bincount(self.cell, c, len(self.bins)) for c in columns]
        columns = [c[rows] for c in columns]
        return np.stack([np.bincount(slots, np.repeat(c, width), size) for c in columns], axis=1).ravel()


def _sample(spec: Spec) -> int:
    """Number of the bootstrap sample a model learns from, -1 for the rows themselves."""
    return spec.seed * 1000003 + spec.bootstrap if spec.bootstrap >= 0 else -1


def penalty(loss: str, off: np.ndarray, worst: float) -> np.ndarray:
    share = off / worst if worst else off * 0.0
    return {"linear": share, "square": share * share, "exponential": 1.0 - np.exp(-share)}[loss]


# --- trainers ------------------------------------------------------------------------------------------------------

Trainer = Generator[Ask, np.ndarray, None]


def grow(spec: Spec, width: int, edges: np.ndarray, number: int, shift: float = 0.0, turn: float = 0.0):
    """Grow one tree by levels; returns it and [leaf, (weight, weighted targets)]."""
    tree, nodes, totals = Tree(), [0], {}
    rng = spec.seed * 7919 + number * 104729 + max(spec.bootstrap, 0) * 1299709

    def value(sums: np.ndarray) -> float:
        return float(np.argmax(sums[1:])) if spec.classes else float(sums[1] / sums[0]) if sums[0] else 0.0

    for level in range(spec.depth):
        found = yield Ask("level", tree, list(nodes), shift, turn)
        hist = found.reshape(len(nodes), width, BINS, -1)
        total = hist[:, :1].sum(axis=2, keepdims=True)
        if not level:
            tree.value[0], totals[0] = value(total[0, 0, 0]), total[0, 0, 0]
        left = hist.cumsum(axis=2)[:, :, :-1]
        right = total - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left[..., 1:] ** 2).sum(-1) / left[..., 0] + (right[..., 1:] ** 2).sum(-1) / right[..., 0] - (total[..., 1:] ** 2).sum(-1) / total[..., 0]
        tiny = 1e-9 * np.maximum(total[..., 0], 1e-300)
        gain = np.where((left[..., 0] > tiny) & (right[..., 0] > tiny), gain, -np.inf)
        keys = np.asarray(nodes, np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64)
        if spec.features and spec.features < width:
            chosen = np.argsort(uniform(keys, rng), axis=1)[:, : spec.features]
            mask = np.zeros((len(nodes), width), bool)
            np.put_along_axis(mask, chosen, True, axis=1)
            gain = np.where(mask[..., None], gain, -np.inf)
        if spec.splitter == "random":
            gain = np.where(_drawn(hist[..., 0], edges, uniform(keys, rng + 1)), gain, -np.inf)
        flat = gain.reshape(len(nodes), -1)
        best = flat.argmax(axis=1)
        worth = flat[np.arange(len(nodes)), best] > 1e-10 * np.maximum((total[:, 0, 0, 1:] ** 2).sum(-1) / np.maximum(total[:, 0, 0, 0], 1e-300), 1e-300)
        nodes_next = []
        for i in np.flatnonzero(worth):
            feature, cut = divmod(int(best[i]), BINS - 1)
            sides = left[i, feature, cut], right[i, feature, cut]
            pair = tree.split(nodes[i], feature, cut, (value(sides[0]), value(sides[1])))
            totals.pop(nodes[i])
            totals |= dict(zip(pair, sides))
            nodes_next += pair
        nodes = nodes_next
        if not nodes:
            break
    return tree, totals


def _drawn(weight: np.ndarray, edges: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """For each node and feature the one cut its threshold falls on, drawn evenly over the values its rows span."""
    filled = weight > 0
    low = filled.argmax(axis=2)
    high = BINS - 1 - filled[:, :, ::-1].argmax(axis=2)
    out = np.zeros(weight.shape[:2] + (BINS - 1,), bool)
    for f in range(weight.shape[1]):
        e = edges[f]
        start, end = e[np.minimum(low[:, f], len(e) - 1)], e[np.minimum(np.maximum(high[:, f] - 1, 0), len(e) - 1)]
        cut = np.clip(np.searchsorted(e, start + draw[:, f] * (end - start)), low[:, f], np.maximum(high[:, f] - 1, low[:, f]))
        spans = np.flatnonzero((high[:, f] > low[:, f]) & (cut < BINS - 1))
        out[spans, f, cut[spans]] = True
    return out


def quantiles(share: float, tree: Tree | None, nodes: list[int], of: str = ""):
    """The weighted quantile of the gap (or its size) in each leaf, by narrowing ranges: to 128^-4 of a leaf's range."""
    found = (yield Ask("range" + of, tree, nodes)).reshape(-1, 2)
    low, high = -found[:, 0], found[:, 1]
    seen = np.isfinite(low)
    low, high = np.where(seen, low, 0.0), np.where(seen, high, 0.0)
    low = low - 1e-12 * np.maximum(1.0, np.abs(low))
    goal = None
    for _ in range(REFINEMENTS):
        count = (yield Ask("count" + of, tree, nodes, low=low, high=high)).reshape(len(nodes), -1)
        reached = count.cumsum(axis=1)
        if goal is None:
            goal = share * reached[:, -1] * (1 - 1e-12)
        slot = np.clip((reached >= goal[:, None]).argmax(axis=1), 1, REFINE)
        step = (high - low) / REFINE
        low, high = low + (slot - 1) * step, low + slot * step
    return np.where(seen, high, 0.0)


def trainer(spec: Spec, model: Fitted, width: int, edges: list[np.ndarray]):
    """Fill ``model`` as the sums come in."""
    if spec.kind == "tree":
        tree, _ = yield from grow(spec, width, edges, 0)
        model.trees.append(tree)
        model.weights.append(1.0)
    elif spec.kind == "boost":
        at = spec.quantile if spec.loss == "quantile" else 0.5
        if spec.loss == "squared":
            root = (yield Ask("level", Tree(), [0])).reshape(width, BINS, -1)[0].sum(axis=0)
            model.start = float(root[1] / root[0]) if root[0] else 0.0
        else:
            model.start = float((yield from quantiles(at, None, [0]))[0])
        for i in range(spec.rounds):
            turn = 0.0
            if spec.loss == "huber":
                turn = float((yield from quantiles(spec.quantile, None, [0], " size"))[0]) or 1e-12
            tree, totals = yield from grow(spec, width, edges, i, turn=turn)
            if spec.loss != "squared":
                nodes = sorted(totals) or [0]
                values = yield from quantiles(at, tree, nodes)
                if spec.loss == "huber":
                    n, off = np.split((yield Ask("beyond", tree, nodes, turn=turn, low=values)), 2)
                    values = values + off / np.maximum(n, 1e-300)
                for node, v in zip(nodes, values.tolist()):
                    tree.value[node] = v
            model.trees.append(tree)
            model.weights.append(spec.rate)
    elif spec.kind == "samme":
        shift = 0.0
        for i in range(spec.rounds):
            tree, totals = yield from grow(spec, width, edges, i, shift)
            sums = np.array(list(totals.values()))
            total = sums[:, 0].sum()
            error = max(0.0, 1.0 - sums[:, 1:].max(axis=1).sum() / total)
            if error >= 1.0 - 1.0 / spec.classes:
                if not i:
                    raise ValueError("the first tree is no better than chance")
                break
            model.trees.append(tree)
            model.weights.append(spec.rate * (np.log((1.0 - error) / max(error, 1e-12)) + np.log(spec.classes - 1.0)))
            shift += float(np.log(total))
            if error <= 1e-12:
                break
    else:
        shift = 0.0
        for i in range(spec.rounds):
            tree, totals = yield from grow(spec, width, edges, i, shift)
            worst = float((yield Ask("miss", tree, shift=shift))[0])
            total, cost = yield Ask("cost", tree, shift=shift, turn=worst)
            mean = cost / total
            if not worst or mean >= 0.5:
                if not model.trees or not worst:
                    model.trees.append(tree), model.weights.append(1.0), model.worst.append(worst)
                break
            model.trees.append(tree)
            model.worst.append(worst)
            model.weights.append(spec.rate * float(np.log((1.0 - mean) / max(mean, 1e-12))))
            shift += float(np.log(total))


def train_here(block: Block, specs: Sequence[Spec], edges: list[np.ndarray]) -> list[Fitted]:
    """Train models on rows at hand, one after the other."""
    out = []
    for spec in specs:
        model, view = Fitted(), View(block, spec)
        steps = trainer(spec, model, block.bins.shape[1], edges)
        ask = next(steps, None)
        while ask is not None:
            view.advance(model)
            found = view.answer(ask)
            try:
                ask = steps.send(found)
            except StopIteration:
                ask = None
        out.append(model)
    return out


# --- tables --------------------------------------------------------------------------------------------------------


def features_of(df: DataFrame, name: str) -> Column:
    """A features column as array<double>, from an array or an ML vector."""
    kind = df.schema[name].dataType
    return (F.col(name) if isinstance(kind, ArrayType) else vector_to_array(F.col(name))).cast("array<double>")


def bin_edges(df: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of all bins but the last, per feature, from mergeable quantile sketches."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    columns = [F.percentile_approx(F.get("x", F.lit(i)), shares, 10000).alias(f"e{i}") for i in range(width)]
    row = df.agg(*columns).first()
    return [np.unique(np.array(row[f"e{i}"] or [0.0], float)) for i in range(width)]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    if not len(x):
        return np.empty((0, len(edges)), np.int64)
    return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1).astype(np.int64)


def _block(table: pa.Table | pa.RecordBatch, edges: list[np.ndarray]) -> Block:
    def column(name: str) -> np.ndarray:
        return table[name].to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[name].to_numpy()

    y, fold, part = (column(c) for c in ("y", "fold", "part"))
    if "bins" not in table.schema.names:
        return Block(binned(matrix(table["x"]), edges), y, fold, part, column("key"))
    bins = np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint8).reshape(len(y), len(edges)).astype(np.int64)
    return Block(bins, y, fold, part, np.zeros(len(y), np.int64), n=column("n"), boot=column("boot"))


def _plain(model: Fitted) -> dict[str, Any]:
    return {"start": model.start, "weights": [float(w) for w in model.weights], "worst": model.worst, "trees": [[t.feature, t.cut, t.left, t.value] for t in model.trees]}


def _model(state: dict[str, Any]) -> Fitted:
    return Fitted(state["start"], [Tree(*t) for t in state["trees"]], state["weights"], state["worst"])


def training_rows(df: DataFrame, features: str, label: Column, key: Column | None = None, part: str | None = None, fold: str | None = None) -> DataFrame:
    """(x, y, part, fold, key): key is a hash, of the row itself where no key is named; rows without a label are left out."""
    x = features_of(df, features)
    named = key if key is not None else F.xxhash64(x, label)
    return df.select(
        x.alias("x"), label.cast("double").alias("y"), (F.col(part) if part else F.lit(0)).cast("int").alias("part"),
        (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"), F.xxhash64(named).alias("key"),
    ).filter("y is not null")


def train(rows: DataFrame, specs: Sequence[Spec], edges: list[np.ndarray] | None = None, local_rows: int | None = None) -> tuple[list[Fitted], list[np.ndarray]]:
    """Models of ``specs`` over ``training_rows``, and the bin edges."""
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    if not counts:
        raise ValueError("no row has a label")
    width = rows.select(F.size("x")).first()[0]
    edges = bin_edges(rows, width) if edges is None else edges
    needed = [sum(counts.values()) if s.part < 0 else counts.get(s.part, 0) for s in specs]
    small = [i for i, n in enumerate(needed) if n <= local_rows]
    large = [i for i, n in enumerate(needed) if n > local_rows]
    out: dict[int, Fitted] = {}
    if small:
        found = _in_bundles(rows, [[s] for s in specs], small, edges, lambda block, group, members: json.dumps(_plain(members[0])))
        out = {i: _model(json.loads(text)) for i, text in found.items()}
    if large:
        out |= _large(rows, specs, large, edges, local_rows)
    return [out[i] for i in range(len(specs))], edges


def _large(rows: DataFrame, specs: Sequence[Spec], which: Sequence[int], edges: list[np.ndarray], local_rows: int) -> dict[int, Fitted]:
    """Train on more rows than a task holds, condensed where sums of the target say all a model asks for."""
    out: dict[int, Fitted] = {}
    classes = [i for i in which if specs[i].classes]
    means = [i for i in which if not specs[i].classes and (specs[i].kind == "tree" or specs[i].kind == "boost" and specs[i].loss == "squared")]
    for chosen in (classes, means):
        if not chosen:
            continue
        cells = condensed(rows, [specs[i] for i in chosen], edges).persist()
        counts = {r["part"]: r["n"] for r in cells.groupBy("part").agg(F.count("*").alias("n")).collect()}
        needed = {i: sum(counts.values()) if specs[i].part < 0 else counts.get(specs[i].part, 0) for i in chosen}
        near, far = ([i for i in chosen if (needed[i] <= local_rows) == here] for here in (True, False))
        if near:
            found = _in_bundles(cells, [[s] for s in specs], near, edges, lambda block, group, members: json.dumps(_plain(members[0])))
            out |= {i: _model(json.loads(text)) for i, text in found.items()}
        if far:
            out |= dict(zip(far, _by_passes(cells, [specs[i] for i in far], edges)))
        cells.unpersist()
    rest = [i for i in which if i not in classes and i not in means]
    if rest:
        out |= dict(zip(rest, _by_passes(rows, [specs[i] for i in rest], edges)))
    return out


CONDENSED = "bins binary, y double, part int, fold int, boot long, n double"


def condensed(rows: DataFrame, specs: Sequence[Spec], edges: list[np.ndarray]) -> DataFrame:
    """One row for all ``training_rows`` of equal bins, fold and part (and class) in a bootstrap sample: their weight ``n`` and mean target.

    Bins decide the leaf of a row in any tree, so counts of classes and sums of the target or of its gap to a score are the
    same. Folds and parts that no spec asks for are not kept apart.
    """
    by_class = specs[0].classes > 0
    samples = sorted({_sample(s) for s in specs})
    folds, parts = any(s.holdout >= 0 for s in specs), any(s.part >= 0 for s in specs)

    def summed_up(sides: list[np.ndarray]) -> list[np.ndarray]:
        codes, n, total = sides
        codes, at = np.unique(codes, return_inverse=True)
        return [codes, np.bincount(at, n, len(codes)), np.bincount(at, total, len(codes))]

    width = len(edges)
    code = np.dtype([("boot", "<i8"), ("part", "<i4"), ("fold", "<i4"), ("y", "<f8"), ("bins", f"V{width}")])

    def sent(sides: list[np.ndarray]) -> pa.RecordBatch:
        codes, n, total = sides
        codes = codes.view(code).ravel()
        y = codes["y"] if by_class else total / n
        bins = pa.array([b.tobytes() for b in codes["bins"]], pa.binary())
        columns = [bins, pa.array(y), *(pa.array(np.ascontiguousarray(codes[c])) for c in ("part", "fold", "boot")), pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, names=["bins", "y", "part", "fold", "boot", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            block = _block(batch, edges)
            marks = np.zeros(len(block.y), code)
            marks["part"], marks["fold"] = block.part if parts else 0, block.fold if folds else -1
            marks["y"] = block.y + 0.0 if by_class else 0.0
            marks["bins"] = np.ascontiguousarray(block.bins.astype(np.uint8)).view(f"V{width}").ravel()
            for sample in samples:
                weight = poisson(block.key, sample) if sample >= 0 else np.ones(len(block.y))
                taken = weight > 0
                marks["boot"] = sample
                held.append([marks[taken].view(f"V{code.itemsize}"), weight[taken], (weight * block.y)[taken]])
            if sum(len(h[0]) for h in held) > 2 * HELD_CELLS:
                held = [summed_up([np.concatenate(side) for side in zip(*held)])]
                if len(held[0][0]) > HELD_CELLS:
                    yield sent(held.pop())
        if held:
            yield sent(summed_up([np.concatenate(side) for side in zip(*held)]))

    by = ["bins", "part", "fold", "boot", *(["y"] if by_class else [])]
    sums = [F.sum("n").alias("n")] if by_class else [F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("y")]
    return rows.mapInArrow(gather, CONDENSED).groupBy(*by).agg(*sums).select("bins", "y", "part", "fold", "boot", "n")


def _in_bundles(rows: DataFrame, groups: Sequence[Sequence[Spec]], which: Sequence[int], edges: list[np.ndarray], answer: Callable) -> dict[int, str]:
    """Train groups of models in tasks that hold their part's rows (at most LOCAL_ROWS); ``answer`` says what of a group comes back."""
    by_part: dict[int, list[int]] = {}
    for i in sorted(which, key=lambda i: -sum(s.rounds * s.depth for s in groups[i])):
        by_part.setdefault(groups[i][0].part, []).append(i)
    bundles: dict[int, list[int]] = {}
    homes: dict[int, list[int]] = {}
    for part, mine in by_part.items():
        count = -(-len(mine) // BUNDLE)
        for b in range(count):
            homes.setdefault(part, []).append(len(bundles))
            bundles[len(bundles)] = mine[b::count]

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (("key", "y") if "key" in table.schema.names else ("boot", "part", "fold", "bins", "y"))])
        block, chosen = _block(table, edges), bundles[table["bundle"][0].as_py()]
        texts = [answer(block, groups[i], train_here(block, groups[i], edges)) for i in chosen]
        return pa.table({"i": pa.array(chosen, pa.int32()), "text": texts})

    targets = F.array(*[F.lit(b) for b in homes.get(-1, [])]).cast("array<int>")
    for part, numbers in homes.items():
        if part >= 0:
            targets = F.concat(targets, F.when(F.col("part") == part, F.array(*[F.lit(b) for b in numbers])).otherwise(F.array().cast("array<int>")))
    dealt = rows.withColumn("bundle", F.explode(targets)).repartition(len(bundles), "bundle")  # a count of its own: small groups, long work
    done = dealt.groupBy("bundle").applyInArrow(work, "i int, text string").toArrow()
    return dict(zip(done["i"].to_pylist(), done["text"].to_pylist()))


BLOCKS = "count int, cells int, bins binary, cell binary, y binary, fold binary, part binary, key binary, n binary, boot binary, state binary"
KINDS = {"bins": np.uint8, "cell": np.int32, "y": np.float64, "fold": np.int32, "part": np.int32, "key": np.int64, "n": np.float64, "boot": np.int64, "state": np.float64}


def _packed(block: Block) -> dict[str, Any]:
    """A block as bytes by column; its distinct bins are found once."""
    if block.cell is None:
        flat = np.ascontiguousarray(block.bins.astype(np.uint8))
        cells, at = np.unique(flat.view(f"V{flat.shape[1]}").ravel(), return_inverse=True)
        bins = cells.view(np.uint8).reshape(len(cells), -1)
    else:
        bins, at = block.bins, block.cell
    given = {"bins": bins, "cell": at, "y": block.y, "fold": block.fold, "part": block.part, "key": block.key, "n": block.n, "boot": block.boot, "state": block.states}
    data = {name: None if v is None else np.ascontiguousarray(v, KINDS[name]).tobytes() for name, v in given.items()}
    return {"count": len(block.y), "cells": len(bins), **data}


def _unpacked(batch: pa.RecordBatch, row: int) -> Block:
    def column(name: str) -> np.ndarray | None:
        value = batch[name][row]
        return np.frombuffer(value.as_buffer(), KINDS[name]) if value.is_valid else None

    found = {name: column(name) for name in KINDS}
    bins, states = found.pop("bins").reshape(batch["cells"][row].as_py(), -1), found.pop("state")
    return Block(bins.astype(np.int64), states=None if states is None else states.reshape(len(found["y"]), -1), **found)


_BLOCK_SCHEMA = pa.schema([(n, pa.int32() if n in ("count", "cells") else pa.binary()) for n in ("count", "cells", *KINDS)])


def packed_rows(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Blocks of up to ``PACKED`` rows, binned once, spread over at least as many tasks as there are cores; cached."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_packed(_block(pa.Table.from_batches(held).combine_chunks(), edges))], schema=_BLOCK_SCHEMA)

        for batch in batches:
            if batch.num_rows and sum(b.num_rows for b in held) + batch.num_rows > PACKED and held:
                yield out()
                held = []
            if batch.num_rows:
                held.append(batch)
        if held:
            yield out()

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks).mapInArrow(pack, BLOCKS).persist()


def _by_passes(rows: DataFrame, specs: Sequence[Spec], edges: list[np.ndarray]) -> list[Fitted]:
    """Train models over a distributed table: one pass answers the open questions of all of them."""
    width = len(edges)
    models = [Fitted() for _ in specs]
    steps = [trainer(s, m, width, edges) for s, m in zip(specs, models)]
    asks: list[Ask | None] = [next(s, None) for s in steps]
    table, applied = packed_rows(rows, edges), [0] * len(specs)
    partitions = table.rdd.getNumPartitions()
    cells, count = table.agg(F.sum("cells"), F.sum("count")).first()
    replayed = [s.kind == "boost" and cells <= FEW_CELLS * count for s in specs]
    try:
        while any(a is not None for a in asks):
            if max([len(m.weights) - a for m, a, r in zip(models, applied, replayed) if not r], default=0) >= FORWARD:
                table = _forward(table, specs, models, applied, replayed)
                applied = [0 if r else len(m.weights) for m, r in zip(models, replayed)]
            open_ = [i for i, a in enumerate(asks) if a is not None]
            found = _pass(table, [(i, specs[i], models[i], applied[i], asks[i]) for i in open_], edges, partitions)
            for i in open_:
                try:
                    asks[i] = steps[i].send(found[i])
                except StopIteration:
                    asks[i] = None
    finally:
        table.unpersist()
    return models


def _pass(table: DataFrame, questions: list[tuple], edges: list[np.ndarray], partitions: int) -> dict[int, np.ndarray]:
    """Answers to all questions. Ranges combine by maximum, everything else by sum."""
    by_maximum = [q for q in questions if q[4].what.startswith(("range", "miss"))]
    by_sum = [q for q in questions if q not in by_maximum]
    out: dict[int, np.ndarray] = {}
    for group, add in ((by_sum, np.add), (by_maximum, np.maximum)):
        if not group:
            continue

        def work(batches: Iterable[pa.RecordBatch], group=group, add=add) -> np.ndarray:
            totals: list[np.ndarray | None] = [None] * len(group)
            for batch in batches:
                for row in range(batch.num_rows):
                    block = _unpacked(batch, row)
                    for j, (i, spec, model, applied, ask) in enumerate(group):
                        view = View(block, spec, i, applied)
                        view.advance(model)
                        found = view.answer(ask)
                        totals[j] = found if totals[j] is None else add(totals[j], found)
            empty = Block(np.empty((0, len(edges)), np.int64), *(np.empty(0) for _ in range(3)), np.empty(0, np.int64))
            done = [t if t is not None else View(empty, spec).answer(ask) for t, (_, spec, _, _, ask) in zip(totals, group)]
            return np.concatenate(done)

        whole = summed(table, work, partitions) if add is np.add else _greatest(table, work, partitions)
        sizes = [_size(ask, len(edges), spec) for _, spec, _, _, ask in group]
        for (i, *_), part in zip(group, np.split(whole, np.cumsum(sizes)[:-1])):
            out[i] = part
    return out


def _size(ask: Ask, width: int, spec: Spec) -> int:
    if ask.what == "level":
        return len(ask.nodes) * width * BINS * (1 + (spec.classes or 1))
    return {"miss": 1, "cost": 2}.get(ask.what) or len(ask.nodes) * (REFINE + 2 if ask.what.startswith("count") else 2)


def _greatest(table: DataFrame, work: Callable[[Iterable[pa.RecordBatch]], np.ndarray], partitions: int) -> np.ndarray:
    """Greatest entries over all partitions; where those are many, found by executors in groups first."""
    if partitions <= FAN_IN:
        return np.max([t for _, t in partition_totals(table, work)], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = work(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)], names=["at", "v"])

    rows = table.mapInArrow(run, "at int, v double").groupBy("at").agg(F.max("v").alias("v")).toArrow()
    out = np.empty(len(rows))
    out[rows["at"].to_numpy()] = rows["v"].to_numpy()
    return out


def _forward(table: DataFrame, specs: Sequence[Spec], models: Sequence[Fitted], applied: Sequence[int], replayed: Sequence[bool]) -> DataFrame:
    """The blocks with the state of every model that is not replayed, after all its trees, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = _unpacked(batch, row)
                everyone = replace(block, boot=None)
                states = np.zeros((len(block.y), len(specs)))
                for i, (spec, model, done, again) in enumerate(zip(specs, models, applied, replayed)):
                    if again:
                        continue
                    view = View(everyone, replace(spec, part=-1, holdout=-1, bootstrap=-1), i, done)
                    view.advance(model)
                    states[:, i] = view.spread(view.state) if view.by_cell else view.state
                yield pa.RecordBatch.from_pylist([_packed(replace(block, states=states))], schema=_BLOCK_SCHEMA)

    ahead = checkpointed(table.mapInArrow(run, BLOCKS)).persist()
    ahead.count()
    table.unpersist()
    return ahead


# --- fitted models and scores --------------------------------------------------------------------------------------


def combined(how: str, members: np.ndarray, weights: np.ndarray, start: float, classes: int) -> np.ndarray:
    """One answer a row from [member, row] answers: weighted class vote, weighted median, or weighted sum."""
    if how == "vote":
        tally = np.stack([((members == c) * weights[:, None]).sum(axis=0) for c in range(classes)])
        return np.round(tally, 9).argmax(axis=0).astype(float)
    if how == "median":
        order = np.argsort(members, axis=0, kind="stable")
        reached = np.cumsum(weights[order], axis=0)
        at = (reached >= 0.5 * weights.sum() * (1 - 1e-12)).argmax(axis=0)
        return np.take_along_axis(members, np.take_along_axis(order, at[None], 0), 0)[0]
    return start + weights @ members


def predict(model: Fitted, kind: str, bins: np.ndarray, classes: int = 0) -> np.ndarray:
    """Answers of one trained model to binned rows."""
    how = {"samme": "vote", "r2": "median"}.get(kind, "sum")
    if how == "sum":
        out = np.full(len(bins), model.start)
        for tree, weight in zip(model.trees, model.weights):
            out += weight * tree.answer(bins)
        return out
    return combined(how, np.stack([t.answer(bins) for t in model.trees]), np.array(model.weights), model.start, classes)


class TreesModel(TableModel):
    """A fitted tree or ensemble; all its trees are scored by one Arrow function."""

    def predict(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        model, classes = _model(state), state["classes"]
        edges = [np.array(e) for e in state["edges"]]
        how = state["how"]

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            known = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
            out = np.full(len(x), np.nan)
            if len(known):
                bins = binned(matrix(x.take(pa.array(known))), edges)
                members = np.stack([t.answer(bins) for t in model.trees])
                out[known] = combined(how, members, np.array(model.weights), model.start, len(classes))
            return pa.array(out, mask=np.isnan(out))

        answer = score(features_of(df, self._get("featuresCol")))
        return df.withColumn(self._get("predictionCol"), class_at(answer.cast("int"), classes) if classes else answer)


def tree_states(
    df: DataFrame, specs: Sequence[Spec], features: str, label: str, key: str | None = None, classify: bool = False, how: str = "sum"
) -> list[dict[str, Any]]:
    """The state of a ``TreesModel`` for each spec, trained together."""
    classes = sorted_classes(df, label) if classify else []
    target = class_index(F.col(label), classes) if classify else F.col(label)
    models, edges = train(training_rows(df, features, target, F.col(key) if key else None), [replace(s, classes=len(classes)) for s in specs])
    return [_plain(m) | {"edges": [e.tolist() for e in edges], "classes": classes, "how": how} for m in models]


def tree_state(
    df: DataFrame, specs: Sequence[Spec], features: str, label: str, key: str | None = None, classify: bool = False, how: str = "sum",
    weights: Sequence[float] | None = None,
) -> dict[str, Any]:
    """The state of one ``TreesModel`` whose members are ``specs``, combined by ``how`` and ``weights``."""
    states = tree_states(df, specs, features, label, key, classify, how)
    if len(states) == 1:
        return states[0]
    return states[0] | {"start": 0.0, "worst": [], "trees": [t for s in states for t in s["trees"]], "weights": list(weights or [1.0] * len(states))}


def squared_error(rows: DataFrame, model: Fitted, spec: Spec, edges: list[np.ndarray]) -> float:
    """Mean squared error of a model over ``training_rows``."""

    def work(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(2)
        for batch in batches:
            block = _block(batch, edges)
            off = block.y - predict(model, spec.kind, block.bins, spec.classes) if len(block.y) else block.y
            total += len(off), off @ off
        return total

    n, squares = summed(rows, work, rows.rdd.getNumPartitions())
    return float(squares / n)


NAMES = ("n", "total", "squares", "off_squares", "off")


def _held_out(block: Block, group: Sequence[Spec], members: Sequence[Fitted]) -> list[float]:
    """n, sum and squares of a group's held-out targets, and squares and size of the errors of its members' mean."""
    spec = group[0]
    held = (block.fold == spec.holdout) & ((block.part == spec.part) | (spec.part < 0))
    y = block.y[held]
    mean = sum(predict(m, s.kind, block.bins[held], s.classes) for s, m in zip(group, members)) / len(group) if held.any() else 0.0
    off = y - mean
    return [float(held.sum()), float(y.sum()), float(y @ y), float(off @ off), float(np.abs(off).sum())]


def held_out_sums(rows: DataFrame, groups: Sequence[Sequence[Spec]]) -> list[dict[str, float]]:
    """For each group of members (one ensemble, by its mean), sums over the rows of its held-out fold.

    Ensembles of parts that tasks can hold are trained and scored there, and only sums come back.
    """
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    edges = bin_edges(rows, rows.select(F.size("x")).first()[0])
    size = [sum(counts.values()) if g[0].part < 0 else counts.get(g[0].part, 0) for g in groups]
    small, large = ([i for i, n in enumerate(size) if (n <= LOCAL_ROWS) == here] for here in (True, False))
    out: dict[int, list[float]] = {}
    if small:
        found = _in_bundles(rows, groups, small, edges, lambda block, group, members: json.dumps(_held_out(block, group, members)))
        out = {i: json.loads(text) for i, text in found.items()}
    if large:
        flat, _ = train(rows, [s for i in large for s in groups[i]], edges)
        models = iter(flat)
        fitted = [[next(models) for _ in groups[i]] for i in large]

        def work(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
            totals = np.zeros((len(large), len(NAMES)))
            for batch in batches:
                block = _block(batch, edges)
                totals += [_held_out(block, groups[i], members) for i, members in zip(large, fitted)]
            return totals.ravel()

        out |= dict(zip(large, summed(rows, work).reshape(len(large), -1).tolist()))
    return [dict(zip(NAMES, out[i])) for i in range(len(groups))]
