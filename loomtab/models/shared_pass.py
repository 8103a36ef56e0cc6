"""Train many models over one table with one pass per step.

A search over candidates and folds usually fits each pair by itself, reading the data
candidates x folds x iterations times. Here every open model contributes a trial point to
the same pass: a task computes the loss and gradient of all of them on its rows, leaving
out the rows of each model's held-out fold, and the driver advances each model by its own
step. Reads of the data are bounded by the slowest model alone. Linear models of modest
size also sum their second derivatives, so Newton steps finish them in a few passes.

Rows of classes can be packed once: blocks of bytes, sorted by fold and class. All rows of a run of a block share fold, target
and weight, so the linear models that leave out the same fold are evaluated on it together by a few matrix products.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtab.models.arrays import block_columns, matrix, summed, summed_apart
from loomtab.models.base import MAX_CLASSES, class_index, sorted_classes
from loomtab.models.losses import Linear, Network

Family = Linear | Network
Lift = Callable[[np.ndarray], np.ndarray]  # from the stored rows to those the models read
MEMORY = 10
NEWTON_SIZE = 256  # largest parameter vector whose curvature matrix is summed
SWEEPS = 50
ROWS_PER_TASK = 20000
LEAST_ROWS = 1000  # rows worth a task of their own
ROWS_PER_SHARD = 20000
LEAST_SHARDS = 8
PIECE = 100
NUMBERS = 1 << 20  # numbers of all partitions of a pass that the driver may add up itself
PACKED = 8192  # rows in a packed block, fewer where rows are wide
PACKED_NUMBERS = 1 << 18
LIFTED_NUMBERS = 1 << 21  # numbers of a block after its rows are lifted
PACKED_ROWS_PER_TASK = 200000
WARM = 32  # blocks of which one makes the start of Newton steps
WARM_BLOCKS = 256  # blocks from which on that pays
LEAST_TOL = 1e-8  # a hundredth of a tolerance is not asked for below this
JOINED = 24  # widest part of a row whose products of two columns are kept for the models that share it


@dataclass
class Problem:
    """One model to fit: its family, penalties (on the summed loss), held-out fold and weights."""

    family: Family
    l2: float = 0.0
    l1: float = 0.0
    holdout: int | None = None
    class_weight: dict[int, float] = field(default_factory=dict)
    positive: int | None = None  # one-vs-rest: this class is 1, the others 0
    span: tuple[int, int] | None = None  # the part of the feature row this model reads
    theta: np.ndarray | None = None
    seed: int = 0
    max_iter: int = 100
    tol: float = 1e-5
    value: float = np.inf
    passes: int = 0

    @property
    def newton(self) -> bool:
        return isinstance(self.family, Linear) and self.family.size <= NEWTON_SIZE

    def bare(self) -> Problem:
        """The part of the problem a task needs."""
        return replace(self, theta=None)

    def view(self, features: np.ndarray) -> np.ndarray:
        return features if self.span is None else features[:, self.span[0] : self.span[1]]

    def sight(self) -> tuple:
        """All that ``view`` and ``rows`` depend on."""
        return self.holdout, self.positive, self.span, tuple(sorted(self.class_weight.items()))

    def rows(self, block: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Targets and weights of a block as this problem sees them."""
        y = block["y"].astype(float)
        weight = np.ones(len(y))
        for label, share in self.class_weight.items():
            weight[y == label] = share
        if self.holdout is not None:
            weight[block["fold"] == self.holdout] = 0.0
        if self.positive is not None:
            y = (y == self.positive).astype(float)
        return y, weight


def training_table(df: DataFrame, features: str, label: str, fold: str | None = None, key: str | None = None) -> DataFrame:
    """The columns a pass needs, cached: (features, y, fold[, key]); rows without a label are left out.

    The caller unpersists it.
    """
    columns = [
        F.col(features).cast("array<double>").alias("features"),
        F.col(label).cast("double").alias("y"),
        (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"),
    ]
    if key:
        columns.append(F.col(key).alias("key"))
    table = df.filter(F.col(label).isNotNull()).select(*columns).persist()
    # Every pass starts one task per partition, so a table spread too thin is packed once, and one held by few tasks is dealt to all cores.
    rows, partitions, cores = table.count(), table.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    most = max(cores, -(-rows // ROWS_PER_TASK))
    least = max(min(cores, -(-rows // LEAST_ROWS)), -(-rows // ROWS_PER_TASK))
    if least <= partitions <= most:
        return table
    packed = (table.coalesce(most) if partitions > most else table.repartition(least)).persist()
    packed.count()
    table.unpersist()
    return packed


BLOCKS = "part int, width int, features binary, fold binary, y binary, runs binary"
_BLOCK_SCHEMA = pa.schema([(n, pa.int32() if n in ("part", "width") else pa.binary()) for n in ("part", "width", "features", "fold", "y", "runs")])


@dataclass
class Packed:
    """Labelled rows as blocks (``blocks``, cached): a block's rows are sorted by fold and class, of which it keeps runs alone."""

    blocks: DataFrame
    classes: list[Any]
    counts: dict[int, int]  # rows of every class, by its place among the classes
    width: int

    def weights(self) -> dict[int, float]:
        """Balanced weight of every class."""
        found = {c: n for c, n in self.counts.items() if n}
        return {c: sum(found.values()) / (len(found) * n) for c, n in found.items()}

    def release(self) -> None:
        self.blocks.unpersist()


def packed(df: DataFrame, label: str, features: str = "features", fold: str | None = None, lifted: int = 1) -> Packed:
    """The labelled rows of ``df``, packed once; rows without a label are left out. The caller releases them.

    Blocks hold fewer rows if these are to be ``lifted`` to very many numbers each.
    """
    numbers = isinstance(df.schema[label].dataType, (T.IntegerType, T.ShortType, T.ByteType))  # whose classes are found while packing
    named = None if numbers else sorted_classes(df, label)
    rows = df.filter(F.col(label).isNotNull()).select(
        F.col(features).cast("array<double>").alias("features"),
        (F.col(label) if numbers else class_index(F.col(label), named)).cast("double").alias("y"),
        (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made = [], TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED:
                for block in _blocks_of(pa.Table.from_batches(held).combine_chunks(), made, lifted):
                    made += 1
                    yield block
                held = []
        if held:
            yield from _blocks_of(pa.Table.from_batches(held).combine_chunks(), made, lifted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, wide, kinds = 0, 0, Counter()
        for _, wide, runs in block_runs(batches):
            made += 1
            for _, y, at in runs:
                kinds[y] += at.stop - at.start
            if len(kinds) > MAX_CLASSES:
                raise ValueError(f"{label!r} has more than {MAX_CLASSES} distinct values; is it a class label?")
        if made:
            rows = [{"made": made, "width": wide, "y": y, "n": n, "first": i == 0} for i, (y, n) in enumerate(kinds.items())]
            yield pa.RecordBatch.from_pylist(rows)

    made = rows.mapInArrow(pack, BLOCKS).persist()
    tasks = made.mapInArrow(count, "made long, width long, y double, n long, first boolean")
    found = tasks.groupBy("y").agg(F.sum("n"), F.max("width"), F.sum(F.when(F.col("first"), F.col("made"))), F.sum(F.col("first").cast("int"))).collect()
    found = sorted(tuple(v or 0 for v in r) for r in found)
    total, full = sum(r[3] for r in found), sum(r[4] for r in found)
    values = [r[0] for r in found]
    classes = [int(v) for v in values] if numbers else named
    cores, partitions = df.sparkSession.sparkContext.defaultParallelism, made.rdd.getNumPartitions()
    most, least = max(cores, -(-sum(r[1] for r in found) // PACKED_ROWS_PER_TASK)), min(cores, total)
    ready = made
    if numbers and values != [float(i) for i in range(len(values))]:
        ready = ready.mapInArrow(lambda batches: _numbered(batches, values), BLOCKS)
    if full < least or partitions > most:
        ready = ready.repartition(least) if full < least else ready.coalesce(most)
    if ready is not made:
        ready.persist().count()
        made.unpersist()
    counts = {i: r[1] for i, r in enumerate(found)} if numbers else {int(r[0]): r[1] for r in found}
    return Packed(ready, classes, counts, max((r[2] for r in found), default=0))


def _numbered(batches: Iterator[pa.RecordBatch], values: Sequence[float]) -> Iterator[pa.RecordBatch]:
    """Packed blocks whose targets are the places of the labels among ``values``."""
    for batch in batches:
        y = [np.searchsorted(values, np.frombuffer(v.as_buffer())).astype(np.float64).tobytes() for v in batch["y"]]
        at = batch.schema.get_field_index("y")
        yield batch.set_column(at, "y", pa.array(y, pa.binary()))


def _blocks_of(table: pa.Table, made: int = 0, lifted: int = 1) -> Iterator[pa.RecordBatch]:
    x, y, fold = matrix(table["features"]), table["y"].to_numpy(), table["fold"].combine_chunks().fill_null(-1).to_numpy()
    size = max(1, min(PACKED, PACKED_NUMBERS // max(x.shape[1], 1), LIFTED_NUMBERS // lifted))
    for number, start in enumerate(range(0, len(x), size), made):
        part = slice(start, start + size)
        order = np.lexsort((y[part], fold[part]))
        mine, kind, held = x[part][order], y[part][order], fold[part][order]
        first = np.concatenate([[0], np.flatnonzero((np.diff(kind) != 0) | (np.diff(held) != 0)) + 1])
        values = (mine, held[first].astype(np.int32), kind[first].astype(np.float64), np.diff([*first, len(mine)]).astype(np.int32))
        row = [pa.array([n], pa.int32()) for n in (number % WARM, mine.shape[1])] + [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values]
        yield pa.RecordBatch.from_arrays(row, schema=_BLOCK_SCHEMA)


def block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int, list[tuple[int, float, slice]]]]:
    """(rows, width, [(fold, target, place of its rows)]) of every packed block."""
    for batch in batches:
        for i in range(batch.num_rows):
            width = batch["width"][i].as_py()
            x = np.frombuffer(batch["features"][i].as_buffer()).reshape(-1, width)
            fold, runs = (np.frombuffer(batch[n][i].as_buffer(), np.int32) for n in ("fold", "runs"))
            ends = np.cumsum(runs)
            places = [slice(int(e - n), int(e)) for e, n in zip(ends, runs)]
            yield x, width, list(zip(fold.tolist(), np.frombuffer(batch["y"][i].as_buffer()).tolist(), places))


def _columns(x: np.ndarray, runs: Sequence[tuple[int, float, slice]]) -> dict[str, np.ndarray]:
    long = [at.stop - at.start for *_, at in runs]
    return {"features": x, "y": np.repeat([y for _, y, _ in runs], long), "fold": np.repeat([f for f, *_ in runs], long)}


def pass_columns(table: DataFrame) -> DataFrame:
    """What a pass reads of a training table or of packed blocks."""
    return table if "runs" in table.columns else table.select("features", "y", "fold")


def blocks(batches: Iterator[pa.RecordBatch], lift: Lift | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Blocks of features, y and fold from a training table or from packed blocks; ``lift`` turns the stored features into those read."""
    for batch in batches:
        if not batch.num_rows:
            continue
        found = (_columns(x, runs) for x, _, runs in block_runs([batch])) if "runs" in batch.schema.names else [block_columns(batch)]
        for block in found:
            yield block if lift is None else block | {"features": lift(block["features"])}


def sharded(table: DataFrame, shards: int = 0, salt: int = 0) -> DataFrame:
    """(features, y, fold, copies, shard): a training table dealt into virtual shards by content, each in one order; cached.

    What a walk over the shards learns depends on their number alone, not on the layout of the table, the tasks or the
    cluster. Without a number there is one for ``ROWS_PER_SHARD`` rows (``LEAST_SHARDS`` at least), so tasks grow with the
    rows. Equal rows are counted first and dealt in pieces of up to ``PIECE`` copies, so a row that is a third of the table
    spreads over all shards. The caller unpersists it.
    """
    shards = shards or max(LEAST_SHARDS, -(-table.count() // ROWS_PER_SHARD))
    counted = table.groupBy("features", "y", "fold").agg(F.count("*").alias("n"))
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE))))
    mark = F.xxhash64("features", "y", "fold", "piece", F.lit(salt))
    rows = pieces.select("features", "y", "fold", F.least(F.lit(PIECE), F.col("n") - F.col("piece") * PIECE).cast("int").alias("copies"), mark.alias("mark"))
    dealt = rows.withColumn("shard", F.pmod("mark", F.lit(shards)).cast("int")).repartition(shards, "shard")
    return dealt.sortWithinPartitions("shard", "mark", "y", "fold", "features").drop("mark").persist()


def shard_batches(batches: Iterator[pa.RecordBatch], size: int, used=None) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(shard, block of ``size`` rows) of the shards of a task, the last of a shard shorter; ``used`` picks the rows that count.

    Blocks are cut by shard alone, so Arrow's batches leave no trace. Of a table that was not dealt a task's rows are one
    shard, and every row counts once.
    """
    current, held = -1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = block_columns(batch)
        if "shard" not in block:
            block["shard"], block["copies"] = (np.full(batch.num_rows, v) for v in (0, 1))
        index = np.repeat(np.arange(batch.num_rows), block["copies"])
        if used is not None:
            index = index[used(block)[index]]
        shard = block["shard"][index]
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for part in np.split(index, cuts):
            if not len(part):
                continue
            if (now := int(block["shard"][part[0]])) != current:
                if held is not None and len(held["y"]):
                    yield current, held
                current, held = now, None
            more = {name: block[name][part] for name in ("features", "y", "fold")}
            held = more if held is None else {name: np.concatenate([held[name], more[name]]) for name in more}
            whole = len(held["y"]) // size * size
            for start in range(0, whole, size):
                yield current, {name: values[start : start + size] for name, values in held.items()}
            held = {name: values[whole:] for name, values in held.items()}
    if held is not None and len(held["y"]):
        yield current, held


def _stepper(theta: np.ndarray, max_iter: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray, np.ndarray], np.ndarray]:
    """Limited-memory quasi-Newton descent, orthant-wise where an L1 penalty applies.

    Yields trial points, receives (smooth value, gradient, L1 strength per weight). See
    Andrew and Gao, "Scalable Training of L1-Regularized Log-Linear Models", ICML 2007.
    """
    smooth, gradient, l1 = yield theta
    value = smooth + l1 @ np.abs(theta)
    pairs: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=MEMORY)
    for _ in range(max_iter):
        steep = _pseudo_gradient(theta, gradient, l1)
        if np.max(np.abs(steep)) < tol:
            return theta
        way = -_curved(steep, pairs)
        way[(l1 > 0) & (way * steep >= 0)] = 0.0
        if way @ steep >= 0:
            pairs.clear()
            way = -steep
        orthant = np.where(theta != 0, np.sign(theta), -np.sign(steep))
        length = 1.0 if pairs else min(1.0, 1.0 / np.linalg.norm(steep))
        for _ in range(30):
            trial = theta + length * way
            trial[(l1 > 0) & (np.sign(trial) != orthant)] = 0.0
            smooth_t, gradient_t, _ = yield trial
            value_t = smooth_t + l1 @ np.abs(trial)
            if value_t <= value + 1e-4 * (steep @ (trial - theta)):
                break
            length *= 0.5
        else:
            return theta
        moved, turned = trial - theta, gradient_t - gradient
        if moved @ turned > 1e-12:
            pairs.append((moved, turned))
        gain = value - value_t
        theta, gradient, value = trial, gradient_t, value_t
        if gain <= tol * max(abs(value), 1e-12) * 1e-2:
            return theta
    return theta


def _newton(theta: np.ndarray, max_iter: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Newton descent; an L1 penalty enters the local quadratic model.

    Yields trial points, receives (smooth value, gradient, L1 strength, curvature). An
    accepted trial already carries the next curvature, so a full step costs one pass. See
    Lee, Sun and Saunders, "Proximal Newton-type methods", SIAM J. Optim. 2014.
    """
    smooth, gradient, l1, curved = yield theta
    value = smooth + l1 @ np.abs(theta)
    for _ in range(max_iter):
        if np.max(np.abs(_pseudo_gradient(theta, gradient, l1))) < tol:
            return theta
        damped = curved + np.eye(len(theta)) * (1e-9 * np.trace(curved) / len(theta) + 1e-12)
        way = _quadratic_step(theta, gradient, l1, damped)
        fall = gradient @ way + l1 @ (np.abs(theta + way) - np.abs(theta))
        if fall >= 0:
            return theta
        length = 1.0
        for _ in range(30):
            trial = theta + length * way
            smooth_t, gradient_t, _, curved_t = yield trial
            value_t = smooth_t + l1 @ np.abs(trial)
            if value_t <= value + 1e-4 * length * fall:
                break
            length *= 0.5
        else:
            return theta
        gain = value - value_t
        theta, gradient, curved, value = trial, gradient_t, curved_t, value_t
        if gain <= 1e-2 * tol * max(abs(value), 1e-12):
            return theta
    return theta


def _quadratic_step(theta: np.ndarray, gradient: np.ndarray, l1: np.ndarray, curved: np.ndarray) -> np.ndarray:
    """Minimiser of the local quadratic model; with an L1 penalty, a bounded number of coordinate sweeps.

    Every sweep lowers the model, so stopping early still gives a direction of descent.
    """
    if not l1.any():
        return np.linalg.solve(curved, -gradient)
    here, slope, diagonal, share = theta.tolist(), gradient.copy(), np.diag(curved).tolist(), l1.tolist()
    for _ in range(SWEEPS):
        biggest = 0.0
        for i, bend in enumerate(diagonal):
            target = here[i] - float(slope[i]) / bend
            limit = share[i] / bend
            best = target - limit if target > limit else target + limit if target < -limit else 0.0
            move = best - here[i]
            if move:
                slope += move * curved[i]
                here[i] = best
                biggest = max(biggest, abs(move))
        if biggest < 1e-7 * (1.0 + max(map(abs, here))):
            break
    return np.array(here) - theta


def _pseudo_gradient(theta: np.ndarray, gradient: np.ndarray, l1: np.ndarray) -> np.ndarray:
    at_zero = np.sign(gradient) * np.maximum(0.0, np.abs(gradient) - l1)
    return np.where(theta != 0, gradient + l1 * np.sign(theta), at_zero)


def _curved(steep: np.ndarray, pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Inverse-curvature estimate times the gradient, from the remembered steps."""
    way = steep.copy()
    shares = []
    for moved, turned in reversed(pairs):
        share = (moved @ way) / (moved @ turned)
        way -= share * turned
        shares.append(share)
    if pairs:
        moved, turned = pairs[-1]
        way *= (moved @ turned) / (turned @ turned)
    for (moved, turned), share in zip(pairs, reversed(shares)):
        way += (share - (turned @ way) / (moved @ turned)) * moved
    return way


def fit_all(table: DataFrame, problems: Sequence[Problem], lift: Lift | None = None) -> int:
    """Fit every problem on a ``training_table`` or on packed blocks; results land in the problems. Returns the passes made over all rows.

    Over many packed blocks Newton steps begin where those over some of the blocks ended, if that is better than the plain
    start. What ends them is judged on all rows either way; a step from there is long past the slow early ones, so they go on
    to a hundredth of the tolerance, which ends nearer to the optimum than the plain start does.
    """
    partitions = table.rdd.getNumPartitions()
    starts = [p.family.start(p.seed) if p.theta is None else p.theta for p in problems]
    warm = _warm(table, problems, starts, lift)
    steppers = {i: (_newton if p.newton else _stepper)(start, p.max_iter, p.tol) for i, (p, start) in enumerate(zip(problems, starts))}
    points = {i: next(stepper) for i, stepper in steppers.items()}
    passes = 0
    while points:
        order = sorted(points)
        tried, at = [problems[i] for i in order], [points[i] for i in order]
        if warm:
            tried, at = tried + [problems[i] for i in warm], at + list(warm.values())
        answers = _evaluate(table, tried, at, partitions, curved=True, lift=lift)
        passes += 1
        replies = {i: _mean_reply(problems[i], points[i], answer) for i, answer in zip(order, answers)}
        for (i, point), answer in zip(warm.items(), answers[len(order) :]):
            reply = _mean_reply(problems[i], point, answer)
            if reply[0] + reply[2] @ np.abs(point) < replies[i][0] + replies[i][2] @ np.abs(points[i]):
                steppers[i] = _newton(point, problems[i].max_iter, max(problems[i].tol / 100, min(problems[i].tol, LEAST_TOL)))
                points[i], replies[i] = next(steppers[i]), reply
        warm = {}
        for i in order:
            problems[i].value, problems[i].passes = replies[i][0], passes
            try:
                points[i] = steppers[i].send(replies[i])
            except StopIteration as done:
                problems[i].theta = done.value
                del points[i]
    return passes


def _warm(table: DataFrame, problems: Sequence[Problem], starts: Sequence[np.ndarray], lift: Lift | None) -> dict[int, np.ndarray]:
    """Where the Newton problems end over one of ``WARM`` blocks each task holds, under penalties of that share; nothing for few blocks."""
    chosen = [i for i, p in enumerate(problems) if p.newton]
    if "runs" not in table.columns or not chosen:
        return {}
    every, some = table.agg(F.count("*"), F.count_if(F.col("part") == 0)).first()
    if every < WARM_BLOCKS or not some:
        return {}
    trial = [replace(problems[i], l1=problems[i].l1 * some / every, l2=problems[i].l2 * some / every, theta=starts[i]) for i in chosen]
    part = table.filter(F.col("part") == 0).repartition(min(some, table.sparkSession.sparkContext.defaultParallelism)).withColumn("part", F.lit(1)).persist()
    try:
        fit_all(part, trial, lift)
    finally:
        part.unpersist()
    return {i: t.theta for i, t in zip(chosen, trial)}


def _mean_reply(problem: Problem, point: np.ndarray, answer: np.ndarray) -> tuple:
    """Sums over the table as the per-weight mean values a stepper expects, L2 penalty included."""
    size = problem.family.size
    weight, loss, gradient, rest = answer[0], answer[1], answer[2 : 2 + size], answer[2 + size :]
    weight = max(weight, 1e-300)
    mask = problem.family.penalised()
    reply = (
        (loss + 0.5 * problem.l2 * np.sum(mask * point * point)) / weight,
        (gradient + problem.l2 * mask * point) / weight,
        problem.l1 * mask / weight,
    )
    return (*reply, (rest.reshape(size, size) + problem.l2 * np.diag(mask)) / weight) if len(rest) else reply


def _evaluate(
    table: DataFrame, problems: Sequence[Problem], points: Sequence[np.ndarray], partitions: int, curved: bool = False, lift: Lift | None = None
) -> list[np.ndarray]:
    """Per problem, in one pass: weight sum, loss sum, gradient sum and, for Newton steps, the curvature sum."""
    bare = [p.bare() for p in problems]
    sizes = [2 + p.family.size + (p.family.size**2 if curved and p.newton else 0) for p in problems]
    rows = pass_columns(table)
    joined = _joined(bare, sizes) if "runs" in rows.columns else []
    apart = sorted(set(range(len(bare))) - {i for members in joined for i in members})

    def add(total: np.ndarray, problem: Problem, point: np.ndarray, block: dict[str, np.ndarray], seen: dict[tuple, tuple]) -> None:
        """Add the rows of a block; ``seen`` keeps them for the problems that see them alike."""
        alike = problem.sight()
        if alike not in seen:
            y, weight = problem.rows(block)
            used = weight > 0
            seen[alike] = problem.view(block["features"])[used], y[used], weight[used]
        x, y, weight = seen[alike]
        if not len(y):
            return
        loss, gradient = problem.family.loss_and_gradient(x, y, weight, point)
        total[0] += weight.sum()
        total[1] += loss
        total[2 : 2 + len(gradient)] += gradient
        if len(total) > 2 + len(gradient):
            total[2 + len(gradient) :] += problem.family.curvature(x, y, weight, point).ravel()

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        totals = [np.zeros(size) for size in sizes]
        if joined:
            parts = [_Joined([bare[i] for i in members], [points[i] for i in members]) for members in joined]
            for x, _, runs in block_runs(batches):
                x = x if lift is None else lift(x)
                for fold, y, at in runs:
                    shared: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
                    for part in parts:
                        part.add(x[at], fold, y, shared)
                columns, seen = _columns(x, runs) if apart else {}, {}
                for i in apart:
                    add(totals[i], bare[i], points[i], columns, seen)
            for members, part in zip(joined, parts):
                for i, total in zip(members, part.totals()):
                    totals[i] = total
        else:
            for block in blocks(batches, lift):
                seen: dict[tuple, tuple] = {}
                for total, problem, point in zip(totals, bare, points):
                    add(total, problem, point, block, seen)
        return np.concatenate(totals)

    flat = summed(rows, work, partitions) if sum(sizes) * partitions <= NUMBERS else summed_apart(rows, work)
    return np.split(flat, np.cumsum(sizes)[:-1])


def _joined(problems: Sequence[Problem], sizes: Sequence[int]) -> list[list[int]]:
    """Places of the linear problems with curvature that can be evaluated together: same loss, targets, weights, held-out fold and first column."""
    found: dict[tuple, list[int]] = {}
    for i, p in enumerate(problems):
        if isinstance(p.family, Linear) and p.family.outputs == 1 and p.family.features <= JOINED and sizes[i] > 2 + p.family.size:
            start = p.span[0] if p.span else 0
            same = (p.family.loss, p.family.margin, p.positive, p.holdout, start, tuple(sorted(p.class_weight.items())))
            found.setdefault(same, []).append(i)
    return list(found.values())


class _Joined:
    """Sums of linear problems that ``_joined`` put together; each reads the first columns of their common part, one line a problem."""

    def __init__(self, problems: Sequence[Problem], points: Sequence[np.ndarray]):
        self.problems, first = problems, problems[0]
        self.family, self.holdout, self.positive, self.shares = first.family, first.holdout, first.positive, first.class_weight
        self.start, self.width = first.span[0] if first.span else 0, max(p.family.features for p in problems)
        self.points = np.zeros((len(problems), self.width + 1))
        for line, p, point in zip(self.points, problems, points):
            line[: p.family.features], line[-1] = point[:-1], point[-1]
        self.pairs = np.triu_indices(self.width + 1)
        self.weight, self.loss = 0.0, np.zeros(len(problems))
        self.gradient, self.curved = np.zeros_like(self.points), np.zeros((len(problems), len(self.pairs[0])))

    def add(self, x: np.ndarray, fold: int, y: float, shared: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> None:
        """Add rows of one fold and target; ``shared`` keeps the rows by column, and products of two columns, for other problems."""
        share = self.shares.get(int(y), 1.0)
        if fold == self.holdout or not share:
            return
        place = self.start, self.width
        if place not in shared:
            columns = np.ones((self.width + 1, len(x)))
            columns[:-1] = x[:, self.start : self.start + self.width].T
            products, row = np.empty((len(self.pairs[0]), len(x))), 0
            for i in range(self.width + 1):
                row += np.multiply(columns[i], columns[i:], out=products[row : row + self.width + 1 - i]).shape[0]
            shared[place] = columns, products
        columns, products = shared[place]
        loss, slope, bend = self.family.sums(self.points @ columns, y if self.positive is None else float(y == self.positive))
        self.weight += share * len(x)
        self.loss += share * loss
        self.gradient += share * (slope @ columns.T)
        self.curved += share * (bend @ products.T)

    def totals(self) -> Iterator[np.ndarray]:
        """What ``_evaluate`` returns, by problem."""
        for p, loss, gradient, bend in zip(self.problems, self.loss, self.gradient, self.curved):
            whole = np.zeros((self.width + 1, self.width + 1))
            whole[self.pairs] = whole[self.pairs[::-1]] = bend
            used = [*range(p.family.features), self.width]
            yield np.concatenate([[self.weight, loss], gradient[used], whole[np.ix_(used, used)].ravel()])


def gradient_at(table: DataFrame, problem: Problem, theta: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Mean penalised loss, its gradient, and the total weight at one point."""
    answer = _evaluate(table, [problem], [theta], table.rdd.getNumPartitions())[0]
    if answer[0] == 0:
        return 0.0, np.zeros_like(theta), 0.0
    value, slope, _ = _mean_reply(problem, theta, answer)
    return value, slope, answer[0]


@dataclass
class Descent:
    """Mini-batch settings for ``descend``."""

    batch_size: int = 200
    eta0: float = 0.5
    rate: str = "constant"
    power: float = 0.25
    epochs: int = 200
    tol: float = 1e-5
    momentum: float = 0.0
    decay: float = 0.0


def descend(table: DataFrame, problem: Problem, how: Descent, watch=None) -> np.ndarray:
    """Mini-batch gradient descent over a ``sharded`` table: every shard is walked from the same weights, which are averaged once per epoch.

    One job per epoch whatever the batch size (parallelised SGD, Zinkevich et al., NIPS
    2010); with one shard it is plain sequential SGD. ``watch(epoch, theta, cost)`` may
    record a trace.
    """
    theta = problem.family.start(problem.seed) if problem.theta is None else problem.theta
    velocity = np.zeros_like(theta)
    before = np.inf
    for epoch in range(1, how.epochs + 1):
        eta = how.eta0 / epoch**how.power if how.rate == "invscaling" else how.eta0
        theta, velocity, cost = _epoch(table, problem, how, theta, velocity, eta)
        if watch:
            watch(epoch, theta, cost)
        if abs(cost - before) < how.tol:
            break
        before = cost
    problem.theta, problem.value = theta, cost
    return theta


def _epoch(
    table: DataFrame, problem: Problem, how: Descent, theta: np.ndarray, velocity: np.ndarray, eta: float
) -> tuple[np.ndarray, np.ndarray, float]:
    bare = problem.bare()
    size = problem.family.size

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        mask = bare.family.penalised()
        total = np.zeros(2 + 2 * size)
        walked, rows = -1, 0.0
        point, speed = theta.copy(), velocity.copy()

        def leave() -> None:
            total[2:] += rows * np.concatenate([point, speed])
            total[0] += rows

        for shard, block in shard_batches(batches, how.batch_size, lambda block: bare.rows(block)[1] > 0):
            if shard != walked:
                leave()
                walked, rows, point, speed = shard, 0.0, theta.copy(), velocity.copy()
            y, weight = bare.rows(block)
            share = weight.sum()
            loss, slope = bare.family.loss_and_gradient(bare.view(block["features"]), y, weight, point)
            slope = (slope + bare.l2 * mask * point) / share + how.decay * mask * point
            speed = how.momentum * speed - eta * slope
            point = point + speed
            rows += share
            total[1] += loss + 0.5 * bare.l2 * np.sum(mask * point * point) * share / max(len(y), 1)
        leave()
        return total

    flat = summed(table, work, table.rdd.getNumPartitions())
    rows = max(flat[0], 1e-300)
    return flat[2 : 2 + size] / rows, flat[2 + size :] / rows, flat[1] / rows

