"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries become fixed-point integers; the fit list holds every distinct vector once, packed in blocks. A pass takes an
orthonormal block Q to V Q = X'(X Q) / n over the centred fit list: tasks sum d x b products, executors add them up, and
the driver holds nothing larger than d x b. The covariance itself is never formed.

A few Lanczos passes bound the spectrum from below. Then each round applies a Chebyshev polynomial by its three-term
recurrence, one pass a degree, which damps everything between that bound and the smallest Ritz value; QR and Rayleigh-Ritz
turn the block into eigenvector estimates. Rounds end when the residuals |V u - e u| of all wanted components are at
rounding level and Lanczos passes over the rest of the space find no larger eigenvalue. A last pass measures the covariance
of the whitened fit list.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.llm.common import query, record, stored
from loomtab.models.arrays import summed
from loomtab.session import load

SHIFT = 1_000_000
SCALE = 64
PACK = 4096
LANCZOS = 10
MAX_DEGREE = 24
ROUNDS = 100
PULL = 1e9
TOLERANCE = 2e-14
CERTIFIED = 1e-9
NULL_SHARE = 1e-12
LARGEST = 2.0**46


@dataclass
class Whitening:
    """The fitted map: n distinct vectors, sums of the unshifted entries, unit eigenvectors by column and eigenvalues."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def weights(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def usable(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vector) of rows whose entries are all present, finite and within 2^46, in the table's usual width."""
    entries = F.col(vector).cast("array<double>")
    rows = embeddings.select(F.col(key).alias("vec_id"), entries.alias("vector")).filter(
        F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    )
    usual = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "width")).alias("top")).first()["top"]
    return rows.filter(F.size("vector") == (usual["width"] if usual else 0))


def fixed_point(column: pa.Array) -> np.ndarray:
    """floor(SCALE * c) of every entry, one row a vector; the shift is left out, for it cancels against the mean."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(column), -1)


def packed(rows: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest of 2, 4 or 8 bytes an entry that holds it, so equal vectors are equal bytes."""
    reach = np.maximum(rows.max(axis=1, initial=0), -1 - rows.min(axis=1, initial=0))
    narrow = {np.int16: reach < 1 << 15, np.int32: (reach >= 1 << 15) & (reach < 1 << 31), np.int64: reach >= 1 << 31}
    out: list[bytes] = [b""] * len(rows)
    for kind, here in narrow.items():
        for i, row in zip(np.flatnonzero(here), rows[here].astype(kind)):
            out[i] = row.tobytes()
    return out


def unpacked(blobs: list[bytes], width: int) -> np.ndarray:
    rows = np.empty((len(blobs), width), np.int64)
    size = np.array([len(b) // width for b in blobs])
    for kind in (np.int16, np.int32, np.int64):
        here = np.flatnonzero(size == np.dtype(kind).itemsize)
        if len(here):
            rows[here] = np.frombuffer(b"".join(blobs[i] for i in here), kind).reshape(len(here), width)
    return rows


def fit_list(rows: DataFrame) -> DataFrame:
    """(vectors, width): every distinct fixed-point vector once, in blocks of up to ``PACK``."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("x", pa.binary()), ("width", pa.int32())])
        for batch in batches:
            if len(batch):
                x = fixed_point(batch.column("vector"))
                yield record(schema, x=packed(x), width=np.full(len(x), x.shape[1], np.int32))

    def block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vectors", pa.list_(pa.binary())), ("width", pa.int32())])
        for batch in batches:
            for at in range(0, len(batch), PACK):
                part = batch.slice(at, PACK)
                yield record(schema, vectors=[part.column("x").to_pylist()], width=part.column("width")[:1])

    distinct = rows.select("vector").mapInArrow(pack, "x binary, width int").distinct()
    return distinct.mapInArrow(block, "vectors array<binary>, width int")


def over_blocks(fit: DataFrame, work) -> np.ndarray:
    """Sum of ``work`` over the tasks of one pass."""
    return summed(fit, work, fit.rdd.getNumPartitions())


def blocks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for vectors, width in zip(batch.column("vectors").to_pylist(), batch.column("width").to_pylist()):
            yield unpacked(vectors, width)


def centred(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, the numerator exact wherever 64 bits hold it."""
    if n * float(np.abs(rows).max(initial=0)) + float(np.abs(sums).max(initial=0)) < 2.0**62:
        return (n * rows - sums) / n
    return rows - sums / n


def moments(fit: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums; sums travel as two halves, each exact in a double."""

    def work(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        n, total = 0, np.zeros(width, np.int64)
        for rows in blocks_of(batches):
            n, total = n + len(rows), total + rows.sum(axis=0)
        return np.concatenate([[n], total >> 26, total & ((1 << 26) - 1)]).astype(float)

    out = over_blocks(fit, work)
    high, low = out[1 : width + 1].astype(np.int64), out[width + 1 :].astype(np.int64)
    return int(out[0]), (high << 26) + low


def covariance_times(fit: DataFrame, n: int, sums: np.ndarray, block: np.ndarray) -> np.ndarray:
    """V Q by one pass."""
    shape = block.shape

    def work(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(shape)
        for rows in blocks_of(batches):
            y = centred(rows, n, sums)
            total += y.T @ (y @ block)
        return total.ravel()

    return over_blocks(fit, work).reshape(shape) / n


def total_variance(fit: DataFrame, n: int, sums: np.ndarray) -> float:
    def work(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        return np.array([sum(float((centred(rows, n, sums) ** 2).sum()) for rows in blocks_of(batches))])

    return float(over_blocks(fit, work)[0]) / n


def lanczos_ends(times, start: np.ndarray, without: np.ndarray, steps: int = LANCZOS) -> tuple[float, float]:
    """Bounds (low, high) of the spectrum on the complement of ``without``: extreme Ritz values, each moved out by its residual."""

    def rest(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - without @ (without.T @ x)
        return x

    q = rest(start)
    q /= np.linalg.norm(q)
    basis, diagonal, beside = [q], [], []
    while True:
        w = rest(times(basis[-1][:, None])[:, 0])
        diagonal.append(basis[-1] @ w)
        for _ in range(2):
            w -= np.array(basis).T @ (np.array(basis) @ w)
        left = float(np.linalg.norm(w))
        if len(basis) == min(steps, len(start) - without.shape[1]) or left <= 1e-13 * max(abs(x) for x in diagonal) or left == 0:
            break
        beside.append(left)
        basis.append(w / left)
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
    off = left * np.abs(vectors[-1])
    return float(values[0] - off[0]), float(values[-1] + off[-1])


def chebyshev(times, block: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The block under the Chebyshev polynomial that is small on [low, high] and scaled to one at ``top``."""
    half, middle = (high - low) / 2, (high + low) / 2
    ratio = half / (top - middle)
    first = ratio
    before, now = block, (times(block) - middle * block) * (ratio / half)
    for _ in range(degree - 1):
        ratio_next = 1 / (2 / first - ratio)
        before, now = now, (times(now) - middle * now) * (2 * ratio_next / half) - (ratio * ratio_next) * before
        ratio = ratio_next
    return now


def leading_components(times, width: int, want: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues, falling, and unit eigenvectors of the symmetric map ``times``.

    Settled vectors leave the block and are projected out of every later product, so a very large eigenvalue does not
    drown the others; the degree of a round is bounded by how far it would pull the block's own columns together.
    """
    draw = np.random.default_rng(seed)
    block = np.linalg.qr(draw.standard_normal((width, min(width, max(2 * want, want + 8)))))[0]
    settled, found = np.empty((width, 0)), np.empty(0)

    def beside(x: np.ndarray) -> np.ndarray:
        return x - settled @ (settled.T @ x)

    low, top, best, probed = None, 0.0, np.inf, False
    for _ in range(ROUNDS):
        image = beside(times(block))
        values, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        top = max(top, values[0], 1e-300)
        off = np.linalg.norm(image - block * values, axis=0) / top
        left = want - len(found)
        worst = float(off[:left].max())
        stuck = worst <= CERTIFIED and worst > best / 4  # rounding stops further gain
        whole = len(found) + block.shape[1] == width
        ready = left if whole or stuck else int(np.argmax(np.append(off[:left] > TOLERANCE, True)))
        settled, found = np.hstack([settled, block[:, :ready]]), np.append(found, values[:ready])
        block, values = block[:, ready:], values[ready:]
        if len(found) == want:
            if whole or probed or not len(values):
                break
            probed = True
            if lanczos_ends(times, draw.standard_normal(width), np.hstack([settled, block]))[1] <= found.min() * (1 + 1e-9):
                break
            order = np.argsort(-found)  # one more was hidden: let the smallest go and look again
            block, values = np.hstack([settled[:, order[-1:]], block]), np.append(found[order[-1:]], values)
            settled, found = settled[:, order[:-1]], found[order[:-1]]
            worst = 1.0
        best = np.inf if ready else worst
        if low is None:
            low = max(0.0, lanczos_ends(times, draw.standard_normal(width), np.zeros((width, 0)))[0])
        if values[-1] < low:  # the bound was too high and let the low end grow
            low = 0.0
        high = max(values[-1], low + 1e-6 * values[0], 1e-14 * top)
        reach = [np.arccosh(max(1 + 1e-9, (2 * v - low - high) / (high - low))) for v in (values[min(want - len(found), len(values)) - 1], values[0])]
        degree = min(np.ceil(np.log(4e14 * max(worst, 1e-14)) / reach[0]), np.log(PULL) / reach[1], MAX_DEGREE)
        block = chebyshev(lambda x: beside(times(x)), block, max(1, int(degree)), low, high, max(values[0], high * (1 + 1e-9)))
        block = np.linalg.qr(beside(np.linalg.qr(block)[0]))[0]
    else:
        raise ArithmeticError(f"components did not settle in {ROUNDS} rounds: residual {worst:.1e}")
    order = np.argsort(-found, kind="stable")
    order = order[found[order] > NULL_SHARE * top]
    vectors = settled[:, order] / np.linalg.norm(settled[:, order], axis=0)
    lead = np.abs(vectors).argmax(axis=0)
    return found[order], vectors * np.where(vectors[lead, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def fit_whitening(rows: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of usable rows; None where there are none."""
    fit = stored(fit_list(rows), "vectors")
    head = fit.select("width").first()
    if head is None:
        return None
    width = head["width"]
    n, sums = moments(fit, width)
    trace = total_variance(fit, n, sums)
    if not trace > 0:
        return Whitening(n, sums, np.empty((width, 0)), np.empty(0), trace, 0.0)
    values, vectors = leading_components(lambda q: covariance_times(fit, n, sums, q), width, min(components, width))
    out = Whitening(n, sums, vectors, values, trace, 0.0)
    weights, count = out.weights, len(values)

    def work(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        total, products = np.zeros(count), np.zeros((count, count))
        for x in blocks_of(batches):
            z = centred(x, n, sums) @ weights
            total, products = total + z.sum(axis=0), products + z.T @ z
        return np.append(total, products.ravel())

    seen = over_blocks(fit, work) / n
    covariance = seen[count:].reshape(count, count) - np.outer(seen[:count], seen[:count])
    out.identity_error = float(np.abs(covariance - np.eye(count)).max())
    return out


def whiten(embeddings: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, holds null or non-finite entries or entries of 2^46 and more, or has another width than
    most rows (the wider of equally common ones) are dropped. Repeated rows are all returned but fit once; rows without an id
    are returned without one. Components without variance (under 1e-12 of the largest) are left out, so a table of one vector,
    like an empty one, gives no rows. Equal eigenvalues share a plane, in which any basis may be returned. Where the exact
    deviation exceeds a long it is null. Other columns are not read.
    """
    rows = usable(embeddings, key, vector)
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit_whitening(rows, components)
    if fitted is None or not len(fitted.values):
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, weights = fitted.n, fitted.sums, fitted.weights
    shares, error, count = fitted.values / fitted.trace, fitted.identity_error, len(fitted.values)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PACK):
                part = batch.slice(at, PACK)
                x = fixed_point(part.column("vector"))
                y = centred(x, n, sums)
                fits = (y * y).sum(axis=1) * float(n) ** 2 < 2.0**62
                with np.errstate(over="ignore"):
                    deviation = ((n * x - sums) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), count))),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * count, n)),
                        pa.array(np.repeat(deviation, count), mask=np.repeat(~fits, count)),
                        pa.array((y @ weights).ravel()),
                        pa.array(np.tile(shares, len(x))),
                        pa.array(np.full(len(x) * count, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, schema)


@query()
def op13_whitening(spark, folder):
    """Sixteen whitened components of every embedding."""
    return whiten(load(spark, folder, "embeddings"))
