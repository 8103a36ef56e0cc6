"""Exact nearest-neighbour and radius joins between two vector tables.

A small train side (its size is measured first) is broadcast and every query batch is
matched against it. A large one is described by cells around pivot rows; triangle-inequality
bounds tell which cells can hold a neighbour of a query, and where they rule out enough,
measured on a bounded sample, the query is sent only there. Cells are cut further into
blocks of bounded size on both sides, so a crowded cell becomes many tasks. Where the
bounds rule out little (many dimensions), queries are dealt into chunks and every chunk's
task reads the train rows once, as a stream of packed blocks. Tasks hold k candidates (or
partial sums) per query, never the pairs they compared. All routes give the same rows.

The pivot scheme follows Lu et al., "Efficient Processing of k Nearest Neighbor Joins
using MapReduce", PVLDB 2012.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtab.functions.hashing import key_hash
from loomtab.operators.boxes import NARROW
from loomtab.operators.pairs import DIGITS, SUMS, Points, Rule, Search, finite, pair_distances
from loomtab.session import shuffle_width

TILE = 4_000_000  # bounds held at once per task
HELD = 32_768  # queries a task holds while the train rows pass by
PACKED = 1024  # train rows in a packed block
SAMPLE = 2048  # queries whose cells are counted to choose a route


@dataclass(frozen=True)
class Side:
    """One vector table of a join: its key, vector and (optional) value and exclusion columns."""

    df: DataFrame
    key: str
    vector: str
    value: str | None = None
    exclude: str | None = None

    def prepared(self) -> DataFrame:
        value = F.col(self.value).cast("double") if self.value else F.lit(0.0)
        exclude = F.col(self.exclude).cast("bigint") if self.exclude else F.lit(0).cast("bigint")
        return self.df.select(
            F.col(self.key).cast("bigint").alias("id"),
            F.col(self.vector).cast("array<double>").alias("vec"),
            value.alias("value"),
            exclude.alias("exclude"),
        )


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(array) == 0:
        return np.empty((0, 0))
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def _groups(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Exclusion groups; a null is NaN, equal to nothing."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.to_numpy(zero_copy_only=False)


NEIGHBOR = pa.list_(pa.struct([("distance", pa.float64()), ("id", pa.int64()), ("value", pa.float64())]))
NEIGHBOR_SQL = "array<struct<distance:double,id:bigint,value:double>>"


def _neighbor_batch(ids: np.ndarray, far: np.ndarray, near: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    held = np.isfinite(far)
    ends = np.concatenate([[0], np.cumsum(held.sum(1))]).astype("int32")
    items = pa.StructArray.from_arrays([pa.array(far[held]), pa.array(near[held]), pa.array(values[held])], names=["distance", "id", "value"])
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), items)], names=["id", "neighbors"])


def _answers(ids: np.ndarray, search: Search, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(ids), rows):
        part = slice(start, start + rows)
        if search.rule.k:
            yield _neighbor_batch(ids[part], search.far[part], search.ids[part], search.values[part])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), *[pa.array(s) for s in search.sums[part].T]], names=["id", *SUMS])


def _searched(ids: np.ndarray, queries: np.ndarray, exclude: np.ndarray, points: Points, rule: Rule) -> Iterator[pa.RecordBatch]:
    search = Search(queries, exclude, rule)
    search.see(points)
    return _answers(ids, search)


def _schema(rule: Rule) -> str:
    return f"id bigint, neighbors {NEIGHBOR_SQL}" if rule.k else "id bigint, " + ", ".join(f"{s} double" for s in SUMS)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches together, of about so many rows: the more queries a search knows, the closer together are those of a tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


_HELD: list[tuple[tuple, Points]] = []


def _held_points(arrays: tuple) -> Points:
    """Points of a broadcast table. A worker keeps the last ones with their boxes, as its next task mostly reads the same."""
    if not _HELD or _HELD[0][0] is not arrays:
        ids, vectors, values, groups = arrays
        _HELD[:] = [(arrays, finite(Points(ids, vectors.astype(float), values, groups)))]
    return _HELD[0][1]


def _against_broadcast(queries: DataFrame, train: DataFrame, rule: Rule) -> DataFrame:
    table = train.toArrow()
    arrays = (table["id"].to_numpy(), _narrow(_matrix(table["vec"])), table["value"].to_numpy(), _groups(table["exclude"]))
    shared = queries.sparkSession.sparkContext.broadcast(arrays)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = _held_points(shared.value)
        for held in _gathered(batches, HELD):
            yield from _searched(held["id"].to_numpy(), _matrix(held["vec"]), _groups(held["exclude"]), points, rule)

    spread, width = max(queries.sparkSession.sparkContext.defaultParallelism, shuffle_width(queries.sparkSession)), arrays[1].shape[1]
    # Where boxes rule points out, a task's queries lie side by side; the key deals equal ones.
    places = [F.get("vec", F.lit(i)) for i in range(width)]
    dealt = queries.repartitionByRange(spread, *places, "id") if 0 < width <= NARROW else queries.repartition(spread, "id")
    return dealt.mapInArrow(match, _schema(rule))


@dataclass
class Cells:
    """Pivots and what is known about the train rows around each of them."""

    pivots: np.ndarray
    rows: np.ndarray  # train rows per cell
    low: np.ndarray  # smallest distance to the pivot
    high: np.ndarray  # largest distance to the pivot
    close: tuple[np.ndarray, np.ndarray, np.ndarray]  # cell, reach and exclusion group of the rows nearest to each pivot
    first_block: np.ndarray
    blocks: np.ndarray


def _nearest_pivot(train: DataFrame, pivots: np.ndarray, rule: Rule) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = pair_distances(_matrix(batch["vec"]), pivots, rule.metric, rule.p)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype("int32")), pa.array(far[np.arange(len(cell)), cell])],
                names=[*batch.schema.names, "cell", "reach"],
            )

    return train.mapInArrow(assign, "id bigint, vec array<double>, value double, exclude bigint, cell int, reach double")


def _describe(train: DataFrame, rule: Rule, pivot_count: int, block_rows: int) -> tuple[DataFrame, Cells]:
    """Assign train rows to pivots and collect the bounded per-cell summary."""
    picked = train.orderBy(key_hash("id"), "id").limit(pivot_count).toArrow()
    pivots = _matrix(picked["vec"])
    celled = _nearest_pivot(train, pivots, rule)
    size = len(pivots)
    rows, low, high = np.zeros(size, int), np.zeros(size), np.zeros(size)
    for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("lo"), F.max("reach").alias("hi")).collect():
        rows[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["lo"], r["hi"]
    close = (np.empty(0, int), np.empty(0), np.empty(0, int))
    if rule.k:
        close = _close_rows(celled, rule)
    blocks = np.maximum(1, -(-rows // block_rows))
    return celled, Cells(pivots, rows, low, high, close, np.concatenate([[0], np.cumsum(blocks)[:-1]]), blocks)


def _close_rows(celled: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows nearest to each pivot, enough to bound a k-th distance whichever exclusion group a query leaves out.

    With at most k rows of a group, a query loses at most k of them, so 2k rows a cell are enough for any number of groups.
    """
    group = F.coalesce("exclude", "id") if rule.excluding else F.col("id")
    near = celled.select("cell", "reach", "id", group.alias("kind"))
    if rule.excluding:
        inner = Window.partitionBy("cell", "kind").orderBy("reach", "id")
        near = near.withColumn("rank", F.row_number().over(inner)).filter(F.col("rank") <= rule.k).drop("rank")
    count = 2 * rule.k if rule.excluding else rule.k
    outer = Window.partitionBy("cell").orderBy("reach", "id")
    kept = near.withColumn("rank", F.row_number().over(outer)).filter(F.col("rank") <= count)
    parts = []
    for r in kept.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("reach", "kind"))).alias("near")).collect():
        reach, kind = (np.array([n[c] for n in r["near"]]) for c in ("reach", "kind"))
        most = np.unique(kind, return_counts=True)[1].max() if rule.excluding else 0
        use = rule.k + most
        parts.append((np.full(len(reach[:use]), r["cell"]), reach[:use], kind[:use]))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, int), np.empty(0), np.empty(0, int))


def _kth_bound(far: np.ndarray, exclude: np.ndarray, cells: Cells, rule: Rule) -> np.ndarray:
    """For each query an upper bound on the distance to its k-th admissible neighbour."""
    if rule.radius:
        return np.full(len(far), rule.radius)
    out = np.full(len(far), np.inf)
    cell, reach, kind = cells.close
    if len(reach) < rule.k:
        return out
    step = max(1, TILE // len(reach))
    for start in range(0, len(far), step):
        part = slice(start, start + step)
        bounds = far[part][:, cell] + reach[None, :]
        if rule.excluding:
            bounds[exclude[part, None] == kind[None, :]] = np.inf
        out[part] = np.partition(bounds, rule.k - 1, axis=1)[:, rule.k - 1]
    return out


def _candidate_cells(queries: np.ndarray, exclude: np.ndarray, cells: Cells, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(query row, cell) pairs that the bounds cannot rule out."""
    far = pair_distances(queries, cells.pivots, rule.metric, rule.p)
    bound = _kth_bound(far, exclude, cells, rule)
    slack = (bound * (1 + 1e-9) + 10.0**-DIGITS)[:, None]
    home = far.min(1, keepdims=True)
    possible = (
        (cells.rows[None, :] > 0)
        & (far - cells.high[None, :] <= slack)
        & (cells.low[None, :] - far <= slack)
        & ((far - home) / 2.0 <= slack)
    )
    return np.nonzero(possible)


def _routed(queries: DataFrame, cells: Cells, rule: Rule, count_only: bool) -> DataFrame:
    """Send each query to the blocks of its candidate cells, or count how many would go where."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, cell = _candidate_cells(_matrix(batch["vec"]), _groups(batch["exclude"]), cells, rule)
            copies = cells.blocks[cell]
            offset = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            block = np.repeat(cells.first_block[cell], copies) + offset
            if count_only:
                blocks, n = np.unique(block, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(n)], names=["block", "n"])
                continue
            sent = pa.Table.from_batches([batch.select(["id", "vec", "exclude"])]).take(pa.array(np.repeat(rows, copies)))
            for piece in sent.append_column("block", pa.array(block)).to_batches(max_chunksize=20000):
                yield piece

    return queries.mapInArrow(
        route, "block bigint, n bigint" if count_only else "id bigint, vec array<double>, exclude bigint, block bigint"
    )


PACKS = "chunk int, kind int, n int, ids binary, vecs binary, narrow boolean, vals binary, groups binary, grouped binary"


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """In single precision, if that holds every value exactly: four bytes each, not eight."""
    with np.errstate(over="ignore"):
        single = vectors.astype(np.float32)
    return single if (single == vectors).all() else vectors


def _packed(batch: pa.RecordBatch, chunk: int, kind: int) -> dict:
    """Rows as bytes."""
    vectors, groups = _narrow(_matrix(batch["vec"])), batch["exclude"]
    return {
        "chunk": chunk, "kind": kind, "n": batch.num_rows, "ids": batch["id"].to_numpy().tobytes(),
        "vecs": vectors.tobytes(), "narrow": vectors.dtype == np.float32,
        "vals": batch["value"].to_numpy(zero_copy_only=False).astype(float).tobytes(),
        "groups": groups.fill_null(0).to_numpy().tobytes(), "grouped": groups.is_valid().to_numpy(zero_copy_only=False).tobytes(),
    }


def _unpacked(row: dict) -> Points:
    vectors = np.frombuffer(row["vecs"], np.float32 if row["narrow"] else np.float64).astype(float).reshape(row["n"], -1)
    groups, known = np.frombuffer(row["groups"], np.int64), np.frombuffer(row["grouped"], bool)
    if not known.all():
        groups = np.where(known, groups.astype(float), np.nan)
    return Points(np.frombuffer(row["ids"], np.int64), vectors, np.frombuffer(row["vals"]), groups)


def _merged(blocks: list[Points]) -> Points:
    return Points(*(np.concatenate([getattr(b, part) for b in blocks]) for part in ("ids", "vectors", "values", "exclude")))


def _chunks(queries: DataFrame, rows: int) -> int:
    """Two tasks a core, of at most HELD queries, but none of under 256."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-rows // HELD), min(2 * cores, rows // 256))


def _against_all(queries: DataFrame, train: DataFrame, rule: Rule, rows: int) -> DataFrame:
    """Every query against every train row: a task holds a chunk of the queries and reads the train rows as they come.

    The train rows are sent once to every chunk, so what is shuffled grows with their size times the chunks and a task's
    memory with neither. Only the k nearest of a query leave a task.
    """
    chunks = _chunks(queries, rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = batch["chunk"].to_numpy()
            rest = batch.append_column("value", pa.array(np.zeros(batch.num_rows))) if batch.num_rows else batch
            for c in np.unique(chunk):
                yield pa.RecordBatch.from_pylist([_packed(rest.take(pa.array(np.flatnonzero(chunk == c))), int(c), 0)], schema=PACKED_SCHEMA)

    def know(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PACKED):
                yield pa.RecordBatch.from_pylist([_packed(batch.slice(start, PACKED), 0, 1)], schema=PACKED_SCHEMA)

    dealt = queries.select("id", "vec", "exclude", (key_hash("id", 2) % chunks).cast("int").alias("chunk")).mapInArrow(ask, PACKS)
    sent = train.mapInArrow(know, PACKS).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    both = dealt.unionByName(sent).repartitionById(chunks, "chunk").sortWithinPartitions("chunk", "kind")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, asked, known, search = None, [], [], None

        def pass_by() -> None:
            nonlocal search
            if asked and search is None:
                held = _merged(asked)
                search = Search(held.vectors, held.exclude, rule)
            if search is not None and known:
                search.see(_merged(known))
            known.clear()

        def finish() -> Iterator[pa.RecordBatch]:
            pass_by()
            if search is not None:
                yield from _answers(np.concatenate([a.ids for a in asked]), search)

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["chunk"] != chunk:
                    yield from finish()
                    chunk, asked, known, search = row["chunk"], [], [], None
                (known if row["kind"] else asked).append(_unpacked(row))
                if len(known) == 8:
                    pass_by()
        yield from finish()

    return both.mapInArrow(match, _schema(rule))


PACKED_SCHEMA = pa.schema([
    ("chunk", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary()),
    ("narrow", pa.bool_()), ("vals", pa.binary()), ("groups", pa.binary()), ("grouped", pa.binary()),
])


def _cells_pay(queries: DataFrame, cells: Cells, rule: Rule, asked: int, known: int, width: int) -> bool:
    """Whether cells cost less than all rows to every chunk: pairs compared and bytes sent, which may be 16 times the input.

    Counted on some 2048 queries by key hash; it chooses the route, not the rows.
    """
    some = queries.filter(key_hash("id", 3) % max(1, asked // SAMPLE) == 0)
    per_block = np.repeat(cells.rows / cells.blocks, cells.blocks)
    sent = compared = 0.0
    for r in _routed(some, cells, rule, True).groupBy("block").agg(F.sum("n").alias("n")).collect():
        sent, compared = sent + r["n"], compared + r["n"] * per_block[r["block"]]
    scale, row, pair = asked / max(1, some.count()), 8 * (width + 3), 1 + width / 16
    cell_bytes, all_bytes = sent * scale * (row + 32 * rule.k), known * row * _chunks(queries, asked)
    cheaper = compared * scale * pair + 10 * cell_bytes < asked * known * pair + 10 * all_bytes
    return cheaper and cell_bytes <= max(all_bytes, 16 * (asked + known) * row)


def _against_blocks(
    queries: DataFrame, train: DataFrame, rule: Rule, pivots: int, block_rows: int, chunk_rows: int, known: int, width: int, strategy: str
) -> DataFrame:
    asked = queries.count()
    if strategy == "all":
        return _against_all(queries, train, rule, asked)
    celled, cells = _describe(train, rule, pivots, block_rows)
    if strategy != "cells" and not _cells_pay(queries, cells, rule, asked, known, width):
        return _against_all(queries, train, rule, asked)
    block = F.lit(0).cast("bigint")
    layout = F.array(*[F.struct(F.lit(int(f)).alias("f"), F.lit(int(n)).alias("n")) for f, n in zip(cells.first_block, cells.blocks)])
    place = F.element_at(layout, F.col("cell") + 1)
    block = (place["f"] + key_hash("id", 1) % place["n"]).cast("bigint")
    points = celled.select("id", "vec", "value", "exclude", block.alias("block"))
    counts = _routed(queries, cells, rule, True).groupBy("block").agg(F.sum("n").alias("n"))
    chunks = counts.select("block", F.ceil(F.col("n") / F.lit(chunk_rows)).cast("int").alias("chunks"))
    left = _routed(queries, cells, rule, False).join(chunks, "block").withColumn(
        "chunk", (key_hash("id", 2) % F.col("chunks")).cast("int")
    )
    right = points.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def match(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows or not known.num_rows:
            return pa.Table.from_batches([], schema=_empty_schema(rule))
        block_points = Points(known["id"].to_numpy(), _matrix(known["vec"]), known["value"].to_numpy(), _groups(known["exclude"]))
        found = _searched(asked["id"].to_numpy(), _matrix(asked["vec"]), _groups(asked["exclude"]), block_points, rule)
        return pa.Table.from_batches(found)

    partial = (
        left.select("block", "chunk", "id", "vec", "exclude")
        .groupBy("block", "chunk")
        .cogroup(right.select("block", "chunk", "id", "vec", "value", "exclude").groupBy("block", "chunk"))
        .applyInArrow(match, _schema(rule))
    )
    everyone = queries.select("id")
    if not rule.k:
        sums = partial.groupBy("id").agg(*[F.sum(s).alias(s) for s in SUMS])
        return everyone.join(sums, "id", "left").na.fill(0.0, SUMS)
    flat = partial.select("id", F.explode("neighbors").alias("n")).select("id", "n")
    order = Window.partitionBy("id").orderBy(F.round("n.distance", DIGITS), "n.id")
    ranked = flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rule.k)
    merged = ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "n"))).alias("all"))
    answers = merged.select("id", F.transform("all", lambda e: e["n"]).alias("neighbors"))
    empty = F.array().cast(NEIGHBOR_SQL)
    return everyone.join(answers, "id", "left").withColumn("neighbors", F.coalesce("neighbors", empty))


def _empty_schema(rule: Rule) -> pa.Schema:
    if rule.k:
        return pa.schema([("id", pa.int64()), ("neighbors", NEIGHBOR)])
    return pa.schema([("id", pa.int64()), *[(s, pa.float64()) for s in SUMS]])


def _joined(
    queries: Side, train: Side, rule: Rule, strategy: str, broadcast_bytes: int, pivots: int, block_rows: int, chunk_rows: int
) -> DataFrame:
    rule.check()
    if strategy not in ("auto", "broadcast", "blocks", "cells", "all"):
        raise ValueError(f"unknown strategy {strategy!r}")
    asked, known = queries.prepared(), train.prepared()
    if strategy == "broadcast":
        return _against_broadcast(asked, known, rule)
    rows, width = known.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if strategy == "auto" and rows * ((width or 0) + 3) * 8 <= broadcast_bytes:
        return _against_broadcast(asked, known, rule)
    return _against_blocks(asked, known, rule, pivots, block_rows, chunk_rows, rows, width or 0, strategy)


def knn_join(
    queries: Side,
    train: Side,
    k: int,
    metric: str = "euclidean",
    p: float = 2.0,
    strategy: str = "auto",
    broadcast_bytes: int = 64 << 20,
    pivots: int = 256,
    block_rows: int = 20000,
    chunk_rows: int = 20000,
) -> DataFrame:
    """(id, neighbors): the k nearest train rows of each query, nearest first.

    A pair whose two ``exclude`` values are equal is left out: give the key to leave a row
    out of its own neighbours, or a fold number to cross-validate in one pass. ``strategy`` auto broadcasts a small train
    side, blocks never does; both measure whether cells rule out enough. broadcast, cells and all name a route.
    """
    rule = Rule(metric, p, k=k, excluding=queries.exclude is not None)
    return _joined(queries, train, rule, strategy, broadcast_bytes, pivots, block_rows, chunk_rows)


def radius_join(
    queries: Side,
    train: Side,
    radius: float = 1.0,
    metric: str = "euclidean",
    p: float = 2.0,
    strategy: str = "auto",
    broadcast_bytes: int = 64 << 20,
    pivots: int = 256,
    block_rows: int = 20000,
    chunk_rows: int = 20000,
    weighted: bool = True,
) -> DataFrame:
    """Sums over the train rows within ``radius`` of each query; the pairs themselves are never emitted.

    Without ``weighted`` only the plain sums ``n`` and ``total`` are taken, the others stay zero.
    """
    rule = Rule(metric, p, radius=radius, excluding=queries.exclude is not None, weighted=weighted)
    return _joined(queries, train, rule, strategy, broadcast_bytes, pivots, block_rows, chunk_rows)


def neighbor_rows(joined: DataFrame) -> DataFrame:
    """One row per (query, neighbour) with its rank from 1."""
    return joined.select("id", F.posexplode("neighbors").alias("at", "n")).select(
        "id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("neighbor"), "n.distance", "n.value"
    )


def vote(neighbors: Column, k: Column | int, classes: list[float], weights: str = "uniform") -> Column:
    """Class with the largest vote among the first k neighbours; the smallest class on ties.

    With distance weights, neighbours at distance zero decide alone.
    """
    count = F.lit(k) if isinstance(k, int) else k
    nearby = F.slice(neighbors, 1, count)
    weigh = _weigher(nearby, weights)
    known = F.array(*[F.lit(float(c)) for c in sorted(classes)])

    def tally(c: Column) -> Column:
        total = F.aggregate(
            nearby, F.lit(0.0), lambda s, n: s + F.when(n["value"] == c, weigh(n)).otherwise(F.lit(0.0))
        )
        return F.struct(F.round(total, DIGITS).alias("votes"), (-c).alias("rank"), c.alias("class"))

    return F.when(F.size(nearby) > 0, F.array_max(F.transform(known, tally))["class"])


def votes_at(neighbors: Column, ks: Sequence[int], classes: list[float], weights: str = "uniform") -> Column:
    """Winning class position for every k at once, from running vote totals over Arrow batches.

    Same rule as ``vote``, NULL without neighbours; worth it when many values of k share one ranked list.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights!r}")
    known, columns = sorted(classes), np.array(ks) - 1
    depth = int(columns.max()) + 1

    @F.arrow_udf("array<int>")
    def count(lists: pa.Array) -> pa.Array:
        sizes = np.minimum(np.diff(lists.offsets.to_numpy()), depth)
        items = lists.flatten()
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
        row = np.repeat(np.arange(len(lists)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        label = np.full((len(lists), depth), np.nan)
        far = np.full((len(lists), depth), np.inf)
        label[row, at] = items.field("value").to_numpy(zero_copy_only=False)[starts[row] + at]
        far[row, at] = items.field("distance").to_numpy(zero_copy_only=False)[starts[row] + at]
        if weights == "uniform":
            share = np.ones_like(far)
        else:
            share = np.where(far[:, :1] == 0, far == 0, np.divide(1.0, far, out=np.zeros_like(far), where=far > 0))
        most = np.zeros((len(lists), len(columns)))
        winner = np.zeros((len(lists), len(columns)), "int32")
        for i, c in enumerate(known):
            total = np.round(np.cumsum(share * (label == c), axis=1)[:, columns], DIGITS)
            better = total > most
            most[better], winner[better] = total[better], i
        ends = np.arange(len(lists) + 1, dtype="int32") * len(columns)
        alone = np.repeat(sizes == 0, len(columns))
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(winner.ravel(), mask=alone))

    return count(neighbors)


def neighbor_mean(neighbors: Column, k: Column | int, weights: str = "uniform") -> Column:
    """Plain or inverse-distance weighted mean of the first k neighbours' values."""
    count = F.lit(k) if isinstance(k, int) else k
    nearby = F.slice(neighbors, 1, count)
    weigh = _weigher(nearby, weights)
    top = F.aggregate(nearby, F.lit(0.0), lambda s, n: s + weigh(n) * n["value"])
    bottom = F.aggregate(nearby, F.lit(0.0), lambda s, n: s + weigh(n))
    return F.try_divide(top, bottom)


def _weigher(nearby: Column, weights: str) -> Callable[[Column], Column]:
    if weights == "uniform":
        return lambda n: F.lit(1.0)
    if weights != "distance":
        raise ValueError(f"unknown weights {weights!r}")
    touching = F.exists(nearby, lambda n: n["distance"] == 0)

    def weigh(n: Column) -> Column:
        share = F.try_divide(F.lit(1.0), n["distance"])
        return F.when(touching, (n["distance"] == 0).cast("double")).otherwise(share)

    return weigh


def radius_mean(weights: str = "uniform") -> Column:
    """Prediction from the sums of ``radius_join``; NULL where no row is near enough."""
    if weights == "uniform":
        return F.try_divide(F.col("total"), F.col("n"))
    weighted = F.try_divide(F.col("weighted_total"), F.col("weight"))
    return F.when(F.col("n_zero") > 0, F.col("zero_total") / F.col("n_zero")).otherwise(weighted)
