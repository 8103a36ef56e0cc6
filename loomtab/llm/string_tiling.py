"""Benchmark decontamination by greedy string tiling.

Runs of ``min_match`` words of the items are seeds; a document is compared with the items it shares seeds with, and only
where the shared seeds could cover enough of the item (every tile is made of seeds, so they bound its coverage). Tiling
then repeatedly marks the longest matches of unmarked words, found by running Karp-Rabin hashes of shrinking length, so
passages in another order are covered too. A document whose tiles cover at least ``cover`` of an item is contaminated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from loomtab.llm.common import documents, few_rows, query, record, stored
from loomtab.llm.wordblocks import ALNUM, signed, slices, texts_of, windows, word_hashes, words_of
from loomtab.session import load

MAP_BITS = 24
_BASE = np.uint64(0x9DDFEA08EB382D69)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Runs:
    """Karp-Rabin hashes of all runs of a word sequence, of any length, from prefix hashes made once."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        powers = np.cumprod(np.append(np.uint64(1), np.full(n, _BASE)), dtype=np.uint64)
        self.inverse = np.cumprod(np.append(np.uint64(1), np.full(n, _INVERSE)), dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum(values * powers[:-1], dtype=np.uint64))
        self.free = np.ones(n, bool)

    def hashes(self, length: int) -> np.ndarray:
        n = len(self.free) - length + 1
        return (self.sums[length:] - self.sums[:n]) * self.inverse[:n]

    def unmarked(self, length: int) -> np.ndarray:
        """Starts of the runs whose words are all free."""
        marked = np.append(0, np.cumsum(~self.free))
        return np.flatnonzero(marked[length:] == marked[: len(marked) - length])


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(item start, document start, length) of the tiles of two word sequences, longest first.

    The longest free match is found by bisection of its length, for a match of one length holds shorter ones. Of matches of
    one length the first in the document, then in the item, is marked first; none of that length is then left.
    """
    ours, theirs = Runs(item), Runs(doc)
    bottom, top = max(1, min(min_match, len(item))), min(len(item), len(doc))
    out: list[tuple[int, int, int]] = []

    def shared(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Free starts in the item with their hashes, and the free starts in the document that match one."""
        starts, there = ours.unmarked(length), theirs.unmarked(length)
        mine = ours.hashes(length)[starts]
        return starts, mine, there[np.isin(theirs.hashes(length)[there], mine)]

    while top >= bottom:
        low, high = bottom - 1, top
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(shared(middle)[2]) else (low, middle - 1)
        if low < bottom:
            break
        length, (starts, mine, there) = low, shared(low)
        order = np.argsort(mine, kind="stable")
        starts, mine, wanted = starts[order], mine[order], theirs.hashes(length)
        at = dict(zip(there.tolist(), np.searchsorted(mine, wanted[there]).tolist()))
        next_free: dict[int, int] = {}  # runs of one hash are used up in order
        for d, first in at.items():
            if not theirs.free[d : d + length].all():
                continue
            j = next_free.get(first, first)
            while j < len(mine) and mine[j] == wanted[d]:
                i = int(starts[j])
                j += 1
                if ours.free[i : i + length].all() and (item[i : i + length] == doc[d : d + length]).all():
                    ours.free[i : i + length] = theirs.free[d : d + length] = False
                    out.append((i, d, length))
                    break
            next_free[first] = j
        top = length - 1
    return out


def distinct_items(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, mark, body): items of equal words once, under the smallest key; ``mark`` hashes the words and tells items of one key, or of none, apart."""

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item", pa.int64()), ("body", pa.string()), ("size", pa.int64())])
        for batch in batches:
            for rows, part in slices(batch):
                found = words_of(part, ALNUM)
                said = [
                    b" ".join(part.data[a:b].tobytes() for a, b in zip(found.start[x:y], found.end[x:y])).lower().decode()
                    for x, y in zip(found.first[:-1], found.first[1:])
                ]
                yield record(schema, item=rows.column("item"), body=said, size=found.count)

    told = items.select(F.col(key).cast("long").alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(words, "item long, body string, size long")
    return told.filter("size > 0").groupBy("body").agg(F.min("item").alias("item")).select("item", F.xxhash64("body").alias("mark"), "body")


def item_seeds(bodies: DataFrame, min_match: int) -> DataFrame:
    """(seed, item, mark, place, size, width) of every seed of ``distinct_items``.

    An item shorter than ``min_match`` is one seed; an item without words has none.
    """

    def seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("seed", pa.int64()), ("item", pa.int64()), ("mark", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), ("width", pa.int64())])
        for batch in batches:
            for rows, part in slices(batch, "body"):
                found = words_of(part, ALNUM)
                hashes = word_hashes(part, found)
                for width in range(1, min_match + 1):
                    at, value = windows(hashes, found.owner, width, seed=width)
                    use = (found.count[found.owner[at]] == width) | (width == min_match)
                    at, value = at[use], value[use]
                    owner = found.owner[at]
                    pick = pa.array(owner)
                    yield record(
                        schema, seed=signed(value), item=rows.column("item").take(pick), mark=rows.column("mark").take(pick),
                        place=at - found.first[owner], size=found.count[owner], width=np.full(len(at), width),
                    )

    return bodies.mapInArrow(seeds, "seed long, item long, mark long, place long, size long, width long")


def _seed_map(seeds: DataFrame) -> bytes:
    """A bit map of the seeds: 2 MB, however many items there are."""

    def pack(table: pa.Table) -> pa.Table:
        here = np.zeros(1 << 14, bool)
        here[table["place"].to_numpy()] = True
        return pa.table({"part": table["part"][:1], "map": pa.array([np.packbits(here, bitorder="little").tobytes()], pa.binary())})

    spot = F.shiftrightunsigned("seed", 64 - MAP_BITS)
    places = seeds.select(F.shiftright(spot, 14).cast("int").alias("part"), (spot % (1 << 14)).cast("int").alias("place")).distinct()
    out = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for row in few_rows(places.groupBy("part").applyInArrow(pack, "part int, map binary")):
        out[row["part"] << 11 : (row["part"] + 1) << 11] = np.frombuffer(row["map"], np.uint8)
    return out.tobytes()


def candidates(docs: DataFrame, bodies: DataFrame, seeds: DataFrame, min_match: int, cover: float, key: str, text: str) -> DataFrame:
    """(__of, __check, __items): the items whose shared seeds could cover enough, by document."""
    shared = docs.sparkSession.sparkContext.broadcast(_seed_map(seeds))

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("of", pa.int64()), ("check", pa.int64()), ("hit", pa.int64())])
        filled = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for rows, part in slices(batch):
                found = words_of(part, ALNUM)
                hashes = word_hashes(part, found)
                for width in range(1, min_match + 1):
                    at, value = windows(hashes, found.owner, width, seed=width)
                    spot = (value >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                    hit = np.flatnonzero((filled[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1)
                    owner, value = found.owner[at[hit]], value[hit]
                    once = np.unique(np.stack([owner.astype(np.uint64), value]), axis=1)
                    pick = pa.array(once[0].astype(np.int64))
                    yield record(schema, of=rows.column("of").take(pick), check=rows.column("check").take(pick), hit=signed(np.ascontiguousarray(once[1])))

    rows = docs.select(F.col(key).cast("long").alias("of"), F.xxhash64(F.col(text)).alias("check"), F.col(text).cast("string").alias("text"))
    met = rows.mapInArrow(emit, "of long, check long, hit long").join(seeds, F.col("hit") == F.col("seed"))
    pairs = met.groupBy("of", "check", "item", "mark", "size", "width").agg(F.collect_set("place").alias("places"))
    words = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("width") - 1))))
    able = pairs.filter(F.size(words) >= cover * F.col("size")).select("of", "check", "item", "mark")
    told = able.join(bodies.select(F.col("item").alias("i"), F.col("mark").alias("m"), "body"), F.col("item").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))).groupBy("of", "check").agg(F.collect_list(F.struct("item", "body")).alias("__items"))
    return told.select(F.col("of").alias("__of"), F.col("check").alias("__check"), "__items")


def with_tiles(docs: DataFrame, items: DataFrame, min_match: int = 4, cover: float = 0.6, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``__items`` (how many items its tiles cover enough), ``__best`` and ``__coverage``.

    ``__best`` is the item of highest coverage, the smallest key of equal ones, null when no item is near or the best has no
    key. Items of no key, or of one key and other words, are items of their own. Words are
    lower-cased runs of letters, digits and bytes over 0x7F. A null or empty text or item has no words and matches
    nothing; rows without an id are told apart by their text; repeated rows are judged alike; empty tables give no match.
    """
    bodies = stored(distinct_items(items, item_key, item_text), "items")
    seeds = stored(item_seeds(bodies, min_match), "seeds")
    near = candidates(docs, bodies, seeds, min_match, cover, key, text)

    def tile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}

        def hashed(said: str) -> np.ndarray:
            if len(known) > 10_000:
                known.clear()
            if said not in known:
                part = texts_of(pa.array([said], pa.string()))
                known[said] = word_hashes(part, words_of(part, ALNUM))
            return known[said]

        for batch in batches:
            for part, body in slices(batch, text):
                counts, best, most = [], [], []
                found = hashes = None
                for i, near_items in enumerate(part.column("__items").to_pylist()):
                    if near_items and hashes is None:
                        found = words_of(body, ALNUM)
                        hashes = word_hashes(body, found)
                    judged = []
                    for x in near_items or ():
                        item = hashed(x["body"])
                        covered = sum(t[2] for t in tiles(item, hashes[found.first[i] : found.first[i + 1]], min_match))
                        judged.append((-covered / len(item), x["item"]))
                    judged.sort(key=lambda j: (j[0], j[1] is None, j[1]))
                    counts.append(sum(-c >= cover for c, _ in judged))
                    best.append(judged[0][1] if judged else None)
                    most.append(round(-judged[0][0], 6) if judged else 0.0)
                names = [x for x in part.schema.names if x != "__items"]
                more = [pa.array(counts, pa.int64()), pa.array(best, pa.int64()), pa.array(most, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), *more], [*names, "__items", "__best", "__coverage"])

    same = F.col(key).eqNullSafe(F.col("__of")) & (F.xxhash64(F.col(text)) == F.col("__check"))
    met = docs.join(near, same, "left").drop("__of", "__check")
    added = [StructField("__items", LongType()), StructField("__best", LongType()), StructField("__coverage", DoubleType())]
    return met.mapInArrow(tile, StructType([*docs.schema.fields, *added]))


def string_tiling(docs: DataFrame, items: DataFrame, min_match: int = 4, cover: float = 0.6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_items, best_item, coverage, contaminated. See ``with_tiles``."""
    rows = with_tiles(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), items, min_match, cover)
    return rows.select(
        "doc_id", F.col("__items").alias("n_items"), F.col("__best").alias("best_item"), F.col("__coverage").alias("coverage"),
        (F.col("__items") > 0).alias("contaminated"),
    )


@query()
def op3_string_tiling(spark, folder):
    """Benchmark items in all documents."""
    return string_tiling(documents(spark, folder), load(spark, folder, "benchmark"))
