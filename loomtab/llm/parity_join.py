"""N-gram Jaccard join by parity sketches.

A sketch XORs the hashes of a document's shingles into blocks (block = hash mod m): shingles that two documents share
cancel, so two sketches differ in at most as many blocks (or bits) as the symmetric difference has shingles. With J >=
t that is at most D = (1 - t) / (1 + t) * (a + b), so if the non-empty blocks are put in one order for all documents,
the first D + 1 blocks of two linked documents hold an equal one: those blocks are the join keys. Documents meet in the
size band of the smaller one, which fixes m. Shingles that a fixed-size counter finds frequent sketch into blocks of
their own that come last in the order, so a passage that many documents share is no key while rarer shingles suffice.

Documents of equal shingle sets are one class from the start. Equal keys give candidate pairs (all in a small bucket;
to its first member in a large one), bit sketches drop pairs over the bound, and texts verify the rest. Large buckets
whose members are still in different components are then compared pair by pair, in blocks, by bit sketch. Only spanning
links are made, so a group of n copies costs n, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.llm.common import (
    cell_bounds, cells_for, documents, few_rows, from_planes, joined, planes, query, record, runs, stored, text_bytes, texts,
)
from loomtab.llm.components import components
from loomtab.llm.wordblocks import Texts, mixed, signed, slices, texts_of, unsigned, windows, word_hashes, words_of

COUNTERS = 20
BAND = 16
FIRST_BAND = 64
SMALL_BUCKET = 8
BLOCK = 1024
DENSE = 1
COLUMNS = 2048
FLUSH = 1 << 20


def shingles(text: Texts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles of every text, sorted, and how many each has; short texts are one shingle."""
    words = words_of(text)
    hashes = word_hashes(text, words)
    at, value = windows(hashes, words.owner, k)
    owner = words.owner[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    whole = np.array([np.bitwise_xor.reduce(mixed(hashes[words.first[i] : words.first[i + 1]] + np.arange(words.count[i], dtype=np.uint64), 4)) for i in short], np.uint64)
    owner, value = np.append(owner, short), np.append(value, mixed(whole, 6))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    first = runs(owner, value)
    owner, value = owner[first], value[first]
    return owner, value, np.bincount(owner, minlength=len(text))


def bit_sketch(values: np.ndarray) -> bytes:
    """Parities of the shingles by hash, one to two bits a shingle."""
    bits = max(64, 1 << (2 * len(values) - 1).bit_length())
    places = np.bincount((mixed(values, 12) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(places.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance; the longer sketch is folded, which keeps the bound."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        half = len(y) // 2
        y = y[:half] ^ y[half:]
    return int(np.bitwise_count(x ^ y).sum())


def most_apart(a, b, percent: int):
    """Largest symmetric difference of sets of sizes a and b at this Jaccard percentage."""
    return ((a + b) * (100 - percent)) // (100 + percent)


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, s1, s2, sketch) of every row: the size, two set signatures and the bit sketch."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.binary())])
        for batch in batches:
            for rows, text in slices(batch):
                owner, value, count = shingles(text, k)
                ends = np.cumsum(count)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(value, s))]) for s in (14, 15)]
                s1, s2 = (signed(x[ends] - x[ends - count]) for x in sums)
                sketch = [bit_sketch(value[e - n : e]) if n else b"" for e, n in zip(ends, count)]
                yield record(schema, doc_id=rows.column("doc_id"), n=count, s1=s1, s2=s2, sketch=sketch)

    return docs.mapInArrow(emit, "doc_id long, n long, s1 long, s2 long, sketch binary")


def frequent_map(docs: DataFrame, k: int, bits: int = COUNTERS) -> np.ndarray:
    """Which of 2^bits counters, over the shingles of all documents, stand far out of the mean."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, text in slices(batch):
                total += np.bincount((shingles(text, k)[1] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        for part in range(0, 1 << bits, 1 << 14):
            yield record(schema, part=[part >> 14], counts=[planes(total[part : part + (1 << 14)])])

    def add(table: pa.Table) -> pa.Table:
        total = from_planes(table["counts"], np.uint32).reshape(len(table), -1).sum(axis=0, dtype=np.int64)
        return pa.table({"part": table["part"][:1], "counts": pa.array([planes(total)], pa.binary())})

    parts = docs.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")
    total = np.zeros(1 << bits, np.int64)
    for row in few_rows(parts):
        total[row["part"] << 14 : (row["part"] + 1) << 14] = from_planes(pa.array([row["counts"]]), np.int64)
    mean = total.mean()
    return total > mean + 64 + 6 * np.sqrt(mean)


def band_of(size: np.ndarray) -> np.ndarray:
    """0 for sizes under 64, then one band for each factor of 16."""
    edges = FIRST_BAND * BAND ** np.arange(12)
    return np.searchsorted(edges, size, "right")


def sketch_keys(owner: np.ndarray, value: np.ndarray, size: np.ndarray, band: np.ndarray, apart: np.ndarray, frequent: np.ndarray):
    """(document, key) of the first D + 1 non-empty blocks of every document, in its band.

    ``size``, ``band`` and ``apart`` (D) are by document; documents of band -1 have no key here.
    """
    use = band[owner] >= 0
    owner, value = owner[use], value[use]
    mine = band[owner]
    blocks = (FIRST_BAND * BAND ** np.minimum(mine, 13)).astype(np.uint64)
    place = np.where(mine == 0, value >> np.uint64(2), mixed(value, 16) % blocks)  # sizes under 64: a block for each shingle
    common = frequent[(value >> np.uint64(64 - COUNTERS)).astype(np.int64)]
    place |= common.astype(np.uint64) << np.uint64(63)
    order = np.lexsort((value, place, owner))
    owner, value, place = owner[order], value[order], place[order]
    first = runs(owner, place)
    parity = np.bitwise_xor.reduceat(value, first) if len(first) else value
    owner, place = owner[first], place[first]
    rank = np.arange(len(owner)) - np.repeat(runs(owner), np.diff(np.append(runs(owner), len(owner)))) if len(owner) else owner
    take = rank <= apart[owner]
    key = mixed(parity[take] ^ mixed(place[take], 17), 18) ^ mixed(band[owner[take]].astype(np.uint64), 19)
    return owner[take], key


def key_rows(docs: DataFrame, k: int, percent: int, cells: int, frequent: np.ndarray) -> DataFrame:
    """(cell, key, doc, size): packed keys of all documents; of equal sets in one flush only the smallest id goes on."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent).tobytes())  # 2^20 bits

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.int32()), ("key", pa.binary()), ("doc", pa.binary()), ("size", pa.binary())])
        often = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[tuple[int, int]] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            key, doc, size = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(key, kind="stable")
            key, doc, size = key[order], doc[order], size[order]
            bounds = cell_bounds(key, cells)
            cuts = [(c, slice(bounds[c], bounds[c + 1])) for c in np.flatnonzero(bounds[1:] > bounds[:-1])]
            yield record(
                schema, cell=[c for c, _ in cuts], key=[key[x].tobytes() for _, x in cuts],
                doc=[planes(doc[x]) for _, x in cuts], size=[planes(size[x]) for _, x in cuts],
            )
            seen.clear()

        for batch in batches:
            for rows, text in slices(batch):
                owner, value, size = shingles(text, k)
                ids = rows.column("doc_id")
                ends = np.cumsum(size)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(value, 14))])
                sign = sums[ends] - sums[ends - size]
                use = ids.is_valid().to_numpy(zero_copy_only=False) & (size > 0)
                for i in np.flatnonzero(use):  # any one copy of a flush stands for its class
                    mark = int(sign[i]), int(size[i])
                    use[i] = mark not in seen
                    seen.add(mark)
                doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
                band = np.where(use, band_of(size), -1)
                largest = (size * 100) // percent
                below = band_of(-(-size * percent // 100))
                under = np.where(use & (below < band), below, -1)  # met by smaller documents of the next band
                for at, apart in ((band, most_apart(size, largest, percent)), (under, most_apart(size, FIRST_BAND * BAND ** np.maximum(under, 0) - 1, percent))):
                    of, key = sketch_keys(owner, value, size, at, apart, often)
                    held.append((key, doc[of], size[of].astype(np.uint32)))
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield from flush()
        if held and sum(len(x[0]) for x in held):
            yield from flush()

    return docs.mapInArrow(emit, "cell int, key binary, doc binary, size binary")


def buckets(keys: DataFrame, percent: int) -> DataFrame:
    """(a, b, key, size): candidate pairs a < b (key null), and the members a of large buckets (b null)."""

    def meet(table: pa.Table) -> pa.Table:
        key, doc, size = joined(table["key"], np.uint64), from_planes(table["doc"], np.int64), from_planes(table["size"], np.uint32).astype(np.int64)
        order = np.lexsort((doc, key))
        key, doc, size = key[order], doc[order], size[order]
        first = runs(key)
        n = np.diff(np.append(first, len(key)))
        many = np.repeat(n, n) > 1
        key, doc, size, n = key[many], doc[many], size[many], np.repeat(n, n)[many]
        pairs = []
        place = np.arange(len(key))
        start = np.repeat(runs(key), np.diff(np.append(runs(key), len(key)))) if len(key) else place
        for step in range(1, SMALL_BUCKET):
            near = np.flatnonzero(key[step:] == key[:-step]) if len(key) > step else place[:0]
            near = near[n[near] <= SMALL_BUCKET]
            pairs.append((near, near + step))
        star = np.flatnonzero((n > SMALL_BUCKET) & (start < place))
        pairs.append((start[star], star))
        a, b = (np.concatenate(x) for x in zip(*pairs))
        fit = (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])) & (doc[a] != doc[b])
        a, b = doc[a[fit]], doc[b[fit]]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        one = runs(a, b)
        a, b = a[one], b[one]
        large = n > SMALL_BUCKET
        none = pa.nulls(int(large.sum()), pa.int64())
        return pa.table(
            {
                "a": pa.chunked_array([pa.array(a, pa.int64()), pa.array(doc[large], pa.int64())]),
                "b": pa.chunked_array([pa.array(b, pa.int64()), none]),
                "key": pa.chunked_array([pa.nulls(len(a), pa.int64()), pa.array(signed(key[large]))]),
            }
        )

    return keys.groupBy("cell").applyInArrow(meet, "a long, b long, key long")


def near_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of class representatives whose sketches are within the bound."""
    for side in ("a", "b"):
        c = classes.select(F.col("doc_id").alias(f"{side}_id"), F.col("rep").alias(f"{side}_rep"), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch"))
        pairs = pairs.join(c, F.col(side) == F.col(f"{side}_id")).drop(f"{side}_id")
    pairs = pairs.filter("a_rep <> b_rep")

    def bound(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            x = batch.to_pydict()
            keep = [
                (min(a, b), max(a, b))
                for a, b, n, m, s, t in zip(x["a_rep"], x["b_rep"], x["a_n"], x["b_n"], x["a_sketch"], x["b_sketch"])
                if 100 * min(n, m) >= percent * max(n, m) and sketch_distance(s, t) <= most_apart(n, m, percent)
            ]
            yield record(schema, a=[p[0] for p in keep], b=[p[1] for p in keep])

    return pairs.drop("a", "b").mapInArrow(bound, "a long, b long").distinct()


def packed_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(w, body): compressed texts of the documents w, and of the few that share a place in the bit map."""
    bits = 1 << 24

    def pack(table: pa.Table) -> pa.Table:
        here = np.zeros(1 << 14, bool)
        here[table["place"].to_numpy()] = True
        return pa.table({"part": table["part"][:1], "map": pa.array([np.packbits(here, bitorder="little").tobytes()], pa.binary())})

    spot = F.pmod(F.xxhash64("w"), F.lit(bits))
    places = wanted.select((spot / (1 << 14)).cast("int").alias("part"), (spot % (1 << 14)).cast("int").alias("place")).distinct()
    there = np.zeros(bits // 8, np.uint8)
    for row in few_rows(places.groupBy("part").applyInArrow(pack, "part int, map binary")):
        there[row["part"] << 11 : (row["part"] + 1) << 11] = np.frombuffer(row["map"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(there.tobytes())  # 2 MB; a full map only lets more texts travel

    def squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        schema = pa.schema([("w", pa.int64()), ("body", pa.binary())])
        filled = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            place = batch.column("spot").to_numpy()
            hit = np.flatnonzero((filled[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
            text = texts_of(batch.column("text"))
            yield record(schema, w=batch.column("doc_id").take(pa.array(hit)), body=[press(b" ".join(text.text(i).lower().split())) for i in hit])

    known = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("spot"))
    bodies = known.mapInArrow(squeeze, "w long, body binary").groupBy("w").agg(F.first("body").alias("body"))
    return stored(bodies, "bodies")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts have 100 * |A & B| >= percent * |A | B|. Packed texts of paired documents travel."""
    bodies = packed_texts(pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct(), docs)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sets = []
                for side in ("x", "y"):
                    text = texts_of(pa.array([expand(b).decode() for b in part.column(side).to_pylist()], pa.large_string()))
                    owner, value, size = shingles(text, k)
                    sets.append((value ^ mixed(owner.astype(np.uint64), 22), owner, size))
                both = np.isin(sets[0][0], sets[1][0])
                common = np.bincount(sets[0][1][both], minlength=len(part))
                linked = pa.array(100 * common >= percent * (sets[0][2] + sets[1][2] - common))
                yield record(schema, u=part.column("a").filter(linked), v=part.column("b").filter(linked))

    x, y = (bodies.select(F.col("w").alias(f"{s}_id"), F.col("body").alias(s)) for s in ("x", "y"))
    met = pairs.join(x, F.col("a") == F.col("x_id")).join(y, F.col("b") == F.col("y_id")).select("a", "b", "x", "y")
    return met.mapInArrow(compare, "u long, v long")


def open_pairs(members: DataFrame, classes: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(a, b, block): pairs of representatives of large buckets, in no common component yet, whose sketches allow a link.

    Members of a bucket are cut into blocks; a task holds two blocks, so no bucket has to fit one. Where sketches leave
    more than ``DENSE`` pairs a member, the members of the two blocks are given instead (b null), to be compared whole:
    no more rows leave than came in. A block is named by its members, so buckets of the same documents are compared once.
    """
    reps = members.join(classes.select(F.col("doc_id").alias("a"), "rep"), "a").select("key", F.col("rep").alias("a")).distinct()
    at = reps.join(found.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    mixed_keys = at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")).filter("x <> y")
    split = mixed_keys.select(F.col("key").alias("k"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    rows = at.join(split, F.col("key") == F.col("k")).join(
        classes.filter("doc_id = rep").select(F.col("doc_id").alias("r"), "n", "sketch").dropDuplicates(["r"]), F.col("a") == F.col("r")
    )
    block = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = rows.withColumn("block", block).withColumn("other", F.explode(others))
    dealt = dealt.select(
        "a", "component", "n", "sketch", "key", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
    ).withColumn("cell", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(4096)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("lo", "ascending"), ("hi", "ascending")])
        key, lo, hi = (table[c].to_numpy() for c in ("key", "lo", "hi"))
        doc, component, n, block = (table[c].to_numpy() for c in ("a", "component", "n", "block"))
        sketch = table["sketch"].to_pylist()
        first = runs(key, lo, hi)
        out: set[tuple[int, int]] = set()
        whole: list[tuple[np.ndarray, int]] = []
        for start, end in zip(first, np.append(first[1:], len(key))):
            width = np.array([len(s) // 8 for s in sketch[start:end]])
            at_width = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
            rows_of = {w: np.frombuffer(b"".join(sketch[start + i] for i in at), np.uint64).reshape(-1, w) for w, at in at_width.items()}
            folded = {w: m[:, : w // 2] ^ m[:, w // 2 :] for w, m in rows_of.items() if w > 1}
            here: set[tuple[int, int]] = set()
            for i in range(end - start):
                own = rows_of[width[i]][np.searchsorted(at_width[width[i]], i)]
                for w, at in at_width.items():  # sizes within the ratio have sketches at most twice as long
                    if w == width[i]:
                        theirs, mine = rows_of[w], own
                    elif w == 2 * width[i]:
                        theirs, mine = folded[w], own
                    else:
                        continue
                    j = np.arange(len(at))
                    if w == width[i]:
                        j = j[at > i]
                    x, y = start + i, start + at[j]
                    fit = (component[y] != component[x]) & ((lo[x] == hi[x]) | (block[y] != block[x]))
                    fit &= 100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])
                    j, y = j[fit], y[fit]
                    near = np.bitwise_count(theirs[j] ^ mine).sum(axis=1, dtype=np.int64) <= most_apart(n[y], n[x], percent)
                    here.update((min(int(doc[x]), d), max(int(doc[x]), d)) for d in doc[y[near]].tolist())
                if len(here) > DENSE * (end - start):
                    break  # the block is compared whole
            if len(here) > DENSE * (end - start):
                whole.append((doc[start:end], int(mixed(unsigned(doc[start:end]), 23).sum() >> np.uint64(1))))
            else:
                out |= here
        pairs = sorted(out)
        members = np.concatenate([d for d, _ in whole]) if whole else np.empty(0, np.int64)
        blocks = np.repeat([x for _, x in whole], [len(d) for d, _ in whole]).astype(np.int64)
        none = pa.nulls(len(pairs), pa.int64())
        return pa.table(
            {
                "a": pa.chunked_array([pa.array([p[0] for p in pairs], pa.int64()), pa.array(members, pa.int64())]),
                "b": pa.chunked_array([pa.array([p[1] for p in pairs], pa.int64()), pa.nulls(len(members), pa.int64())]),
                "block": pa.chunked_array([none, pa.array(blocks, pa.int64())]),
            }
        )

    return dealt.groupBy("cell").applyInArrow(compare, "a long, b long, block long").distinct()


def dense_links(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links within blocks (a, block) of near documents, as edges to the smallest document each reaches in its block.

    Common shingles of all pairs of a block are counted at once by products of 0/1 matrices; pairs are never given out.
    """
    bodies = packed_texts(members.select(F.col("a").alias("w")).distinct(), docs)

    def link(table: pa.Table) -> pa.Table:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        table = table.sort_by("a")
        doc = table["a"].to_numpy()
        owner, value, size = shingles(texts_of(pa.array([expand(x).decode() for x in table["body"].to_pylist()], pa.large_string())), k)
        _, column, times = np.unique(value, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        common = np.zeros((len(doc), len(doc)), np.float32)
        for at in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
            here = (column >= at) & (column < at + COLUMNS)
            part = np.zeros((len(doc), COLUMNS), np.float32)
            part[owner[here], column[here] - at] = 1
            common += part @ part.T
        near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        reach, before = np.arange(len(doc)), None
        while before is None or (reach != before).any():
            before = reach
            reach = np.minimum(reach, np.where(near, reach[None, :], len(doc)).min(axis=1))
        tied = reach != np.arange(len(doc))
        return pa.table({"u": doc[tied], "v": doc[reach[tied]]})

    met = members.join(bodies, F.col("a") == F.col("w")).select("block", "a", "body")
    return met.groupBy("block").applyInArrow(link, "u long, v long")


def parity_join(docs: DataFrame, k: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a document is the set of its k-word shingles, or its whole
    word sequence when it has fewer words. Two documents link when 100 * |A & B| >= percent * |A | B|; the component is
    the smallest doc_id reachable by links. Null, empty and blank texts link with nothing; rows without an id link with
    nothing and have no component; rows of one id are one document; an empty table gives an empty one.
    """
    rows = texts(docs, key, text)
    spark = rows.sparkSession
    cells = cells_for(spark, text_bytes(rows))
    known = stored(profiles(rows, k), "profiles")
    sets = known.filter("doc_id is not null and n > 0")
    reps = sets.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    classes = stored(sets.join(reps, ["n", "s1", "s2"]).select("doc_id", "n", "sketch", "rep").dropDuplicates(["doc_id"]), "classes")
    met = stored(buckets(key_rows(rows, k, percent, cells, frequent_map(rows, k)), percent), "buckets")
    pairs = stored(near_pairs(met.filter("b is not null").select("a", "b").distinct(), classes, percent), "pairs")
    copies = classes.filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = stored(verified(pairs, rows, k, percent), "links")
    found = components(links.unionByName(copies))
    still = stored(open_pairs(met.filter("b is null").select("a", "key"), classes, found, percent), "open")
    if not still.isEmpty():
        pairs = still.filter("b is not null").select("a", "b").join(pairs, ["a", "b"], "left_anti")
        late = verified(pairs, rows, k, percent).unionByName(dense_links(still.filter("b is null").select("a", "block"), rows, k, percent))
        found = components(late.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    out = known.join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


_SQL = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from worded),
sizes as (select doc_id, count(*) as n from sets group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select a, b from common join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, other) as (select a, b from links union select r.doc_id, l.b from reach r join links l on r.other = l.a)
select w.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, least(w.doc_id, coalesce(min(other), w.doc_id)) as component_id
from worded w left join sizes using (doc_id) left join reach r on r.doc_id = w.doc_id group by w.doc_id"""


@query(_SQL)
def op2_parity_join(spark, folder):
    """Near duplicates among all documents."""
    return parity_join(documents(spark, folder))
