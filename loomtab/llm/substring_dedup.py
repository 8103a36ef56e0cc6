"""Substring dedup by difference-cover anchors.

Positions i with i mod 7 in {1, 2, 4} form a difference cover: for any two positions there is a shift under 7 that
brings both onto the cover. So two equal runs of 13 words always hold an equal run of 7 words, an anchor, that begins
on the cover in both, and only 3 of 7 positions need hashing. Anchors seen in more than one document are marked in a
bit map; then every 13-word window around a marked anchor is compared exactly by a wider hash, and a window whose
smallest document is another one is removed from this one.

Hashes travel dealt into cells of hash space, packed, and reduced to one entry per hash and task flush before they are
shuffled, so a window that a third of all documents share costs an entry per flush, not per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.llm.common import (
    cell_bounds, cell_of, cells_for, dealt, documents, few_rows, from_planes, joined, of_cell, planes, query, record, runs, text_bytes, texts,
)
from loomtab.llm.wordblocks import Texts, Words, mixed, run_hashes, slices, unsigned, windows, word_hashes, words_of

PERIOD, COVER = 7, (1, 2, 4)
MAP_BITS = 27
FLUSH = 1 << 20
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def anchors(text: Texts, words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every anchor: runs of length - 6 words that begin on the cover."""
    at, value = windows(word_hashes(text, words, lower=False, seed=1), words.owner, length - PERIOD + 1)
    on = _ON_COVER[(at - words.first[words.owner[at]]) % PERIOD]
    return at[on], value[on]


def _anchor_rows(batches: Iterable[pa.RecordBatch], length: int, cells: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("cell", pa.int32()), ("low", pa.binary()), ("many", pa.binary())])
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        value, doc = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(value, kind="stable")
        value, doc = value[order], doc[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        many = (np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)).astype(np.uint8)
        low = np.ascontiguousarray(value[first].view(np.uint8).reshape(-1, 8)[:, :5])  # the cell gives the high bits
        rows = [(c, a, b) for c, (_, a, b) in dealt(value[first], [low, many], cells)]
        yield record(schema, cell=[r[0] for r in rows], low=[r[1] for r in rows], many=[r[2] for r in rows])
        held.clear()

    base = 0
    for batch in batches:
        for _, text in slices(batch):
            words = words_of(text)
            at, value = anchors(text, words, length)
            held.append((value, words.owner[at] + base))
            base += len(text)
            if sum(len(x[0]) for x in held) > FLUSH:
                yield from flush()
    if held and sum(len(x[0]) for x in held):
        yield from flush()


def _map_place(value: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(value & np.uint64((1 << 40) - 1), 3) >> np.uint64(64 - bits)).astype(np.int64)


def shared_map(docs: DataFrame, length: int, cells: int, bits: int = MAP_BITS) -> np.ndarray:
    """A bit map of 2^bits that holds every anchor seen in two rows; its size does not depend on the input."""

    def merge(table: pa.Table) -> pa.Table:
        low = np.zeros((len(joined(table["many"], np.uint8)), 8), np.uint8)
        low[:, :5] = joined(table["low"], np.uint8).reshape(-1, 5)
        value, back, times = np.unique(low.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        shared = times > 1
        shared[back[joined(table["many"], np.uint8) > 0]] = True
        places = np.sort(_map_place(value[shared], bits)).astype(np.uint32)
        part = places >> np.uint32(16)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
        ends = np.append(first[1:], len(part)) if len(part) else first
        return pa.table(
            {
                "part": pa.array(part[first].astype(np.int32), pa.int32()),
                "places": pa.array([places[a:b].astype(np.uint16).tobytes() for a, b in zip(first, ends)], pa.binary()),
            }
        )

    def pack(table: pa.Table) -> pa.Table:
        here = np.zeros(1 << 16, bool)
        here[joined(table["places"], np.uint16)] = True
        return pa.table({"part": table["part"][:1], "map": pa.array([np.packbits(here, bitorder="little").tobytes()], pa.binary())})

    rows = docs.mapInArrow(lambda b: _anchor_rows(b, length, cells), "cell int, low binary, many binary")
    merged = rows.groupBy("cell").applyInArrow(merge, "part int, places binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in few_rows(merged.groupBy("part").applyInArrow(pack, "part int, map binary")):
        out[row["part"] << 13 : (row["part"] + 1) << 13] = np.frombuffer(row["map"], np.uint8)
    return out


def text_check(text: Texts) -> np.ndarray:
    """16 bits of every text's hash: with the id they name a row."""
    return run_hashes(text, text.offsets[:-1], text.offsets[1:], lower=False, seed=2) >> np.uint64(48)


def _window_rows(batches: Iterable[pa.RecordBatch], length: int, cells: int, doc_cells: int, filled: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Windows around marked anchors: one document per window and flush to be compared, the larger ones decided."""
    schema = pa.schema([("cell", pa.int32()), ("hash", pa.binary()), ("wide", pa.binary()), ("doc", pa.binary()), ("place", pa.binary())])
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        value, wide, doc, place = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((doc, wide, value))
        value, wide, doc, place = value[order], wide[order], doc[order], place[order]
        first = runs(value, wide)
        ask = doc == np.repeat(doc[first], np.diff(np.append(first, len(doc))))
        value, wide = value[ask], wide[ask]
        bounds = cell_bounds(value, cells)
        cuts = [(c, slice(bounds[c], bounds[c + 1])) for c in np.flatnonzero(bounds[1:] > bounds[:-1])]
        of, at = doc[ask], place[ask]
        rows = [(c, value[x].tobytes(), wide[x].tobytes(), planes(of[x]), planes(at[x])) for c, x in cuts]
        rows += [(cells + c, b"", b"", d, p) for c, d, p in by_document(doc[~ask], place[~ask], doc_cells)]
        yield record(schema, **dict(zip(schema.names, zip(*rows))))

    for batch in batches:
        for rows, text in slices(batch):
            words = words_of(text)
            at, value = anchors(text, words, length)
            spot = _map_place(value, bits)
            marked = at[(filled[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0]
            near = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(near, np.maximum(marked - PERIOD + 1, 0), 1)
            np.add.at(near, marked + 1, -1)
            cover = np.cumsum(near[:-1]) > 0
            hashes = word_hashes(text, words, lower=False, seed=1)
            start, full = windows(hashes, words.owner, length, seed=1)
            start, full = start[cover[start]], full[cover[start]]
            if not len(start):
                continue
            wide = mixed(_second(hashes, start, length)) >> np.uint64(48)
            owner = words.owner[start]
            ids = rows.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)[owner]
            doc = unsigned(ids.fill_null(0).to_numpy(zero_copy_only=False))[owner] ^ np.uint64(1 << 63)  # keeps the order of signed ids
            place = (text_check(text)[owner] << np.uint64(32)) | (start - words.first[owner]).astype(np.uint64)
            held.append((full[known], wide[known].astype(np.uint16), doc[known], place[known]))
            if sum(len(x[0]) for x in held) > FLUSH:
                yield from flush()
    if held and sum(len(x[0]) for x in held):
        yield from flush()


def _second(hashes: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    value = np.zeros(len(start), np.uint64)
    for j in range(length):
        value = value * np.uint64(0xD6E8FEB86659FD93) + mixed(hashes[start + j], 5)
    return value


def by_document(doc: np.ndarray, place: np.ndarray, doc_cells: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(document cell, documents, places) of removed windows, sorted in every cell."""
    cell = cell_of((doc ^ np.uint64(1 << 63)).view(np.int64), doc_cells)
    order = np.lexsort((place, doc, cell))
    cell, doc, place = cell[order], doc[order], place[order]
    first = runs(cell)
    for a, b in zip(first, np.append(first[1:], len(cell))):
        yield int(cell[a]), planes(doc[a:b]), planes(place[a:b])


def removed_windows(docs: DataFrame, length: int, cells: int, doc_cells: int, filled: np.ndarray, bits: int) -> DataFrame:
    """(cell, doc, place): packed windows that each document loses, by the cell of the document."""
    shared = docs.sparkSession.sparkContext.broadcast(filled.tobytes())  # 2^bits bits, whatever the input

    def emit(batches):
        return _window_rows(batches, length, cells, doc_cells, np.frombuffer(shared.value, np.uint8), bits)

    def compare(table: pa.Table) -> pa.Table:
        cell = table["cell"][0].as_py()
        if cell >= cells:  # decided where they were read
            return pa.table({"cell": pa.array([cell - cells] * len(table), pa.int32()), "doc": table["doc"], "place": table["place"]})
        value, wide = joined(table["hash"], np.uint64), joined(table["wide"], np.uint16)
        doc, place = from_planes(table["doc"], np.uint64), from_planes(table["place"], np.uint64)
        order = np.lexsort((doc, wide, value))
        value, wide, doc, place = value[order], wide[order], doc[order], place[order]
        first = runs(value, wide)
        gone = doc > np.repeat(doc[first], np.diff(np.append(first, len(doc))))
        rows = list(by_document(doc[gone], place[gone], doc_cells))
        return pa.table(
            {
                "cell": pa.array([r[0] for r in rows], pa.int32()), "doc": pa.array([r[1] for r in rows], pa.binary()),
                "place": pa.array([r[2] for r in rows], pa.binary()),
            }
        )

    asked = docs.mapInArrow(emit, "cell int, hash binary, wide binary, doc binary, place binary")
    return asked.groupBy("cell").applyInArrow(compare, "cell int, doc binary, place binary")


SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def substring_dedup(docs: DataFrame, length: int = 13, bits: int = MAP_BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its words, how many it loses, the others joined by a space.

    A window is ``length`` (at least 8) consecutive words, unchanged. Every word goes that lies in a window whose words
    also begin in a document of smaller id; windows are judged on the input. Null and empty texts have no words, a text
    shorter than a window loses nothing, rows of one id and text are one document, rows without an id are no one's
    smaller document and keep all, an empty table gives an empty one. ``bits`` sizes the map of shared anchors: a small
    map only lets more windows be compared.
    """
    rows = texts(docs, key, text)
    volume = text_bytes(rows)
    cells, doc_cells = cells_for(rows.sparkSession, volume), cells_for(rows.sparkSession, volume) | 1
    filled = shared_map(rows, length, cells, bits)
    gone = removed_windows(rows, length, cells, doc_cells, filled, bits)
    whole = rows.select(of_cell("doc_id", "text", doc_cells).alias("cell"), "doc_id", "text")

    def rewrite(removed: pa.Table, table: pa.Table) -> pa.Table:
        doc, place = from_planes(removed["doc"], np.uint64), from_planes(removed["place"], np.uint64)
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        first = runs(doc)
        where = dict(zip((doc[first] ^ np.uint64(1 << 63)).view(np.int64).tolist(), zip(first, np.append(first[1:], len(doc)))))
        out: dict[str, list] = {name: [] for name in ("doc_id", "n_words", "n_removed", "kept_text", "kept_sha256")}
        for batch in table.to_batches():
            for part, body in slices(batch):
                check = text_check(body)
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    words = body.text(i).split()
                    out["doc_id"].append(doc_id)
                    out["n_words"].append(len(words))
                    if doc_id in where:
                        mine = place[slice(*where[doc_id])]
                        begin = (mine[mine >> np.uint64(32) == check[i]] & np.uint64((1 << 32) - 1)).astype(np.int64)
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, begin, 1)
                        np.add.at(change, begin + length, -1)
                        words = [w for w, covered in zip(words, np.cumsum(change[:-1]).tolist()) if not covered]
                    out["n_removed"].append(out["n_words"][-1] - len(words))
                    kept = b" ".join(words)
                    out["kept_text"].append(kept.decode())
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string(), "kept_sha256": pa.string()}
        return pa.table({name: pa.array(values, kinds[name]) for name, values in out.items()})

    return gone.groupBy("cell").cogroup(whole.groupBy("cell")).applyInArrow(rewrite, SCHEMA)


_SQL = r"""
with worded as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select doc_id, i, array_to_string(w[i:i + 12], ' ') as run
  from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from worded)),
firsts as (select run, min(doc_id) as smallest from windows group by run having count(distinct doc_id) > 1),
gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as j from windows join firsts using (run) where doc_id > smallest),
each as (select doc_id, j, w[j] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as j from worded)),
kept as (
  select doc_id, string_agg(word, ' ' order by j) as said, count(*) as n
  from each anti join gone using (doc_id, j) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(said, '')) as kept_sha256
from worded left join kept using (doc_id)"""


@query(_SQL)
def op8_substring_dedup(spark, folder):
    """Runs of 13 words that an earlier document has, in all documents."""
    return substring_dedup(documents(spark, folder)).drop("kept_text")
