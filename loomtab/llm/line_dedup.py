"""Line dedup: two Bloom filters find lines that may repeat, and only those are shuffled to be confirmed.

Every task adds the hashes of its lines (once per document) to a once-seen filter, and to a twice-seen filter when the
once-seen one has them already. Filters of tasks merge bit by bit: twice = twice1 | twice2 | once1 & once2. A line
whose bits are all in the merged twice-seen filter is a suspect; a line in two documents always is. Suspects are
counted exactly by their whole key, so the size of the filters changes the volume shuffled, never the result.

The filters get ``LINE_BITS`` bits for every line counted. Where that is more than ``MAX_BITS``, hash space is cut into
parts whose lines are filtered one after the other, each by another read of the texts under filters of ``MAX_BITS``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomtab.llm.common import documents, few_rows, joined, query, record, stored, texts
from loomtab.llm.wordblocks import SPACED, Texts, code_points_before, lines_of, mixed, run_hashes, signed, slices, unsigned

LINE_BITS = 8
MIN_BITS, MAX_BITS = 1 << 20, 1 << 29
SLICE_BITS = 1 << 16
PROBES = 2
HOT_PARTS = 1000


def stripped(text: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line bounds without white space at both ends."""
    solid = np.flatnonzero(SPACED[text.data])
    low, high = np.searchsorted(solid, start, "left"), np.searchsorted(solid, end, "left")
    some = high > low
    first, last = start.copy(), start.copy()
    first[some] = solid[low[some]]
    last[some] = solid[high[some] - 1] + 1
    return first, last


def line_keys(text: Texts, min_chars: int):
    """(line start, line end, owner, long enough?, key start, key end, key hash) of every line."""
    start, end, owner = lines_of(text)
    first, last = stripped(text, start, end)
    points = code_points_before(text)
    able = points[last] - points[first] >= min_chars
    return start, end, owner, able, first, last, run_hashes(text, first, last, seed=5)


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([mixed(hashes, 20 + i) % np.uint64(bits) for i in range(PROBES)])


def filter_bits(lines: int) -> tuple[int, int]:
    """(bits of a filter, parts of hash space) for a number of lines."""
    wanted = max(MIN_BITS, LINE_BITS * lines)
    parts = -(-wanted // MAX_BITS)
    return -(-wanted // (parts * SLICE_BITS)) * SLICE_BITS, parts


def in_part(hashes: np.ndarray, part: int, parts: int) -> np.ndarray:
    return mixed(hashes, 27) % np.uint64(parts) == np.uint64(part)


def _once_twice(batches: Iterable[pa.RecordBatch], bits: int, min_chars: int, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Sorted bit positions of a task's two filters, cut into slices."""
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for batch in batches:
        for rows, text in slices(batch):
            _, _, owner, able, _, _, hashes = line_keys(text, min_chars)
            able &= in_part(hashes, part, parts)
            doc = mixed(unsigned(rows.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)), 8)[owner[able]]
            line = hashes[able]
            line = line[np.unique(line ^ doc, return_index=True)[1]]  # once per document
            value, times = np.unique(line, return_counts=True)
            for place in probes(value, bits):
                byte, bit = (place >> np.uint64(3)).astype(np.int64), (1 << (place & np.uint64(7))).astype(np.uint8)
                had = (once[byte] & bit) > 0
                again = had | (times > 1)
                np.bitwise_or.at(twice, byte[again], bit[again])
                np.bitwise_or.at(once, byte, bit)
    schema = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    width = SLICE_BITS // 8
    for at in range(0, len(once), width):
        o, t = once[at : at + width], twice[at : at + width]
        if o.any():
            places = [np.flatnonzero(np.unpackbits(x, bitorder="little")).astype(np.uint16).tobytes() for x in (o, t)]
            yield record(schema, slice=[at // width], once=[places[0]], twice=[places[1]])


def twice_seen(docs: DataFrame, bits: int, min_chars: int = 20, part: int = 0, parts: int = 1) -> np.ndarray:
    """The merged twice-seen filter of a part of all lines, of ``bits`` / 8 bytes."""

    def merge(table: pa.Table) -> pa.Table:
        seen = np.bincount(joined(table["once"], np.uint16), minlength=SLICE_BITS) > 1
        seen[joined(table["twice"], np.uint16)] = True
        return pa.table({"slice": table["slice"][:1], "twice": pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary())})

    parts = docs.mapInArrow(lambda b: _once_twice(b, bits, min_chars, part, parts), "slice int, once binary, twice binary")
    merged = parts.groupBy("slice").applyInArrow(merge, "slice int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in few_rows(merged):
        at = row["slice"] * (SLICE_BITS // 8)
        out[at : at + SLICE_BITS // 8] = np.frombuffer(row["twice"], np.uint8)
    return out


def suspects(docs: DataFrame, bits: int, min_chars: int = 20, part: int = 0, parts: int = 1) -> DataFrame:
    """(doc_id, check, line hash, key) of every line of a part that its twice-seen filter holds, once per row of ``docs``.

    ``check`` tells rows without an id apart by their text; it is 0 where there is an id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, bits, min_chars, part, parts).tobytes())  # at most MAX_BITS

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("check", pa.int64()), ("line", pa.int64()), ("key", pa.string())])
        filled = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for rows, text in slices(batch):
                _, _, owner, able, first, last, hashes = line_keys(text, min_chars)
                pick = np.flatnonzero(able & in_part(hashes, part, parts))
                for i in range(PROBES):
                    place = probes(hashes[pick], bits)[i]
                    bit = filled[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)
                    pick = pick[(bit & 1) > 0]
                pick = pick[np.unique(hashes[pick] ^ mixed(owner[pick].astype(np.uint64), 8), return_index=True)[1]]
                keys = [text.data[a:b].tobytes().lower().decode() for a, b in zip(first[pick], last[pick])]
                of = pa.array(owner[pick])
                yield record(schema, doc_id=rows.column("doc_id").take(of), check=rows.column("check").take(of), line=signed(hashes[pick]), key=keys)

    return docs.withColumn("check", _check("doc_id", "text")).mapInArrow(emit, "doc_id long, check long, line long, key string")


def _check(key: str, text: str):
    return F.when(F.col(key).isNull(), F.xxhash64(F.col(text))).otherwise(F.lit(0))


def dropped_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, bits: int | None = None) -> DataFrame:
    """(doc_id, check, drops): hashes of the lines a document loses, for documents that lose any. ``bits`` fixes the filters' size."""
    parts = 1
    if bits is None:
        lines = docs.agg(F.sum(1 + F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)))).first()[0] or 0
        bits, parts = filter_bits(lines)
    found = stored(suspects(docs, bits, min_chars, 0, parts), "suspects")
    for part in range(1, parts):
        found = found.unionByName(stored(suspects(docs, bits, min_chars, part, parts), "suspects"))
    counts = found.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"), F.count("*").alias("rows"))
    confirmed = stored(counts.filter(F.col("n") >= min_docs).select(F.col("key").alias("shared_key"), "keeper", "rows"), "confirmed")
    # At most HOT_PARTS keys can hold a thousandth of the suspects each; the others spread over the tasks of a shuffle.
    hot = max(1000, found.count() // HOT_PARTS)
    heavy, light = F.broadcast(confirmed.filter(F.col("rows") >= hot)), confirmed.filter(F.col("rows") < hot)
    same = F.col("key") == F.col("shared_key")
    met = found.join(heavy, same).unionByName(found.join(heavy, same, "left_anti").join(light, same))
    lost = met.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "check").agg(F.collect_set("line").alias("drops"))


def with_kept_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, bits: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``__kept`` (the text of the lines that stay), ``__lines`` and ``__dropped``."""
    lost = dropped_lines(texts(docs, key, text), min_docs, min_chars, bits).select(
        F.col("doc_id").alias("__of"), F.col("check").alias("__check"), F.col("drops").alias("__drops")
    )

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body in slices(batch, text):
                start, end, owner, able, _, _, hashes = line_keys(body, min_chars)
                drops, n = part.column("__drops"), len(part)
                sizes = drops.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                banned = mixed(unsigned(drops.flatten().to_numpy(zero_copy_only=False))) ^ mixed(np.repeat(np.arange(n), sizes).astype(np.uint64), 9)
                gone = able & np.isin(mixed(hashes) ^ mixed(owner.astype(np.uint64), 9), banned)
                lines, n_gone = np.bincount(owner, minlength=n), np.bincount(owner[gone], minlength=n)
                first = np.concatenate([[0], np.cumsum(lines)])
                kept = []
                for i in range(n):
                    if n_gone[i]:
                        kept.append(b"\n".join(body.data[start[j] : end[j]].tobytes() for j in range(first[i], first[i + 1]) if not gone[j]))
                    else:
                        kept.append(body.text(i))
                more = [pa.array([x.decode() for x in kept], pa.string()), pa.array(lines), pa.array(n_gone)]
                names = [x for x in part.schema.names if x != "__drops"]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), *more], [*names, "__kept", "__lines", "__dropped"])

    same = F.col(key).cast("long").eqNullSafe(F.col("__of")) & (_check(key, text) == F.col("__check"))
    met = docs.join(lost, same, "left").drop("__of", "__check")
    added = [StructField("__kept", StringType()), StructField("__lines", LongType()), StructField("__dropped", LongType())]
    return met.mapInArrow(rewrite, StructType([*docs.schema.fields, *added]))


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, bits: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_text and its sha256.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of at least ``min_chars`` code
    points in at least ``min_docs`` documents lose their lines in all documents but the one of largest key; that one
    keeps all of them. A null or empty text is one empty line. Rows of one doc_id are one document; rows without a
    doc_id count for no key but lose the lines that others confirm. An empty table gives an empty table.
    """
    rows = with_kept_lines(texts(docs, key, text), min_docs, min_chars, bits)
    digest = F.sha2(F.col("__kept"), 256).alias("kept_sha256")
    return rows.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.col("__kept").alias("kept_text"), digest)


_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as place
  from documents),
keyed as (
  select *, translate(regexp_replace(line, '^[ \t\n\x0B\x0C\r]+|[ \t\n\x0B\x0C\r]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
shared as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3)
select doc_id, count(*) as n_lines, count(*) filter (where keeper is not null and doc_id <> keeper) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where keeper is null or doc_id = keeper), '')) as kept_sha256
from keyed left join shared using (k) group by doc_id"""


@query(_SQL)
def op4_line_dedup(spark, folder):
    """Repeated lines of all documents."""
    return line_dedup(documents(spark, folder)).drop("kept_text")
