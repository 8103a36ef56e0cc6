"""MinHash near-duplicates by an inverted join of signature coordinates.

A signature holds, for each of ``COORDINATES`` hash functions, the smallest hash of a document's shingles; two documents
agree in a coordinate with probability J. ``least_matches`` is the largest number of agreements that a pair at the
threshold reaches in all but one of ``1 / MISS`` cases, so pairs with fewer are no candidates.

Documents are posted under each (coordinate, value). Lists of one document are skipped, and so are documents that share
fewer than the least number of lists. Of the rest only the prefix is merged: with m coordinates and T matches needed, the
m - T + 1 shortest lists of a document (unshared ones count first) hold one that a matching document has in its prefix
too. Short lists give all their pairs; in a long one every member meets its smallest. Collisions over all coordinates are
then counted for each pair on one byte a coordinate, which never counts too few, and full shingle sets confirm it.

Long lists that still hold several components are merged in blocks: members outside the list's largest component are
compared with all others by signature, and what the threshold leaves is confirmed. Only spanning links are kept, so a
group of n copies costs n while no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.llm.common import documents, query, record, runs, stored, texts
from loomtab.llm.components import components
from loomtab.llm.parity_join import dense_links, shingles, verified
from loomtab.llm.wordblocks import mixed, signed, slices, unsigned

COORDINATES = 32
MISS = 1e-6
SHORT_LIST = 8
HOT_PARTS = 1000
SALTS = 64
BLOCK = 512
DENSE = 1


def least_matches(coordinates: int, percent: int, miss: float = MISS) -> int:
    """The largest T for which fewer than T agreements have at most probability ``miss`` at this Jaccard percentage."""
    p, below, t = percent / 100, 0.0, 0
    while t < coordinates:
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            break
        t += 1
    return max(t, 1)


def signature(owner: np.ndarray, value: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of smallest hashes for every owner that has a shingle, in order."""
    first = runs(owner)
    if not len(first):
        return np.empty((0, coordinates), np.uint64)
    return np.stack([np.minimum.reduceat(mixed(value, 100 + i), first) for i in range(coordinates)], axis=1)


def signatures(docs: DataFrame, k: int, coordinates: int) -> DataFrame:
    """(doc_id, n, s1, s2, lists, marks) of every row: set size, two set signatures, list names and a byte a coordinate."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("lists", pa.binary()), ("marks", pa.binary())])
        for batch in batches:
            for rows, text in slices(batch):
                owner, value, count = shingles(text, k)
                ends = np.cumsum(count)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(value, s))]) for s in (14, 15)]
                s1, s2 = (signed(x[ends] - x[ends - count]) for x in sums)
                sign = signature(owner, value, coordinates)
                names = mixed(sign + np.arange(coordinates, dtype=np.uint64), 60)
                marks = (sign & np.uint64(255)).astype(np.uint8)
                lists, bytes_of = [None] * len(rows), [None] * len(rows)
                for j, i in enumerate(np.flatnonzero(count)):
                    lists[i], bytes_of[i] = names[j].tobytes(), marks[j].tobytes()
                yield record(schema, doc_id=rows.column("doc_id"), n=count, s1=s1, s2=s2, lists=lists, marks=bytes_of)

    return docs.mapInArrow(emit, "doc_id long, n long, s1 long, s2 long, lists binary, marks binary")


def set_classes(sets: DataFrame) -> DataFrame:
    """``sets`` with ``rep``, the smallest doc_id of an equal shingle set; one row an id. A class of most rows is dealt by salt."""
    salted = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    least = salted.groupBy("n", "s1", "s2", "salt").agg(F.min("doc_id").alias("low"))
    reps = least.groupBy("n", "s1", "s2").agg(F.min("low").alias("rep"), F.collect_list("salt").alias("salts"))
    by_salt = reps.select("n", "s1", "s2", "rep", F.explode("salts").alias("salt"))
    return salted.join(by_salt, ["n", "s1", "s2", "salt"]).drop("salt", "s1", "s2").dropDuplicates(["doc_id"])


def postings(reps: DataFrame, coordinates: int) -> DataFrame:
    """(list, doc): one row for every coordinate of every document."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("list", pa.int64()), ("doc", pa.int64())])
        for batch in batches:
            names = np.frombuffer(b"".join(batch.column("lists").to_pylist()), np.int64)
            yield record(schema, list=names, doc=np.repeat(batch.column("doc_id").to_numpy(), coordinates))

    return reps.select("doc_id", "lists").mapInArrow(emit, "list long, doc long")


def prefix_postings(reps: DataFrame, coordinates: int, least: int, documents_in: int) -> DataFrame:
    """(list, doc, n, hub): each document under the shortest of its lists, as many as a match may need; hub is the list's smallest."""
    posted = postings(reps, coordinates)
    lists = stored(posted.groupBy("list").agg(F.count("*").alias("n"), F.min("doc").alias("hub")).filter("n > 1"), "lists")
    # All lists together hold coordinates * documents rows, so at most coordinates * HOT_PARTS of them are hot.
    hot = max(1000, documents_in // HOT_PARTS)
    heavy = F.broadcast(lists.filter(F.col("n") >= hot))
    light = lists.filter(F.col("n") < hot)
    shared = posted.join(heavy, "list").unionByName(posted.join(heavy.select("list"), "list", "left_anti").join(light, "list"))
    entry = F.struct("n", "list", "hub")
    by_doc = shared.groupBy("doc").agg(F.array_sort(F.collect_list(entry)).alias("mine")).filter(F.size("mine") >= least)
    first = F.slice("mine", F.lit(1), F.size("mine") - (least - 1))
    return by_doc.select("doc", F.inline(first))


def list_pairs(prefix: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: all pairs of short lists, and the hub with each member of long ones."""
    long_lists = prefix.filter(F.col("n") > SHORT_LIST).select(F.col("hub").alias("a"), F.col("doc").alias("b")).filter("a <> b")
    members = prefix.filter(F.col("n") <= SHORT_LIST).groupBy("list").agg(F.array_sort(F.collect_list("doc")).alias("docs")).filter("size(docs) > 1")
    later = F.transform("docs", lambda x, i: F.transform(F.slice("docs", i + 2, F.lit(SHORT_LIST)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    return long_lists.unionByName(members.select(F.inline(F.flatten(later)))).distinct()


def matching_pairs(pairs: DataFrame, reps: DataFrame, percent: int, least: int) -> DataFrame:
    """The pairs whose marks agree in at least ``least`` coordinates and whose sizes allow a link."""
    for side in ("a", "b"):
        of = reps.select(F.col("doc_id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"), F.col("marks").alias(f"{side}_marks"))
        pairs = pairs.join(of, F.col(side) == F.col(f"{side}_id")).drop(f"{side}_id")
    pairs = pairs.filter(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("a_marks", "b_marks"))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield record(schema, a=batch.column("a").filter(keep), b=batch.column("b").filter(keep))

    return pairs.select("a", "b", "a_marks", "b_marks").mapInArrow(count, "a long, b long")


def open_blocks(prefix: DataFrame, reps: DataFrame, found: DataFrame, percent: int, least: int) -> DataFrame:
    """(a, b, block) from long lists that hold several components yet.

    Members outside a list's largest component are cut into blocks that meet all blocks of the list, so a task holds two
    blocks. Pairs of different components that agree often enough are given; where they outnumber the members, the members
    are (b null) under a name of their own, to be compared whole, so no more rows leave than came in.
    """
    at = prefix.filter(F.col("n") > SHORT_LIST).select("list", "doc")
    at = at.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    tally = at.groupBy("list", "component").agg(F.count("*").alias("members"))
    sizes = tally.groupBy("list").agg(F.sum("members").alias("all"), F.max(F.struct("members", (-F.col("component")).alias("c"))).alias("top"), F.count("*").alias("kinds"))
    mixed_lists = sizes.filter("kinds > 1").select(
        "list", (-F.col("top.c")).alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("all") - F.col("top.members")) / BLOCK).cast("int").alias("strips"),
    )
    rows = at.join(mixed_lists, "list").join(reps.select(F.col("doc_id").alias("doc"), F.col("n").alias("size"), "marks"), "doc")
    spread = F.xxhash64("doc")
    strip, block = F.pmod(spread, F.col("strips")).cast("int"), F.pmod(spread, F.col("blocks")).cast("int")
    sides = F.sequence(F.lit(0), F.col("strips") - 1)
    meets = F.transform(sides, lambda s: F.struct(s.alias("strip"), block.alias("block"), F.lit(0).alias("side")))
    crosses = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(strip.alias("strip"), b.alias("block"), F.lit(1).alias("side")))
    both = F.when(F.col("component") == F.col("main"), meets).otherwise(F.concat(meets, crosses))
    dealt = rows.select("list", "doc", "component", "size", "marks", F.inline(both))

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        doc, component, size = (table[c].to_numpy() for c in ("doc", "component", "size"))
        marks = np.frombuffer(b"".join(table["marks"].to_pylist()), np.uint8).reshape(len(doc), -1)
        theirs, mine = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        pairs: set[tuple[int, int]] = set()
        limit = DENSE * len(doc)
        for i in mine:
            fit = component[theirs] != component[i]
            fit &= 100 * np.minimum(size[theirs], size[i]) >= percent * np.maximum(size[theirs], size[i])
            near = theirs[fit]
            near = near[(marks[near] == marks[i]).sum(axis=1) >= least]
            pairs.update((min(int(doc[i]), d), max(int(doc[i]), d)) for d in doc[near].tolist())
            if len(pairs) > limit:
                break
        if len(pairs) > limit:
            members = np.unique(doc)
            name = int(mixed(unsigned(members), 23).sum() >> np.uint64(1))
            return pa.table({"a": members, "b": pa.nulls(len(members), pa.int64()), "block": np.full(len(members), name)})
        rows = sorted(pairs)
        return pa.table({"a": pa.array([p[0] for p in rows], pa.int64()), "b": pa.array([p[1] for p in rows], pa.int64()), "block": pa.nulls(len(rows), pa.int64())})

    return dealt.groupBy("list", "strip", "block").applyInArrow(compare, "a long, b long, block long").distinct()


def coordinate_join(
    docs: DataFrame, k: int = 5, percent: int = 75, coordinates: int = COORDINATES, miss: float = MISS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a document is the set of its k-word shingles, or its whole
    word sequence when it has fewer words. Documents link when 100 * |A & B| >= percent * |A | B|; the component is the
    smallest doc_id reachable, and ``kept`` marks that document. A pair at the threshold is missed with probability
    ``miss``, one above it more rarely; no pair below it is linked. Null, empty and blank texts link with nothing and are
    kept; rows without an id link with nothing, have no component and are kept; rows of one id are one document and share
    its answer; an empty table gives an empty one. Other columns are not read.
    """
    rows = texts(docs, key, text)
    least = least_matches(coordinates, percent, miss)
    known = stored(signatures(rows, k, coordinates), "signatures")
    classes = stored(set_classes(known.filter("doc_id is not null and n > 0")), "classes")
    reps = classes.filter("doc_id = rep").select("doc_id", "n", "lists", "marks")
    prefix = stored(prefix_postings(reps, coordinates, least, reps.count()), "prefix")
    pairs = stored(matching_pairs(list_pairs(prefix), reps, percent, least), "matches")
    copies = classes.filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = components(stored(verified(pairs, rows, k, percent), "links").unionByName(copies))
    still = stored(open_blocks(prefix, reps, found, percent, least), "open")
    if not still.isEmpty():
        others = still.filter("b is not null").select("a", "b").join(pairs, ["a", "b"], "left_anti")
        late = verified(others, rows, k, percent).unionByName(dense_links(still.filter("b is null").select("a", "block"), rows, k, percent))
        found = components(late.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    out = known.join(found, F.col("doc_id") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


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
  select a, b from common join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) as (select a, b from links union select r.doc_id, l.b from reach r join links l on r.other = l.a),
found as (
  select w.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, least(w.doc_id, coalesce(min(other), w.doc_id)) as component_id
  from worded w left join sizes using (doc_id) left join reach r on r.doc_id = w.doc_id group by w.doc_id)
select *, doc_id = component_id as kept from found"""


@query(_SQL)
def op11_coordinate_join(spark, folder):
    """Near duplicates at 85 % among all documents."""
    return coordinate_join(documents(spark, folder), percent=85)
