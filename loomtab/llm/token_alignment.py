"""Alignment of two tokenizers by an associative monoid of fragments.

Places where a token of A and a token of B both end cut a text into groups. A byte range of a text yields a fragment: the
tokens up to the first such place (open prefix), the groups between (closed), and the tokens after the last (open suffix).
Two neighbouring fragments compose: suffix and next prefix close one group more. Composition is associative with the empty
fragment as unit, so the ranges of a long text are encoded and reduced as a tree, in any bracketing, by many Spark tasks.

Texts are cut for encoding only at a single space between characters that are no white space, where both tokenizers begin a
new unit whatever surrounds it (no piece of B holds a space but at its start; that is tested); a unit is a
range that begins and ends at common places, and its fragment is kept for its next occurrence in the task. A unit is encoded whole; the
tokens of a long one are cut by byte range. Texts of one chunk are finished where they are
read.

A link is an overlapping pair of tokens: the places where either token ends cut a group into pieces of which each belongs
to one pair. Corpus counts of pairs are summed by task and by pair. Pairs that hold at least 1 / ``FREQUENT`` of all links
are at most ``FREQUENT`` many and go to all tasks; the others meet their counts in a join, none of them hot.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.llm.common import documents, few_rows, from_planes, planes, query, record, runs, stored

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 16
RANGE = 1 << 12
FAN = 16
BATCH = 256
FREQUENT = 1 << 18
FLUSH = 1 << 21
OWNER = np.int64(40)  # bits of a byte offset within a text
SAFE = re.compile(r"(?<=\S) (?=\S)")
UNITS = 1 << 18
PAIRS = 1 << 21


def chunks_of(text: str, size: int, cuttable: bool = True) -> list[str]:
    """``text`` in parts of about ``size`` characters; joined by one space they are the text again."""
    out, at = [], 0
    while cuttable and len(text) - at > size:
        safe = SAFE.search(text, at + size - 1)
        if safe is None:
            break
        out.append(text[at : safe.start()])
        at = safe.end()
    return [*out, text[at:]]


def _none() -> np.ndarray:
    return np.empty(0, np.int64)


@dataclass
class Tokens:
    """Ids and end offsets of tokens of A and of B in one stretch of a text."""

    a: np.ndarray = field(default_factory=_none)
    a_end: np.ndarray = field(default_factory=_none)
    b: np.ndarray = field(default_factory=_none)
    b_end: np.ndarray = field(default_factory=_none)

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([x, y]) for x, y in zip(self.parts(), other.parts())))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_end, self.b, self.b_end

    def __len__(self) -> int:
        return len(self.a) + len(self.b)

    def written(self) -> bytes:
        return f"{','.join(map(str, self.a.tolist()))}|{','.join(map(str, self.b.tolist()))}".encode()

    def links(self, stride: int) -> np.ndarray:
        """Codes of the overlapping pairs of a closed group."""
        ends = np.union1d(self.a_end, self.b_end)
        return self.a[np.searchsorted(self.a_end, ends)] * stride + self.b[np.searchsorted(self.b_end, ends)]


@dataclass
class Fragment:
    """Alignment of one byte range: open prefix, closed groups (written, with their pairs), open suffix.

    ``cut`` says whether the range holds a place where both end; without one all its tokens are in the prefix.
    """

    same: bool = True
    n_a: int = 0
    n_b: int = 0
    cut: bool = False
    prefix: Tokens = field(default_factory=Tokens)
    n_closed: int = 0
    closed: list[bytes] = field(default_factory=list)
    code: np.ndarray = field(default_factory=_none)
    times: np.ndarray = field(default_factory=_none)
    suffix: Tokens = field(default_factory=Tokens)


def tally(code: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often each occurs."""
    if times is None:
        return np.unique(code, return_counts=True)
    order = np.argsort(code, kind="stable")
    code, times = code[order], times[order]
    first = runs(code)
    return code[first], np.add.reduceat(times, first) if len(first) else times


def compose(parts: Sequence[Fragment], stride: int) -> Fragment:
    """The fragment of neighbouring ranges, in order."""
    out = Fragment()
    codes, times = [], []
    for p in parts:
        out.same &= p.same
        out.n_a, out.n_b = out.n_a + p.n_a, out.n_b + p.n_b
        codes.append(p.code)
        times.append(p.times)
        if not out.cut:
            out.prefix, out.suffix, out.cut = out.prefix + p.prefix, p.suffix, p.cut
            out.n_closed, out.closed = p.n_closed, list(p.closed)
        elif not p.cut:
            out.suffix = out.suffix + p.prefix
        else:
            middle = out.suffix + p.prefix
            if len(middle):
                code, n = tally(middle.links(stride))
                codes.append(code)
                times.append(n)
                out.closed.append(middle.written())
                out.n_closed += 1
            out.closed += p.closed
            out.n_closed, out.suffix = out.n_closed + p.n_closed, p.suffix
    if codes:
        out.code, out.times = tally(np.concatenate(codes), np.concatenate(times))
    return out


@dataclass
class Whole:
    """Alignment of a range that begins and ends at common places."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    written: bytes = b""
    code: np.ndarray = field(default_factory=_none)
    times: np.ndarray = field(default_factory=_none)

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.written).hexdigest() if self.n_groups else ""


def finish(whole: Fragment, stride: int) -> Whole:
    """A fragment whose range begins and ends at common places; nothing where bytes did not come back."""
    if not whole.same or not whole.cut:
        return Whole()
    if not len(whole.prefix):
        return Whole(whole.n_a, whole.n_b, whole.n_closed, b";".join(whole.closed), whole.code, whole.times)
    code, n = tally(whole.prefix.links(stride))
    code, times = tally(np.concatenate([whole.code, code]), np.concatenate([whole.times, n]))
    return Whole(whole.n_a, whole.n_b, whole.n_closed + 1, b";".join([whole.prefix.written(), *whole.closed]), code, times)


def _digits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of ids, left-aligned in rows with room for a separator, and how many."""
    width = len(str(int(ids.max(initial=0))))
    count = np.ones(len(ids), np.int64)
    for p in range(1, width):
        count += ids >= 10**p
    rows = np.zeros((len(ids), width + 1), np.uint8)
    for place in range(width):
        here = place < count
        rows[here, place] = 48 + (ids[here] // 10 ** (count[here] - 1 - place)) % 10
    return rows, count


@dataclass
class Groups:
    """Written groups and pairs of many byte ranges: those of range i are text[text_at[i]:text_at[i + 1]] and code[code_at[i]:code_at[i + 1]]."""

    cuts: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    text: bytes
    text_at: np.ndarray
    code: np.ndarray
    times: np.ndarray
    code_at: np.ndarray


def grouped(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, n: int, stride: int, opening: int) -> Groups:
    """Groups of ``n`` byte ranges at once; ends are offsets plus the range's number shifted by ``OWNER``, ascending.

    Of a range's groups, numbered from 0, those from ``opening`` up to its last common place are closed: 0 where ranges
    begin at common places, else 1.
    """
    owner_a, owner_b = a_end >> OWNER, b_end >> OWNER
    common = np.intersect1d(a_end, b_end, assume_unique=True)
    cuts = np.bincount(common >> OWNER, minlength=n)
    cuts_before = np.concatenate([[0], np.cumsum(cuts)])
    group_a, group_b = (np.searchsorted(common, end) - cuts_before[owner] for end, owner in ((a_end, owner_a), (b_end, owner_b)))

    # Tokens by range, group and tokenizer, each with its separator, as one run of bytes.
    inner_a, inner_b = ((g >= opening) & (g < cuts[o]) for g, o in ((group_a, owner_a), (group_b, owner_b)))
    ids = np.concatenate([a[inner_a], b[inner_b]])
    range_ = np.concatenate([owner_a[inner_a], owner_b[inner_b]])
    name = np.concatenate([(owner_a[inner_a] << OWNER) + 2 * group_a[inner_a], (owner_b[inner_b] << OWNER) + 2 * group_b[inner_b] + 1])
    order = np.argsort(name, kind="stable")
    ids, range_, name = ids[order], range_[order], name[order]
    rows, count = _digits(ids)
    last = np.append(name[1:] != name[:-1], True) if len(name) else np.empty(0, bool)
    rows[np.arange(len(ids)), count] = np.where(last, np.where(name & 1, ord(";"), ord("|")), ord(","))
    text = rows[np.arange(rows.shape[1]) <= count[:, None]].tobytes()
    text_at = np.concatenate([[0], np.cumsum(np.bincount(range_, count + 1, n).astype(np.int64))])

    # Links: every place where a token ends closes one piece, held by one token of each side.
    ends = np.union1d(a_end, b_end)
    piece = np.searchsorted(common, ends) - cuts_before[ends >> OWNER]
    ends = ends[(piece >= opening) & (piece < cuts[ends >> OWNER])]
    code, of = a[np.searchsorted(a_end, ends)] * stride + b[np.searchsorted(b_end, ends)], ends >> OWNER
    order = np.lexsort((code, of))
    code, of = code[order], of[order]
    first = runs(of, code)
    times = np.diff(np.append(first, len(code)))
    return Groups(cuts, group_a, group_b, text, text_at, code[first], times, np.searchsorted(of[first], np.arange(n + 1)))


def fragments(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, n: int, same: np.ndarray, stride: int) -> list[Fragment]:
    """The fragments of ``n`` byte ranges, given as to ``grouped``."""
    g = grouped(a, a_end, b, b_end, n, stride, 1)
    first_a, first_b = (np.searchsorted(end >> OWNER, np.arange(n + 1)) for end in (a_end, b_end))
    offset = (np.int64(1) << OWNER) - 1
    out = []
    for i in range(n):
        at, to, cuts = slice(first_a[i], first_a[i + 1]), slice(first_b[i], first_b[i + 1]), int(g.cuts[i])
        x, y, u, v = (
            np.searchsorted(group[part], cut) if cuts else part.stop - part.start
            for cut in (1, cuts) for group, part in ((g.group_a, at), (g.group_b, to))
        )
        ids_a, ends_a, ids_b, ends_b = a[at], a_end[at] & offset, b[to], b_end[to] & offset
        pairs, body = slice(g.code_at[i], g.code_at[i + 1]), g.text[g.text_at[i] : max(g.text_at[i], g.text_at[i + 1] - 1)]
        out.append(
            Fragment(
                bool(same[i]), len(ids_a), len(ids_b), cuts > 0, Tokens(ids_a[:x], ends_a[:x], ids_b[:y], ends_b[:y]), max(cuts - 1, 0),
                [body] if body else [], g.code[pairs], g.times[pairs], Tokens(ids_a[u:], ends_a[u:], ids_b[v:], ends_b[v:]),
            )
        )
    return out


def laid_out(kit: Tokenizer, units: Sequence[str], size: int):
    """(a, a_end, b, b_end, ranges, same): tokens of all units, ends in byte ranges of ``size``, ranges and bytes by unit."""
    ids_a, ids_b, same = kit.encode(units)
    count = [np.array([len(x) if ok else 0 for x, ok in zip(ids, same)], np.int64) for ids in (ids_a, ids_b)]
    a, b = (np.array([t for x, ok in zip(ids, same) if ok for t in x], np.int64) for ids in (ids_a, ids_b))
    ends = []
    for ids, length, n in ((a, kit.length_a, count[0]), (b, kit.length_b, count[1])):
        end = np.concatenate([[0], np.cumsum(length[ids])])
        ends.append(end[1:] - np.repeat(end[np.cumsum(n) - n], n))
    total = np.zeros(len(units), np.int64)
    np.maximum.at(total, np.repeat(np.arange(len(units)), count[0]), ends[0])
    ranges = np.maximum(1, -(-total // size))
    first = np.cumsum(ranges) - ranges
    a_end, b_end = (end + (np.repeat(first, n) + (np.maximum(end, 1) - 1) // size << OWNER) for end, n in zip(ends, count))
    return a, a_end, b, b_end, ranges, same, count


def align(kit: Tokenizer, units: Sequence[str], size: int) -> list[list[Fragment]]:
    """Fragments of the byte ranges of each unit."""
    a, a_end, b, b_end, ranges, same, _ = laid_out(kit, units, size)
    every = iter(fragments(a, a_end, b, b_end, int(ranges.sum()), np.repeat(same, ranges), len(kit.bytes_b)))
    return [[next(every) for _ in range(n)] for n in ranges.tolist()]


class Tokenizer:
    """Both tokenizers of one worker, with the bytes of their tokens."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import sentencepiece
        from tokenizers import Tokenizer as Bytes

        self.a = Bytes.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        printable = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
        letters = {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(printable))}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(letters[c] for c in name) if set(name) <= letters.keys() else name.encode() for name in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)

        self.forget()

    def forget(self) -> None:
        """Empty the store of units: number by text, written groups, and per unit sizes and pairs."""
        self.number: dict[str, int] = {}
        self.written: list[bytes] = []
        self.sizes = np.empty((0, 5), np.int64)  # same, n_a, n_b, n_groups, distinct pairs
        self.code, self.times = _none(), _none()

    def encode(self, units: Sequence[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids by A of space + unit and by B of the unit, and whether the bytes of both spell space + unit."""
        spaced = [" " + u for u in units]
        a = [e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)]
        b = self.b.encode(list(units), num_threads=1)
        same = [
            b"".join(map(self.bytes_a.__getitem__, x)) == s and b"".join(map(self.bytes_b.__getitem__, y)) == s
            for s, x, y in zip((s.encode() for s in spaced), a, b)
        ]
        return a, b, np.array(same, bool)

    def learn(self, units: Sequence[str], size: int) -> None:
        """Store the closed fragments of units: those of one byte range all at once, others composed from their ranges."""
        short = [u for u in units if len(u) * 4 < size]
        a, a_end, b, b_end, _, same, count = laid_out(self, short, size)
        g = grouped(a, a_end, b, b_end, len(short), len(self.bytes_b), 0)
        self.store(
            short, [g.text[x : max(x, y - 1)] for x, y in zip(g.text_at.tolist(), g.text_at[1:].tolist())],
            np.stack([same, *count, g.cuts, np.diff(g.code_at)], axis=1).astype(np.int64), g.code, g.times,
        )
        long = [u for u in units if len(u) * 4 >= size]
        for unit, parts in zip(long, align(self, long, size)):
            f = compose(parts, len(self.bytes_b))
            w = finish(f, len(self.bytes_b))
            self.store([unit], [w.written], np.array([[f.same, w.n_a, w.n_b, w.n_groups, len(w.code)]], np.int64), w.code, w.times)

    def store(self, units: Sequence[str], written: list[bytes], sizes: np.ndarray, code: np.ndarray, times: np.ndarray) -> None:
        self.number.update(zip(units, range(len(self.written), len(self.written) + len(units))))
        self.written += written
        self.sizes, self.code, self.times = (np.concatenate(x) for x in ((self.sizes, sizes), (self.code, code), (self.times, times)))


@functools.lru_cache(maxsize=2)
def tokenizer(byte_bpe: str, piece_bpe: str) -> Tokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer(byte_bpe, piece_bpe)


def of_texts(kit: Tokenizer, texts: Sequence[str], size: int) -> list[Fragment]:
    """The closed fragment of each text, or of each chunk of one: its units' fragments composed."""
    if len(kit.written) > UNITS or len(kit.code) > PAIRS:
        kit.forget()
    units = [SAFE.split(t) if kit.cuttable else [t] for t in texts]
    kit.learn(sorted(set().union(*units) - kit.number.keys()), size)
    count = np.array([len(u) for u in units])
    unit = np.fromiter(map(kit.number.__getitem__, chain.from_iterable(units)), np.int64, int(count.sum()))
    end = np.cumsum(count)
    sizes = np.add.reduceat(kit.sizes[unit], end - count) if len(unit) else kit.sizes[:0]

    # Pairs: the distinct units of each text, then their pairs, each as often as unit and pair say.
    key, again = tally((np.repeat(np.arange(len(texts)), count) << 32) | unit)
    pairs = kit.sizes[key & 0xFFFFFFFF, 4]
    at = np.cumsum(kit.sizes[:, 4])[key & 0xFFFFFFFF] - pairs
    place = np.repeat(at - (np.cumsum(pairs) - pairs), pairs) + np.arange(pairs.sum())
    code, times = tally((np.repeat(key >> 32, pairs) << 32) | kit.code[place], kit.times[place] * np.repeat(again, pairs))
    text_at = np.searchsorted(code, np.arange(len(texts) + 1) << 32)
    out = []
    for i, (e, n) in enumerate(zip(end.tolist(), count.tolist())):
        same = bool(sizes[i, 0] == n)
        here = slice(text_at[i], text_at[i + 1])
        written = b";".join(map(kit.written.__getitem__, unit[e - n : e].tolist()))
        out.append(Fragment(same, int(sizes[i, 1]), int(sizes[i, 2]), True, n_closed=int(sizes[i, 3]), closed=[written], code=code[here] & 0xFFFFFFFF, times=times[here]))
    return out


_FRAGMENT = pa.schema(
    [("row", pa.int64()), ("at", pa.int64()), ("same", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("cut", pa.bool_()), ("n_closed", pa.int64())]
    + [(c, pa.binary()) for c in ("p0", "p1", "p2", "p3", "s0", "s1", "s2", "s3", "closed", "code", "times")]
)
FRAGMENT = "row long, at long, same boolean, n_a long, n_b long, cut boolean, n_closed long, " + ", ".join(
    f"{c} binary" for c in ("p0", "p1", "p2", "p3", "s0", "s1", "s2", "s3", "closed", "code", "times")
)
RESULT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, code binary, times binary"
_RESULT = pa.schema(
    [(c, pa.int64()) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string()), ("code", pa.binary()), ("times", pa.binary())]
)


def fragment_rows(rows: Sequence[tuple[int, int, Fragment]]) -> pa.RecordBatch:
    return record(
        _FRAGMENT, row=[r for r, _, _ in rows], at=[at for _, at, _ in rows],
        **{c: [getattr(f, c) for _, _, f in rows] for c in ("same", "n_a", "n_b", "cut", "n_closed")},
        **{f"{side[0]}{j}": [getattr(f, side).parts()[j].tobytes() for _, _, f in rows] for side in ("prefix", "suffix") for j in range(4)},
        closed=[b";".join(f.closed) for _, _, f in rows], code=[f.code.tobytes() for _, _, f in rows], times=[f.times.tobytes() for _, _, f in rows],
    )


def fragment_of(row: dict) -> Fragment:
    ints = {c: np.frombuffer(row[c], np.int64) for c in ("p0", "p1", "p2", "p3", "s0", "s1", "s2", "s3", "code", "times")}
    prefix, suffix = (Tokens(*(ints[f"{s}{j}"] for j in range(4))) for s in ("p", "s"))
    closed = [row["closed"]] if row["closed"] else []
    return Fragment(row["same"], row["n_a"], row["n_b"], row["cut"], prefix, row["n_closed"], closed, ints["code"], ints["times"], suffix)


def result_rows(rows: Sequence[tuple[int, int | None, Whole]]) -> pa.RecordBatch:
    columns = {c: [getattr(w, c) for _, _, w in rows] for c in ("n_a", "n_b", "n_groups")}
    columns |= {c: [planes(getattr(w, c).astype(np.uint32)) for _, _, w in rows] for c in ("code", "times")}
    links, digest = [int(w.times.sum()) for _, _, w in rows], [w.digest for _, _, w in rows]
    return record(_RESULT, row=[r for r, _, _ in rows], doc_id=[d for _, d, _ in rows], n_links=links, groups_sha256=digest, **columns)


def aligned(docs: DataFrame, byte_bpe: str, piece_bpe: str, chunk: int, size: int) -> DataFrame:
    """One row per document in the schema ``RESULT``: counts, digest, and packed pairs with how often each occurs in it."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = tokenizer(byte_bpe, piece_bpe)
        wide = _RESULT.append(pa.field("at", pa.int64())).append(pa.field("chunk", pa.string()))
        for batch in batches:
            for i in range(0, len(batch), BATCH):
                part = batch.slice(i, BATCH)
                row, doc, text = (part.column(c).to_pylist() for c in ("row", "doc_id", "text"))
                cut = [chunks_of(t or "", chunk, kit.cuttable) for t in text]
                here = [j for j, x in enumerate(cut) if len(x) == 1]
                got = of_texts(kit, [cut[j][0] for j in here], size)
                done = [(row[j], doc[j], finish(f, len(kit.bytes_b)) if text[j] else Whole()) for j, f in zip(here, got)]
                rows = result_rows(done)
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.nulls(len(done), wide.field(c).type) for c in ("at", "chunk"))], schema=wide)
                for j, x in enumerate(cut):  # chunks of a long text are dealt to other tasks, a few rows at a time
                    if len(x) > 1:
                        blank = {f.name: pa.nulls(len(x), f.type) for f in _RESULT}
                        blank |= {"row": [row[j]] * len(x), "doc_id": [doc[j]] * len(x)}
                        yield record(wide, **blank, at=range(len(x)), chunk=x)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = tokenizer(byte_bpe, piece_bpe)
        for batch in batches:
            for i in range(0, len(batch), 8):
                part = batch.slice(i, 8)
                row, at, text = (part.column(c).to_pylist() for c in ("row", "at", "chunk"))
                yield fragment_rows(list(zip(row, at, of_texts(kit, text, size))))

    def reduce(table: pa.Table) -> pa.Table:
        stride = len(tokenizer(byte_bpe, piece_bpe).bytes_b)
        rows = table.sort_by("at").to_pylist()
        return pa.Table.from_batches([fragment_rows([(rows[0]["row"], rows[0]["up"], compose([fragment_of(r) for r in rows], stride))])])

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = len(tokenizer(byte_bpe, piece_bpe).bytes_b)
        for batch in batches:
            for r in batch.to_pylist():
                yield result_rows([(r["row"], r["doc_id"], finish(fragment_of(r), stride))])

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    first = stored(numbered.mapInArrow(read, RESULT + ", at long, chunk string"), "aligned")
    whole = first.filter("at is null").select(*_RESULT.names)
    chunks = first.filter("at is not null").select("row", "doc_id", "at", "chunk")
    deepest = chunks.agg(F.max("at")).first()[0]
    if deepest is None:
        return whole
    now = stored(chunks.select("row", "at", "chunk").repartition("row", "at").mapInArrow(encode, FRAGMENT), "fragments")
    while deepest > 0:
        deepest //= FAN
        up = now.withColumn("up", F.floor(F.col("at") / FAN).cast("long"))
        now = stored(up.groupBy("row", "up").applyInArrow(reduce, FRAGMENT), "fragments")
    names = chunks.filter("at = 0").select(F.col("row").alias("of"), "doc_id")
    return whole.unionByName(now.join(names, F.col("row") == F.col("of")).drop("of").mapInArrow(close, RESULT))


def pair_counts(known: DataFrame, stride: int) -> DataFrame:
    """(code, n, best): links of every pair in the corpus, and whether no pair of its B id has more."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])
        held, size = [], 0
        for batch in batches:
            held.append((from_planes(batch.column("code"), np.uint32).astype(np.int64), from_planes(batch.column("times"), np.uint32).astype(np.int64)))
            size += len(held[-1][0])
            if size > FLUSH:
                held = [tally(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield record(schema, code=held[0][0], n=held[0][1])
                    held, size = [], 0
        if size:
            code, n = tally(*(np.concatenate(x) for x in zip(*held)))
            yield record(schema, code=code, n=n)

    totals = stored(known.select("code", "times").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    highest = totals.groupBy((F.col("code") % stride).alias("b")).agg(F.max("n").alias("top"))  # one row an id of B at most
    counts = totals.join(F.broadcast(highest), F.col("code") % stride == F.col("b"))
    return counts.select("code", "n", (F.col("n") == F.col("top")).cast("int").alias("best"))


def scored(known: DataFrame, counts: DataFrame) -> DataFrame:
    """``known`` with n_best and count_sum."""
    spark = known.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = few_rows(counts.filter(F.col("n") * FREQUENT >= total).orderBy("code"))  # at most FREQUENT rows hold so many links
    table = {c: np.array([r[c] for r in frequent], np.int64) for c in ("code", "n", "best")}
    shared = spark.sparkContext.broadcast({c: table[c].tobytes() for c in table})

    def looked_up(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        code = from_planes(batch.column("code"), np.uint32).astype(np.int64)
        times = from_planes(batch.column("times"), np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(batch)), [len(x) // 4 for x in batch.column("code").to_pylist()])
        names = np.frombuffer(shared.value["code"], np.int64)
        at = np.searchsorted(names, code)
        hit = np.zeros(len(code), bool)
        hit[at < len(names)] = names[at[at < len(names)]] == code[at < len(names)]
        return code, times, of, at, hit

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _RESULT][:-2]
        n, best = (np.frombuffer(shared.value[c], np.int64) for c in ("n", "best"))
        for batch in batches:
            _, times, of, at, hit = looked_up(batch)
            sums = []
            for each in (best, n):
                total = np.zeros(len(batch), np.int64)
                np.add.at(total, of[hit], times[hit] * each[at[hit]])
                sums.append(total)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, sums)], names=[*names, "n_best", "count_sum"])

    def rest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("of", pa.int64()), ("code", pa.int64()), ("times", pa.int64())])
        for batch in batches:
            code, times, of, _, hit = looked_up(batch)
            yield record(schema, of=batch.column("row").to_numpy()[of[~hit]], code=code[~hit], times=times[~hit])

    kept = ", ".join(RESULT.split(", ")[:-2])
    base = known.mapInArrow(look, f"{kept}, n_best long, count_sum long")
    rare = known.select("row", "code", "times").mapInArrow(rest, "of long, code long, times long").join(counts, "code")
    more = rare.groupBy("of").agg(F.sum(F.col("times") * F.col("best")).alias("b"), F.sum(F.col("times") * F.col("n")).alias("c"))
    out = base.join(more, F.col("row") == F.col("of"), "left")
    return out.withColumn("n_best", F.col("n_best") + F.coalesce("b", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("c", F.lit(0)))


def token_alignment(
    docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, size: int = RANGE
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts are encoded without special tokens, whose strings count as plain text. Null and empty texts, and texts whose
    token bytes are not space + text under either tokenizer, have zeros and an empty digest, and add nothing to the counts.
    Repeated rows each count; rows without an id are returned without one; an empty table gives an empty one; other columns
    are not read. Texts over ``chunk`` characters are encoded in chunks by several tasks and composed by a tree reduction. The
    tokenizers' files must be readable under their paths on every executor.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = stored(aligned(rows, byte_bpe, piece_bpe, chunk, size), "alignment")
    stride = len(tokenizer(byte_bpe, piece_bpe).bytes_b)
    out = scored(known, stored(pair_counts(known, stride), "counts"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query()
def op12_token_alignment(spark, folder):
    """Alignment of a byte-level BPE and a piece BPE over all documents."""
    return token_alignment(documents(spark, folder))
