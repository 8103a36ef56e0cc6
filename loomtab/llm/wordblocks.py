"""Words, word hashes and windows of many texts at once, as NumPy arrays over an Arrow column's bytes.

A null text counts as empty. Texts are cut into slices of whole rows of about ``SLICE`` bytes, so working
memory does not depend on the size of an Arrow batch (one text longer than that is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

SLICE = 2 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LONG_WORD = 64


def _byte_class(separators: str) -> np.ndarray:
    inside = np.ones(256, dtype=bool)
    inside[list(separators.encode("latin-1"))] = False
    return inside


# Words are runs of anything but ASCII white space, or runs of letters, digits and bytes over 0x7F.
SPACED = _byte_class(" \t\n\x0b\x0c\r")
ALNUM = _byte_class("".join(chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha())))


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = values + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """Bytes of several texts: text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts_of(column: pa.Array) -> Texts:
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return Texts(np.empty(0, np.uint8), np.zeros(1, np.int64))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Runs of whole rows of about ``size`` bytes of text."""
    whole = texts_of(batch.column(text))
    at = 0
    while at < len(whole):
        end = max(at + 1, int(np.searchsorted(whole.offsets, whole.offsets[at] + size, "right")) - 1)
        part = whole.offsets[at : end + 1]
        yield batch.slice(at, end - at), Texts(whole.data[part[0] : part[-1]], part - part[0])
        at = end


@dataclass
class Words:
    """Word j is data[start[j]:end[j]] of text owner[j]; first[i] is the index of text i's first word."""

    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    count: np.ndarray
    first: np.ndarray


def words_of(texts: Texts, inside: np.ndarray = SPACED) -> Words:
    n = len(texts.data)
    mask = inside[texts.data]
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    edges = texts.offsets[(texts.offsets < n)]
    before[edges] = False
    start = np.flatnonzero(mask & ~before)
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(mask & ~after) + 1
    owner = np.searchsorted(texts.offsets, start, "right") - 1
    count = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    return Words(start, end, owner, count, first)


def run_hashes(texts: Texts, start: np.ndarray, end: np.ndarray, lower: bool = True, seed: int = 0) -> np.ndarray:
    """64-bit hash of every byte run, A-Z lower-cased first if asked."""
    table = mixed(np.arange(256, dtype=np.uint64), seed + 1)
    if lower:
        table = table[_LOWER]
    length = end - start
    order = np.argsort((65535 - np.minimum(length, 65535)).astype(np.uint16), kind="stable")  # 16 bits: a radix sort
    begin, size = start[order], length[order]
    value = np.full(len(start), (seed * 2 + 1) * 0x51ED270B % (1 << 64), np.uint64)
    multiplier = _MULTIPLIER + np.uint64(2 * seed)
    k = int((size > LONG_WORD).sum())
    if k:  # long runs one by one
        data = texts.data.tobytes()
        data = data.lower() if lower else data  # of bytes: A-Z alone
        value[:k] = [xxh3_64_intdigest(data[a:b], seed) for a, b in zip(begin[:k].tolist(), (begin[:k] + size[:k]).tolist())]
    rest, at = value[k:], begin[k:]
    longer = len(rest) - np.cumsum(np.bincount(size[k:], minlength=1))  # how many are longer than j
    for j in range(len(longer) - 1):
        n = int(longer[j])
        rest[:n] = rest[:n] * multiplier + table[texts.data[at[:n] + j]]
    out = np.empty_like(value)
    out[order] = value
    return mixed(out, seed)


def word_hashes(texts: Texts, words: Words, lower: bool = True, seed: int = 0) -> np.ndarray:
    return run_hashes(texts, words.start, words.end, lower, seed)


def windows(hashes: np.ndarray, owner: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of k words that lies in one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    value = np.zeros(n, np.uint64)
    multiplier = np.uint64(0xA0761D6478BD642F) + np.uint64(2 * seed)
    for j in range(k):
        value = value * multiplier + hashes[j : n + j]
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return at, mixed(value[at], seed)


def lines_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, owner) of every line; texts are cut at \\n and an empty text has one empty line."""
    breaks = np.flatnonzero(texts.data == 10)
    start = np.sort(np.concatenate([texts.offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([texts.offsets[1:], breaks]), kind="stable")
    owners = np.searchsorted(texts.offsets, breaks, "right") - 1
    owner = np.sort(np.concatenate([np.arange(len(texts)), owners]), kind="stable")
    return start, end, owner


def code_points_before(texts: Texts) -> np.ndarray:
    """Running count of code points before every byte, one longer than the data."""
    return np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def unsigned(values) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.int64).view(np.uint64)
