"""Compression bands: documents whose zstandard ratio is out of the limits of their length are rejected.

A ratio is compressed bytes over raw bytes. The whole document is judged by the limits of its length, and every
chunk, the shorter last one too, by the limits of the chunk's length; a repetitive part of a long document shows in its chunks even when
the whole looks normal. Counting rules (words, symbols, repeated lines and windows) are measured beside them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtab.llm.common import documents, query, record, texts
from loomtab.llm.wordblocks import code_points_before, lines_of, mixed, run_hashes, slices, windows, word_hashes, words_of


@dataclass(frozen=True)
class Bands:
    """Limits by length: a text of at most ``length`` bytes must have low <= ratio <= high.

    Short texts compress little, so their bands are open; the last band holds for all longer ones. ``chunk`` is the
    chunk length in bytes; the last chunk of a text is what is left, judged by the band of its own length. A document
    longer than one chunk fails when more than ``bad_chunks`` of its bytes are in chunks out of their band.
    """

    lengths: tuple[float, ...] = (127, 255, 511, 1023, 2047, 4095, 8191, 16383, float("inf"))
    low: tuple[float, ...] = (0.0, 0.32, 0.40, 0.38, 0.34, 0.30, 0.27, 0.25, 0.22)
    high: tuple[float, ...] = (9.0, 1.20, 1.00, 0.95, 0.92, 0.90, 0.90, 0.90, 0.90)
    chunk: int = 4096
    bad_chunks: float = 0.25
    level: int = 3


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n).astype(np.int64)


def base_counts(text) -> dict[str, np.ndarray]:
    """The counting rules of every text of a slice."""
    n = len(text)
    words = words_of(text)
    points = code_points_before(text)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[text.data])])
    hashes = word_hashes(text, words, lower=False)
    at, window = windows(hashes, words.owner, 5)
    key = mixed(window) ^ mixed(words.owner[at].astype(np.uint64), 7)
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[times[back] > 1]
    covered = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + 5, -1)
    repeat = np.cumsum(covered[:-1]) > 0
    start, end, owner = lines_of(text)
    with_word = np.searchsorted(words.start, end, "left") > np.searchsorted(words.start, start, "left")
    start, end, owner = start[with_word], end[with_word], owner[with_word]
    line = run_hashes(text, start, end, lower=False, seed=3) ^ mixed(owner.astype(np.uint64), 11)
    first = np.zeros(len(line), bool)
    first[np.unique(line, return_index=True)[1]] = True
    return {
        "n_words": words.count,
        "word_chars": _sums(words.owner, points[words.end] - points[words.start], n),
        "n_symbols": symbols[text.offsets[1:]] - symbols[text.offsets[:-1]],
        "n_dup_lines": _sums(owner, ~first, n),
        "n_repeat_words": _sums(words.owner, repeat, n),
    }


def compression(text, bands: Bands) -> dict[str, np.ndarray]:
    """Ratio and chunk verdicts of every text of a slice; an empty text has ratio 0 and is in band."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=bands.level).compress
    lengths, low, high = np.array(bands.lengths), np.array(bands.low), np.array(bands.high)

    def in_band(size: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        band = np.searchsorted(lengths, size, "left")
        return (size == 0) | (ratio >= low[band]) & (ratio <= high[band])

    n = len(text)
    size = np.diff(text.offsets)
    ratio, chunks, bad, bad_bytes = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        raw = text.text(i)
        if not raw:
            continue
        ratio[i] = len(squeeze(raw)) / len(raw)
        if len(raw) < bands.chunk:
            continue
        parts = [raw[at : at + bands.chunk] for at in range(0, len(raw), bands.chunk)]
        long = np.array([len(p) for p in parts])
        wrong = ~in_band(long, np.array([len(squeeze(p)) for p in parts]) / long)
        chunks[i], bad[i], bad_bytes[i] = len(parts), wrong.sum(), long[wrong].sum()
    good = in_band(size, ratio) & (bad_bytes <= bands.bad_chunks * size)
    return {"ratio": np.round(ratio, 6), "n_chunks": chunks, "n_bad_chunks": bad, "in_band": good}


def quality_rules(docs: DataFrame, bands: Bands = Bands(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, ratios and the verdict ``kept``.

    A null text counts as empty; an empty or one-word text fails the base rule. Repeated rows are judged alike, a null
    key is passed on, an empty table gives an empty table, and other columns are not looked at. The whole text counts,
    however long; nothing moves between tasks.
    """

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for rows, part in slices(batch):
                counts, packed = base_counts(part), compression(part, bands)
                failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
                kept = ~failed & packed.pop("in_band")
                schema = schema or pa.schema(
                    [("doc_id", pa.int64()), *((k, pa.int64()) for k in counts), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
                    + [("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64())]
                )
                yield record(schema, doc_id=rows.column("doc_id"), base_failed=failed, kept=kept, **counts, **packed)

    return texts(docs, key, text).mapInArrow(judge, SCHEMA)


@query()
def op10_quality_rules(spark, folder):
    """Compression bands over all documents."""
    return quality_rules(documents(spark, folder))
