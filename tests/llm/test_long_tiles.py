"""Tiles against a walk over all lengths, and items of many thousand words."""

from __future__ import annotations

import time

import numpy as np
import pytest

from loomtab.llm.string_tiling import string_tiling, tiles


def walked(item, doc, min_match):
    """Greedy string tiling by its definition: every length from the longest, first in the document, then in the item."""
    free_item, free_doc, out = [True] * len(item), [True] * len(doc), []
    for length in range(min(len(item), len(doc)), max(1, min(min_match, len(item))) - 1, -1):
        for d in range(len(doc) - length + 1):
            for i in range(len(item) - length + 1):
                if all(free_doc[d : d + length]) and all(free_item[i : i + length]) and list(item[i : i + length]) == list(doc[d : d + length]):
                    free_item[i : i + length] = free_doc[d : d + length] = [False] * length
                    out.append((i, d, length))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_tiles_equal_the_definition(seed):
    draw = np.random.default_rng(seed)
    words = draw.integers(1, 1 << 60, 3 + seed % 7).astype(np.uint64)
    item, doc = words[draw.integers(0, len(words), 5 + seed)], words[draw.integers(0, len(words), 40)]
    assert tiles(item, doc, 3) == walked(item, doc, 3)


def test_long_sequences_end_soon():
    draw = np.random.default_rng(1)
    item = draw.integers(1, 1 << 60, 50_000).astype(np.uint64)
    doc = np.concatenate([item[25_000:], draw.integers(1, 1 << 60, 7).astype(np.uint64), item[:25_000]])
    started = time.perf_counter()
    assert sorted(tiles(item, doc, 4)) == [(0, 25_007, 25_000), (25_000, 0, 25_000)]
    same = np.full(20_000, 7, np.uint64)
    assert tiles(same[:9_000], same, 4) == [(0, 0, 9_000)]
    assert time.perf_counter() - started < 20


def test_an_item_of_many_words(spark):
    """Bodies are stored once, not once a seed."""
    item = " ".join(f"w{i % 9973}x{i}" for i in range(50_000))
    words = item.split()
    docs = spark.createDataFrame([(1, " ".join(words[20_000:] + words[:20_000])), (2, " ".join(words[:9_000])), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_items"], r["coverage"]) for r in string_tiling(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert got == {1: (1, 1.0), 2: (0, 0.0), 3: (0, 0.0)}
