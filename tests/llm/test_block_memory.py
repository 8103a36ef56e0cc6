from __future__ import annotations

import tracemalloc

import numpy as np
import zstandard

from loomtab.llm import lm_scoring as lm
from loomtab.llm.common import planes


def test_a_block_takes_few_bytes_a_token():
    """Peak while a block is built, over many distinct words and pairs."""
    tokens, rng = 2_000_000, np.random.default_rng(1)
    words = np.append(np.sort(rng.integers(1 << 20, 1 << 62, 50_000).astype(np.uint64)), lm.END)
    words.sort()
    number = np.minimum(rng.zipf(1.3, tokens), len(words)).astype(np.uint32) - 1
    lengths = np.full(400, tokens // 400, np.int64)
    blob = zstandard.ZstdCompressor().compress(planes(number.astype(np.uint32)))
    row = {"docs": np.arange(400).tobytes(), "parts": np.zeros(400, np.int64).tobytes(), "lengths": lengths.tobytes(), "words": words.tobytes(), "tokens": blob}
    tracemalloc.start()
    block = lm.Block(row)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    end = np.searchsorted(words, lm.END)
    before = np.append(end, number[:-1]).astype(np.int64)
    before[np.cumsum(lengths) - lengths] = end
    pairs, pair = np.unique(before * len(words) + number, return_inverse=True)
    assert np.array_equal(block.pairs, pairs) and np.array_equal(block.pair, pair)
    assert peak / tokens < 56, peak / tokens
