"""Counts over 32 bits, and the interpolated score against a plain computation."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomtab.llm import lm_scoring as lm
from loomtab.llm.common import planes
from tests.llm.test_operators import ROWS, SCHEMA, lower


def test_totals_do_not_wrap(spark):
    """Two blocks see one word three thousand million times each."""
    schema = "cell int, block long, keys binary, train binary, gone binary"
    key, many = np.array([4, 9], np.uint64), np.array([3_000_000_000, 5], np.uint32)
    rows = [(0, b, key.tobytes(), planes(many), planes(many if b else np.zeros(2, np.uint32))) for b in (0, 1)]
    got = lm.answer(spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in rows], schema)).collect()
    for row in got:
        assert lm.widened(pa.array([bytes(row["total"])])).tolist() == [6_000_000_000, 10]
        assert lm.widened(pa.array([bytes(row["kept"])])).tolist() == [3_000_000_000, 5]
    assert sum(r["n"] for r in got) == 6_000_000_000 and sum(r["types"] for r in got) == 1


def test_no_row_for_a_cell_without_keys(spark):
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1}", 0) for i in range(6)], "doc_id long, text string, part int")
    asked = lm.ask(lm.read_blocks(docs.coalesce(1), 3), 2, 5000).collect()
    assert 0 < len(asked) <= 30 and all(len(r["keys"]) for r in asked)


def plain_scores(rows):
    """The model by its definition: counts, binned held-out counts, expectation-maximisation, mixture."""
    part = {i: zlib.crc32(str(r[0]).encode()) % 7 if r[0] is not None else -1 for i, r in enumerate(rows)}
    said = {i: [*lower(r[1] or "").encode().split(), None] for i, r in enumerate(rows)}
    learn = [i for i in said if part[i] not in (2, -1)]

    def counted(which):
        words, pairs = Counter(), Counter()
        for i in which:
            words.update(said[i])
            pairs.update(zip([None, *said[i]], said[i]))
        return words, pairs, sum(words.values())

    words, pairs, n = counted([i for i in learn if part[i] != 3])
    table = Counter()
    for i in learn:
        if part[i] == 3:
            for u, v in zip([None, *said[i]], said[i]):
                p2 = min(1 + int(-math.log2(pairs[u, v] / words[u]) * lm.P2_STEP), lm.P2_BINS - 1) if pairs[u, v] else 0
                p1 = min(1 + int(-math.log2(words[v] / n) * lm.P1_STEP), lm.P1_BINS - 1) if words[v] else 0
                table[(int(math.log2(words[u] + 1)) * lm.P2_BINS + p2) * lm.P1_BINS + p1] += 1
    spots = sorted(table)
    weight = lm.mixture_weights(np.array([spots, [table[s] for s in spots]]), sum(c > 0 for c in words.values()))
    words, pairs, n = counted(learn)
    out = []
    for i, tokens in said.items():
        total = 0.0
        for u, v in zip([None, *tokens], tokens):
            l0, l1, l2 = weight[int(math.log2(words[u] + 1))]
            total += math.log10(l0 / (len(words) + 1) + l1 * words[v] / n + (l2 * pairs[u, v] / words[u] if words[u] else 0.0))
        out.append((rows[i][0], total))
    return out


@pytest.mark.parametrize("tokens", [lm.TOKENS, 300])
def test_score_equals_the_definition(spark, monkeypatch, tokens):
    read = lm.read_blocks
    monkeypatch.setattr(lm, "read_blocks", lambda rows, deleted: read(rows, deleted, tokens))
    got = lm.lm_scores(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).select("doc_id", "score").collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert [r[0] for r in sorted(map(tuple, got), key=order)] == [r[0] for r in sorted(plain_scores(ROWS), key=order)]
    assert np.allclose([r[1] for r in sorted(map(tuple, got), key=order)], [r[1] for r in sorted(plain_scores(ROWS), key=order)])
