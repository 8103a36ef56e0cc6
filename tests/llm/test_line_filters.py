"""Filters sized by the lines counted, in several parts of hash space, and rows without an id told apart."""

from __future__ import annotations

from loomtab.llm import line_dedup as ld
from tests.llm.test_operators import ROWS, SCHEMA


def test_size_follows_the_lines():
    assert ld.filter_bits(0) == (ld.MIN_BITS, 1)
    assert ld.filter_bits(40_000_000) == (-(-320_000_000 // ld.SLICE_BITS) * ld.SLICE_BITS, 1)
    bits, parts = ld.filter_bits(10**9)
    assert parts == 15 and bits <= ld.MAX_BITS and bits * parts >= 8 * 10**9


def test_parts_give_the_same_lines(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    columns = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    want = sorted(map(repr, ld.line_dedup(docs).select(*columns).collect()))
    monkeypatch.setattr(ld, "MIN_BITS", 1 << 18)
    monkeypatch.setattr(ld, "MAX_BITS", 1 << 16)
    assert ld.filter_bits(100)[1] == 4
    assert sorted(map(repr, ld.line_dedup(docs).select(*columns).collect())) == want


def test_rows_without_an_id_lose_their_own_lines(spark):
    line, other = "a line that three documents hold", "another line of three documents"
    rows = [(i, line) for i in (1, 2, 3)] + [(i, other) for i in (4, 5, 6)] + [(None, f"{line}\nkeep"), (None, f"{other}\nstay"), (None, "neither of them at all, it is")]
    got = {r["kept_text"]: r["n_dropped"] for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] is None}
    assert got == {"keep": 1, "stay": 1, "neither of them at all, it is": 0}
