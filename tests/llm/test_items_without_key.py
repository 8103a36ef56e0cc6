"""Benchmark items without a key, or under one key, are items of their own."""

from __future__ import annotations

from loomtab.llm.string_tiling import string_tiling, with_tiles


def test_items_without_a_key_are_found(spark):
    one, two, three = (" ".join(f"{name}{i}" for i in range(12)) for name in ("red", "blue", "green"))
    items = spark.createDataFrame([(None, one), (None, two), (None, "red0 red1 red2"), (7, three)], "item_id long, text string")
    rows = [(1, f"before {one} after"), (2, f"{two} {three}"), (3, f"{one} {two}"), (4, "nothing near"), (None, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_items"], r["best_item"], r["coverage"], r["contaminated"]) for r in string_tiling(docs, items).collect()}
    assert got == {1: (2, None, 1.0, True), 2: (2, 7, 1.0, True), 3: (3, None, 1.0, True), 4: (0, None, 0.0, False), None: (1, None, 1.0, True)}
    assert [r["doc_id"] for r in with_tiles(docs, items).filter("__items = 0").collect()] == [4]


def test_items_of_one_key_and_other_words_count_once_each(spark):
    one, two = " ".join(f"red{i}" for i in range(12)), " ".join(f"blue{i}" for i in range(9))
    items = spark.createDataFrame([(1, one), (1, two), (1, two.upper())], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{one} {two}"), (2, two)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_items"] for r in string_tiling(docs, items).collect()} == {1: 2, 2: 1}
