"""The last, shorter chunk of a text counts by its bytes."""

from __future__ import annotations

import random

from loomtab.llm.quality_rules import quality_rules


def test_a_repetitive_last_chunk_rejects_the_text(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10)))
    clean = " ".join(word() for _ in range(1200))
    rows = [(1, f"{clean[:4096]} {'a' * 2500}"), (2, clean[:6597]), (3, f"{clean[:4096]} {'a' * 900}"), (4, clean[:4096]), (5, clean[:4095])]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1]["base_failed"] and got[1]["ratio"] > 0.27 and not got[1]["kept"]
    assert {i: (r["n_chunks"], r["n_bad_chunks"]) for i, r in got.items()} == {1: (2, 1), 2: (2, 0), 3: (2, 1), 4: (1, 0), 5: (0, 0)}
    assert all(got[i]["kept"] for i in (2, 3, 4, 5))  # of 3 only 18 % of the bytes are bad
