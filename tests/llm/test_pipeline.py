"""Every stage against plain Python on its own input; nulls, repeats, empty tables and further columns."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from loomtab.llm.common import documents, stored
from loomtab.llm.curriculum import scheduled
from loomtab.llm.line_crf import line_quality
from loomtab.llm.string_tiling import tiles
from loomtab.session import load
from tests.conftest import SMALL

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def steps(spark):
    """The rows each stage got and gave, on the small table."""
    docs, out = documents(spark, SMALL), []
    for name, stage in corpus_pipeline.STAGES:
        done = stored(stage(spark, docs, SMALL), name)
        out.append((name, docs, done))
        docs = done
    return out


def texts_of(frame):
    return {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}


def test_quality_keeps_what_scores_enough(spark, steps):
    _, before, after = steps[0]
    want = {r["doc_id"] for r in line_quality(before, load(spark, SMALL, "labels")).collect() if r["score"] >= 0.3}
    assert set(texts_of(after)) == want and after.columns == before.columns


def test_line_dedup_drops_shared_lines(steps):
    _, before, after = steps[1]
    rows, holders = texts_of(before), defaultdict(set)
    for doc_id, text in rows.items():
        for line in (text or "").split("\n"):
            key = lower(line.strip(SPACE))
            if len(key) >= 20:
                holders[key].add(doc_id)
    want = {}
    for doc_id, text in rows.items():
        lines = (text or "").split("\n")
        left = [x for x in lines if len(holders.get(lower(x.strip(SPACE)), ())) < 3 or max(holders[lower(x.strip(SPACE))]) == doc_id]
        if len(left) == len(lines):
            want[doc_id] = text
        elif "\n".join(left).strip(SPACE):
            want[doc_id] = "\n".join(left)
    assert texts_of(after) == want
    assert after.filter("n_chars <> char_length(text)").count() == 0


def test_one_of_each_group_stays(steps):
    _, before, after = steps[2]
    sets = {}
    for doc_id, text in texts_of(before).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(texts_of(after)) == {i for i in ids if find(i) == i}


def test_documents_with_benchmark_items_go(spark, steps):
    _, before, after = steps[3]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    coded = lambda ws: np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little") for w in ws], np.uint64)
    items = [coded(words(r["text"])) for r in load(spark, SMALL, "benchmark").collect()]
    want = set()
    for doc_id, text in texts_of(before).items():
        said = coded(words(text))
        if not any(len(i) and sum(t[2] for t in tiles(i, said, 4)) >= 0.6 * len(i) for i in items):
            want.add(doc_id)
    assert set(texts_of(after)) == want


def test_the_order_holds_every_copy_with_its_text(steps):
    _, before, after = steps[4]
    rows = after.collect()
    taken = {r["doc_id"]: r["copies"] for r in scheduled(before).collect()}
    assert Counter(r["doc_id"] for r in rows) == {i: n for i, n in taken.items() if n}
    said = texts_of(before)
    assert all(r["text"] == said[r["doc_id"]] and 0 <= r["position"] <= 1 for r in rows)


def test_odd_rows_pass_all_stages(spark):
    base = " ".join(f"word{i}" for i in range(40))
    near = base.replace("word7 ", "other ")
    rows = [
        (1, base, None, None, None, "x"), (2, near, "en", "a", 5, "x"), (3, None, None, None, None, None), (4, "", "en", "b", 0, "x"),
        (5, " ".join(f"u{i}" for i in range(30)), "en", None, 1, "x"), (5, " ".join(f"u{i}" for i in range(30)), "en", None, 1, "x"),
        (None, "no id at all " * 3, None, "a", None, "x"), (None, "no id at all " * 3, None, "a", None, "x"), (None, None, None, None, None, None),
        (6, "spam " * 4000, "en", "b", 20000, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        done = stage(spark, docs, SMALL)
        assert done.columns == docs.columns
        if name == "near_duplicates":
            kept = Counter((r["doc_id"], r["text"]) for r in done.collect())
            assert set(kept.values()) == {1} and {1, 3, 4, 5, 6, None} == {k[0] for k in kept} and len(kept) == 7
    order = corpus_pipeline.mixing(spark, docs, SMALL).collect()
    assert all(r["text"] is not None or r["size"] == 0 for r in order) and any(r["doc_id"] is None and r["text"] for r in order)
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, nothing, SMALL).count() == 0
