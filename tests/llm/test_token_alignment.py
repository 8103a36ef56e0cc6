"""Alignment of two tokenizers against a walk over both token lists; fragments compose in any bracketing."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from loomtab.llm import token_alignment as ta
from tests.llm.test_operators import ROWS, SCHEMA

MORE = [
    (900, "It's <|endoftext|> here </s> and <s> there, naïve façade — 漢字かな交じり文 1,234.5  two  spaces \n\tlines\r\n"),
    (901, "漢字" * 900), (902, "x" * 700 + " y" * 50), (903, "a ▁ piece mark ▁"), (904, " leading and trailing "), (905, "🙂🙃 é   nbsp"),
]


@pytest.fixture(scope="module")
def kit():
    return ta.tokenizer(ta.BYTE_BPE, ta.PIECE_BPE)


def walked(kit, text):
    """(n_a, n_b, groups, links) of one text by the definition."""
    spelled = (" " + text).encode()
    a, b = kit.a.encode(" " + text, add_special_tokens=False).ids, kit.b.encode(text)
    spell_a, spell_b = [kit.bytes_a[t] for t in a], [kit.bytes_b[t] for t in b]
    if not text or b"".join(spell_a) != spelled or b"".join(spell_b) != spelled:
        return 0, 0, [], []
    ends_a, ends_b = np.cumsum([len(x) for x in spell_a]), np.cumsum([len(x) for x in spell_b])
    groups, links, i, j, si, sj = [], [], 0, 0, 0, 0
    while i < len(a):
        links.append((a[i], b[j]))
        x, y = ends_a[i], ends_b[j]
        i, j = i + (x <= y), j + (y <= x)
        if x == y:
            groups.append(",".join(map(str, a[si:i])) + "|" + ",".join(map(str, b[sj:j])))
            si, sj = i, j
    return len(a), len(b), groups, links


def expected(kit, texts):
    per = [walked(kit, t or "") for t in texts]
    count = Counter(x for p in per for x in p[3])
    top: dict[int, int] = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return [
        (
            n_a, n_b, len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for n_a, n_b, groups, links in per
    ]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize(("chunk", "size", "frequent"), [(1 << 16, 1 << 12, 1 << 18), (60, 16, 50), (200, 7, 1)])
def test_alignment_equals_a_walk(spark, kit, monkeypatch, chunk, size, frequent):
    monkeypatch.setattr(ta, "FREQUENT", frequent)
    monkeypatch.setattr(ta, "UNITS", 500)
    rows = ROWS + [(i, t, None, "l", "n", 0) for i, t in MORE]
    want = sorted((r[0] if r[0] is not None else -99, *e) for r, e in zip(rows, expected(kit, [r[1] for r in rows])))
    got = ta.token_alignment(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=chunk, size=size).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -99, *(r[c] for c in COLUMNS)) for r in got) == want
    assert any(w[1] == 0 and w[0] == 903 for w in want)


def test_fragments_compose_in_any_bracketing(kit):
    text = MORE[0][1] + "x" * 90 + MORE[1][1][:40]
    ranges = ta.align(kit, [text], 5)[0]
    assert len(ranges) > 20 and any(not f.cut for f in ranges) and any(len(f.suffix) for f in ranges)
    stride = len(kit.bytes_b)
    want = ta.finish(ta.compose(ranges, stride), stride)
    n_a, n_b, groups, links = walked(kit, text)
    assert (want.n_a, want.n_b, want.written.decode()) == (n_a, n_b, ";".join(groups))
    assert dict(zip(want.code.tolist(), want.times.tolist())) == Counter(a * stride + b for a, b in links)
    draw = np.random.default_rng(0)
    for _ in range(20):
        parts = list(ranges)
        while len(parts) > 1:
            i = int(draw.integers(len(parts) - 1))
            parts[i : i + 2] = [ta.compose([parts[i], ta.Fragment(), parts[i + 1]], stride)]
        got = ta.finish(parts[0], stride)
        assert (got.written, got.n_groups, got.code.tolist(), got.times.tolist()) == (want.written, want.n_groups, want.code.tolist(), want.times.tolist())


def test_units_are_encoded_as_in_the_whole(kit):
    for _, text in MORE:
        a, b, _ = kit.encode(ta.SAFE.split(text))
        assert [t for x in a for t in x] == kit.a.encode(" " + text, add_special_tokens=False).ids
        assert [t for x in b for t in x] == kit.b.encode(text)
    assert kit.cuttable


def test_chunks_join_to_the_text():
    for _, text in MORE:
        for size in (1, 5, 50):
            assert " ".join(ta.chunks_of(text, size)) == text
    assert ta.chunks_of("", 5) == [""]


def test_empty_table(spark):
    assert ta.token_alignment(spark.createDataFrame([], SCHEMA)).count() == 0
