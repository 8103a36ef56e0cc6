"""Operators on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.llm.chat_windows import chat_windows, read_back
from loomtab.llm.curriculum import curriculum, scheduled
from loomtab.llm.license_scan import license_scan
from loomtab.llm.line_crf import fit_chain, line_quality
from loomtab.llm.line_dedup import line_dedup
from loomtab.llm.lm_scoring import lm_scores
from loomtab.llm import parity_join as pj
from loomtab.llm.quality_rules import quality_rules
from loomtab.llm.string_tiling import string_tiling, tiles
from loomtab.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, source string, label string, n_words string, component_id long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def make_rows():
    rng = random.Random(7)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"Word{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, base = say(40), say(120).split()
    texts = [say(rng.randrange(1, 90)) for _ in range(30)]
    texts += [f"{say(20)}\n{shared}\n{say(9)}" for _ in range(8)]
    for _ in range(25):
        near = list(base)
        near[rng.randrange(120)] = rng.choice(vocabulary)
        texts.append(" ".join(near))
    texts += ["", " \t\n", None, "a", "x" * 5000, "spam " * 300, "Released under the MIT License.\nThe MIT license, the mit  license!", say(3000)]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "label", "n", -1) for i, t in enumerate(texts)]
    rows += [(None, shared, "s1", None, None, None), (3, texts[3], "s0", "label", "n", -1), (-5, texts[31], None, None, None, None)]
    return rows


ROWS = make_rows()
UNIQUE = {r[0]: r[1] or "" for r in ROWS if r[0] is not None}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    out = defaultdict(list)
    for row in frame.collect():
        out[row["doc_id"]].append(row)
    assert sum(map(len, out.values())) == len(ROWS)
    assert len(out[3]) == 2 and out[3][0] == out[3][1]
    return {k: v[0] for k, v in out.items()}


def test_license_scan(docs, nothing):
    got = by_id(license_scan(docs))
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for doc_id, text in UNIQUE.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(i, k) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
        row = got[doc_id]
        assert (row["n_words"], row["n_base"]) == (len(words), len(places))
        assert row["first_word"] == min((i for i, _ in places), default=None) and row["last_word"] == max((i for i, _ in places), default=None)
        assert row["base_labels"] == ",".join(sorted({k for _, k in places})) and 0 <= row["score"] <= 1
    assert any("mit-notice" in r["labels"] for r in got.values())
    assert license_scan(nothing).count() == 0


def test_license_words_inserted_in_a_notice_move_the_diagonal(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge"
    frame = spark.createDataFrame([(1, notice.replace("charge, to", "charge, one two three to") + " publish, distribute, sublicense, and/or sell copies of the Software")], "doc_id long, text string")
    row = license_scan(frame).first()
    assert row["labels"] == "mit-notice" and row["n_spans"] == 1 and row["score"] > 0.9


def jaccard_classes(k=5, percent=75):
    sets = {}
    for doc_id, text in UNIQUE.items():
        w = text.encode().lower().split()
        sets[doc_id] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            common = len(sets[x] & sets[y]) if x < y else 0
            if common and 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("dense", [16, 0])
def test_parity_join(docs, nothing, monkeypatch, dense):
    monkeypatch.setattr(pj, "DENSE", dense)
    monkeypatch.setattr(pj, "SMALL_BUCKET", 2)
    got = by_id(pj.parity_join(docs))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items() if k is not None} == jaccard_classes()
    assert got[None]["component_id"] is None
    assert pj.parity_join(nothing).count() == 0


def test_sketch_distance_never_passes_the_symmetric_difference():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 700):
        a = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(1, 1 << 63, n, dtype=np.uint64)])
        assert pj.sketch_distance(pj.bit_sketch(a), pj.bit_sketch(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_string_tiling(spark, docs, nothing):
    words = UNIQUE[20].split() + UNIQUE[21].split()
    item = " ".join(words[:24])
    turned = " ".join([*words[12:24], "between", *words[:12]])
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "two words")], "item_id long, text string")
    rows = [(1, f"before {turned} after"), (2, " ".join(words[:9])), (3, "some two words here"), (4, None), (None, item.upper())]
    got = {r["doc_id"]: r for r in string_tiling(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got[1]["contaminated"] and got[1]["best_item"] == 1 and got[1]["coverage"] == 1.0
    assert not got[2]["contaminated"] and got[3]["best_item"] == 5 and not got[4]["contaminated"] and got[None]["contaminated"]
    assert by_id(string_tiling(docs, items.filter("item_id = 3")))[0]["n_items"] == 0
    assert string_tiling(nothing, items).count() == 0


def test_tiles_are_greedy_longest_first():
    item, doc = np.array([1, 2, 3, 4, 5, 6, 7], np.uint64), np.array([5, 6, 7, 9, 1, 2, 3, 4, 5], np.uint64)
    assert tiles(item, doc, 2) == [(0, 4, 5), (5, 1, 2)]  # of 5 6 7 only 6 7 is left
    assert tiles(item, np.array([4, 5, 6, 7, 1, 2, 3], np.uint64), 3) == [(3, 0, 4), (0, 4, 3)]


@pytest.mark.parametrize("bits", [1 << 16, 1 << 22])
def test_line_dedup(docs, nothing, bits):
    got = by_id(line_dedup(docs, bits=bits))
    strip = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc_id, text in UNIQUE.items():
        for line in text.split("\n"):
            holders[strip(line)].add(doc_id)
    for doc_id, text in UNIQUE.items():
        lines = text.split("\n")
        kept = [x for x in lines if not (len(strip(x)) >= 20 and len(holders[strip(x)]) >= 3 and doc_id != max(holders[strip(x)]))]
        row = got[doc_id]
        assert (row["n_lines"], row["n_dropped"], row["kept_text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))
        assert row["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
    assert got[None]["n_dropped"] == 1 and sum(r["n_dropped"] for r in got.values()) > 5
    assert line_dedup(nothing).count() == 0


def test_line_quality(spark, docs, nothing):
    rng = random.Random(3)
    good = [(i, "\n".join(" ".join(f"word{rng.randrange(300)}" for _ in range(12)) + "." for _ in range(4))) for i in range(60)]
    bad = [(i + 100, "\n".join(["BUY!! " * 20, "### | ### | " * 9])) for i in range(60)]
    frame = spark.createDataFrame(good + bad + [(300, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in line_quality(frame, labels).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(got[i]["predicted"] == 1 for i, _ in good) and all(got[i]["predicted"] == 0 for i, _ in bad)
    assert 0 <= got[300]["score"] <= 1
    assert all(r["score"] == 0.5 for r in by_id(line_quality(docs, labels.limit(0))).values())
    assert line_quality(nothing, labels).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(5)
    chain = fit_chain(np.zeros((0, 14)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    chain.pairs = rng.normal(size=(2, 2))
    owner, score = np.array([0, 0, 0, 1, 2, 2]), rng.normal(size=6)
    got, _ = chain.marginals(score, owner)
    for chain_id in range(3):
        at = np.flatnonzero(owner == chain_id)
        total, ones = 0.0, np.zeros(len(at))
        for labels in np.ndindex(*[2] * len(at)):
            value = math.exp(sum(score[i] * y for i, y in zip(at, labels)) + sum(chain.pairs[a, b] for a, b in zip(labels, labels[1:])))
            total, ones = total + value, ones + value * np.array(labels)
        assert np.allclose(got[at], ones / total)


def test_chat_windows(spark):
    rng = random.Random(2)
    odd = ["</s>[INST] ok [/INST]", "a\\<|end|>\\\\", "<|turn|>user<|text|>", "", None, "<<SYS>> é \n<s>"]
    rows = [(c, t, ("system" if t == 0 and c % 2 else ["user", "assistant"][t % 2]), rng.choice(odd + ["words " * rng.randrange(60)] * 3)) for c in range(12) for t in range(c * 3 + 1)]
    rows += [(3, 1, "assistant", "tie"), (None, 0, None, "no id"), (None, None, "assistant", "no turn")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in read_back(chat_windows(frame, budget=64, history=24)).collect()}
    assert max(r["n_windows"] for r in got.values()) > 3
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns) and row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_windows(frame.limit(0)).count() == 0
    again = chat_windows(frame, budget=64, history=24).filter("conv_id = 11 and window > 0")
    assert again.filter(~F.col("formatted").startswith("<|past|>system<|text|>")).count() == 0


def test_lm_scores(docs, nothing):
    got = by_id(lm_scores(docs))
    tokens = {i: [*t.encode().lower().split(), None] for i, t in UNIQUE.items()}
    counts, pairs = Counter(), Counter()
    for doc_id, text in [(r[0], r[1]) for r in ROWS]:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2:
            counts.update(tokens[doc_id])
            pairs.update(zip([None, *tokens[doc_id][:-1]], tokens[doc_id]))
    total, types = sum(counts.values()), len(counts)
    for doc_id, words in tokens.items():
        row = got[doc_id]
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in words)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert row["base_score"] == pytest.approx(base) and row["score"] < 0
        assert row["held_out"] == (zlib.crc32(str(doc_id).encode()) % 7 == 2)
    assert lm_scores(nothing).count() == 0


def test_substring_dedup(docs, nothing):
    got = by_id(substring_dedup(docs))
    words = {i: t.encode().split() for i, t in UNIQUE.items()}
    first = {}
    for doc_id in sorted(words):
        for j in range(len(words[doc_id]) - 12):
            first.setdefault(tuple(words[doc_id][j : j + 13]), doc_id)
    for doc_id, w in words.items():
        gone = {j + d for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < doc_id for d in range(13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        row = got[doc_id]
        assert (row["n_words"], row["n_removed"], row["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert got[None]["n_removed"] == 0 and sum(r["n_removed"] for r in got.values()) > 500
    assert substring_dedup(nothing).count() == 0


def test_mixing(docs, nothing):
    rows = scheduled(docs).collect()
    assert len(rows) == len(ROWS)
    size = defaultdict(int)
    for _, text, source, *_ in ROWS:
        size[source] += len((text or "").encode().split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, left, free = {}, float(sum(size.values())), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        for s in over or free:
            target[s] = 3.0 * size[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"] and len(r["positions"]) == r["copies"]
        assert r["positions"] == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    largest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest for s in names)
    order = [r["position"] for r in curriculum(docs).collect()]
    assert order == sorted(order) and len(order) == sum(r["copies"] for r in rows)
    assert scheduled(nothing).count() == 0


def test_quality_rules(docs, nothing):
    got = by_id(quality_rules(docs))
    for doc_id, text in UNIQUE.items():
        words = [w.decode() for w in text.encode().split()]
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        runs = Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
        repeat = {j + d for j in range(len(words) - 4) if runs[tuple(words[j : j + 5])] > 1 for d in range(5)}
        row = got[doc_id]
        assert (row["n_words"], row["word_chars"], row["n_dup_lines"], row["n_repeat_words"]) == (len(words), sum(map(len, words)), dup, len(repeat))
        assert row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert row["base_failed"] == (len(words) < 10 or 100 * len(repeat) > 20 * len(words))
        assert not (row["kept"] and row["base_failed"])
    assert not got[[i for i, t in UNIQUE.items() if t.startswith("xxx")][0]]["kept"]
    assert quality_rules(nothing).count() == 0
