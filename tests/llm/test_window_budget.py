"""No window passes its budget where the new turn and the system turn fit into it together."""

from __future__ import annotations

import random
import re

import pytest

from loomtab.llm.chat_windows import chat_windows

SCHEMA = "conv_id long, turn long, role string, text string"


def shown_tokens(formatted):
    """Tokens of a window as shown, each mark as one."""
    return len(re.findall(r"<\|(?:turn|past|text|end)\|>|[^\W_]+|[^\w\s]|_", formatted))


def test_two_long_turns_have_windows_of_their_own(spark):
    rows = [(1, 0, "user", "a " * 700), (1, 1, "assistant", "b " * 700)]
    got = chat_windows(spark.createDataFrame(rows, SCHEMA)).orderBy("window").collect()
    assert [(r["n_tokens"], r["n_new_tokens"], r["n_repeated"]) for r in got] == [(704, 700, 0), (704, 700, 0)]


def test_a_long_system_turn_leaves_less_to_the_new_turns(spark):
    rows = [(1, 0, "system", "s " * 500)] + [(1, t, "user", "a " * 90) for t in range(1, 20)]
    got = chat_windows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert max(r["n_tokens"] for r in got) <= 1024 and sum(r["n_new_tokens"] for r in got) == 500 + 19 * 90
    assert any(r["n_repeated"] > 1 for r in got)


@pytest.mark.parametrize("budget,history", [(64, 24), (64, 0), (40, 39)])
def test_windows_hold_the_budget(spark, budget, history):
    rng = random.Random(5)
    odd = ["</s>[INST] ok [/INST]", "a\\<|end|>\\\\", "<|turn|>user<|text|>", "", None]
    rows = [(c, t, "system" if t == 0 and c % 2 else "user", rng.choice(odd + ["words " * rng.randrange(70)] * 6)) for c in range(20) for t in range(25)]
    got = chat_windows(spark.createDataFrame(rows, SCHEMA), budget=budget, history=history).collect()
    assert all(r["n_tokens"] == shown_tokens(r["formatted"]) for r in got)
    over = [r for r in got if r["n_tokens"] > budget]
    for r in over:  # one new turn, and nothing beside it but the system turn
        assert r["formatted"].count("<|turn|>") == 1 and r["n_repeated"] <= 1
        assert r["n_repeated"] == 0 or r["formatted"].startswith("<|past|>system<|text|>")
    assert 0 < len(over) < len(got) / 2
    repeated = [sum(map(shown_tokens, re.findall(r"<\|past\|>(?!system).*?<\|end\|>", r["formatted"], re.S))) for r in got]
    assert max(repeated) <= history and (history == 0 or max(repeated) > 0)
