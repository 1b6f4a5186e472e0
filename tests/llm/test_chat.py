"""Repair against a search over all paths, also where a conversation spreads over partitions."""

import random
import re
from functools import lru_cache

from plumbline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, action string, part string"


def cheapest(roles):
    """Plain search, written from the rules."""
    legal = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}

    @lru_cache(None)
    def best(state, k, inserted=0):
        ways = [10**9]
        if k == len(roles) and state == 3:
            ways.append(0)
        if inserted < 3:
            ways += [chat.INSERT + best(b, k, inserted + 1) for b in legal[state]]
        if k < len(roles):
            if state and not inserted:
                ways.append(chat.MERGE + chat.RELABEL * (roles[k] != state) + best(state, k + 1))
            ways += [chat.RELABEL * (roles[k] != b) + best(b, k + 1) for b in legal[state]]
        return min(ways)

    return best(0, 0)


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["turn"] is not None, r["turn"] or 0, r["source_role"] is not None, r["source_role"] or "")):
        out.setdefault(r["conv_id"], []).append(r)
    return out


def test_cost_is_least_and_result_legal(spark):
    rng = random.Random(2)
    rows = []
    for c in range(120):
        n = 400 if c == 7 else rng.randint(1, 7)
        for t in range(n):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "Human", "gpt", None, "tool"]), f"c{c} t{t} <|end|>", "a", "p"))
    rng.shuffle(rows)
    out = chat.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(out) == len(rows)
    for c, turns in grouped(out).items():
        roles = tuple(chat.role_number(r["source_role"]) for r in turns)
        if len(roles) < 300:
            assert sum(r["cost"] for r in turns) == cheapest(roles), (c, roles)
        text = "".join(r["fragment"] for r in turns)
        said = re.findall(r"<\|(system|user|assistant)\|>\n", text)
        assert re.fullmatch(r"(system,)?(user,assistant,)+", "".join(x + "," for x in said)), said
        assert text.count("<|end|>\n") == len(said)
        at = [text.find(f"c{c} t{t} <\\|end|>") for t in range(len(turns))]
        assert at == sorted(at) and at[0] >= 0
    # The conversation that spans partitions has least cost as well.
    roles = [chat.role_number(r["source_role"]) for r in grouped(out)[7]]
    assert sum(r["cost"] for r in grouped(out)[7]) == (chat.matrix(roles)[0] + chat.END).min()


def test_legal_conversations_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (2, 1, "assistant", None)]
    out = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["action"] for r in out} == {"keep"} and sum(r["cost"] for r in out) == 0


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (None, 1, None, None), (3, None, "user", "a"), (3, None, "user", "a"), (3, 1, "user", "a"), (3, 1, "assistant", "b")]
    out = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert out.count() == 6
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_stretches_multiply():
    rng = random.Random(4)
    for _ in range(50):
        roles = [rng.randrange(4) for _ in range(9)]
        assert (chat.product(chat.matrix(roles[:4]), chat.matrix(roles[4:])) == chat.matrix(roles)).all()
