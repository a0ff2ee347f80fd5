import hashlib
import itertools
import random
import re
import zlib

import pytest
from helpers import SF, parquet_rows, rows_of

from censusloom.llm import conversation_repair as R

TURNS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired) over whole strings: every state keeps its least (cost, audit)."""
    best = {"": (0, "", ())}

    def relax(table, state, new):
        if state not in table or new[:2] < table[state][:2]:
            table[state] = new

    def inserts(table):
        for _ in range(4):
            for state, (cost, audit, out) in list(table.items()):
                for role, before in (("user", ("", "s", "a")), ("assistant", ("u",))):
                    if state in before:
                        relax(table, role[0], (cost + 5, audit + "I", (*out, f"{role}:")))

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        inserts(best)
        after = {}
        for state, (cost, audit, out) in best.items():
            relax(after, state, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            for new, letter, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                if (state, new[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                    relax(after, new[0], (cost + price + more, audit + letter, (*out, f"{new}:{text}")))
        best = after
    inserts(best)
    return min(v for s, v in best.items() if s in ("", "a"))


def by_hand(rows):
    out = []
    damaged = damage_by_hand(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults, seen, illegal = [], set(), 0
        for i, (_, _, role, text) in enumerate(mine):
            full = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not full else "duplicate" if (role, text) in seen else "" if full[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            illegal += i > 0 and mine[i - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, repaired = cheapest(mine, faults)
        counts = tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, schema=TURNS):
    return rows_of(R.repair(R.damaged(spark.createDataFrame(rows, schema).repartition(3))), *COLUMNS)


def test_given_conversations_against_the_definition(spark):
    rows = parquet_rows("conversations", "conv_id, turn, role, text")
    assert rows_of(R.repair(R.damaged(spark.read.parquet(f"{SF}/conversations.parquet"))), *COLUMNS) == by_hand(rows)


def random_rows(seed, conversations=60, most=14):
    draw = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(draw.randint(0, most)):
            role = draw.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"])
            text = draw.choice(["Yes.", "No!", "cut", " \t", "", None, "A b? \n", "é", "x."]) 
            rows.append((draw.choice([conv, conv, None]) if conv % 9 == 0 else conv, draw.choice([turn, turn, turn * 3, None]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_conversations_against_the_definition(spark, seed, monkeypatch):
    rows = random_rows(seed)
    assert found(spark, rows) == by_hand(rows)


def run(roles, faults):
    program = R.Repair()
    for role, fault in zip(roles, faults, strict=True):
        program.row(role, "t", fault)
    return program.close()


def test_every_short_conversation():
    for n in range(4):
        for roles in itertools.product(["system", "user", "assistant", "tool"], repeat=n):
            for faults in itertools.product(["", "blank", "truncated"], repeat=n):
                cost, audit, repaired = cheapest([(0, 0, r, "t") for r in roles], faults)
                sha = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
                assert run(roles, faults) == (cost, audit, sha)


@pytest.mark.parametrize("every", [1, 7, 10**9])
def test_long_conversations_settle(monkeypatch, every):
    monkeypatch.setattr(R, "_SETTLE_EVERY", every)
    draw = random.Random(5)
    for _ in range(30):
        roles = draw.choices(["system", "user", "assistant", "tool"], k=120)
        faults = draw.choices(["", "", "blank", "truncated"], k=120)
        cost, audit, _ = cheapest([(0, 0, r, "t") for r in roles], faults)
        assert run(roles, faults)[:2] == (cost, audit)


def test_memory_does_not_follow_the_conversation():
    program, draw = R.Repair(), random.Random(8)
    for _ in range(20_000):
        program.row(draw.choice(["user", "assistant", "tool"]), "t", draw.choice(["", "", "truncated"]))
    assert len(program.waiting) < 2_000


def test_collisions_are_verified(monkeypatch):
    monkeypatch.setattr(R, "_PRIME", 2)  # nearly all hashes collide
    draw = random.Random(6)
    for _ in range(200):
        roles = draw.choices(["system", "user", "assistant", "tool"], k=12)
        faults = draw.choices(["", "", "blank", "truncated"], k=12)
        assert run(roles, faults)[:2] == cheapest([(0, 0, r, "t") for r in roles], faults)[:2]


def test_clashing_columns_and_empty_table(spark):
    rows = random_rows(3, 20)
    wide = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS again", "'x' AS present", "'x' AS copy", "1 AS cost")
    assert rows_of(R.repair(R.damaged(wide)), *COLUMNS) == by_hand(rows)
    assert found(spark, []) == []


def test_very_long_text(spark):
    rows = [(1, 0, "user", "a. " * 300_000), (1, 1, "assistant", "b" * 500_000)]
    assert found(spark, rows) == by_hand(rows)
