from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from countinghouse.llm import conversations, queries
from tests.llm.conftest import FOLDER

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def cheapest(turns, faults):
    """Cost and least audit by plain dynamic programming over (turns read, roles so far)."""
    states = ("", "s", "u", "a")  # the last role's initial
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        for _ in range(3):
            for state in states[1:]:
                for before in states:
                    if before in best and state in "ua" and state in follows[before]:
                        cost, audit = best[before]
                        found = (cost + 3, audit + "I")
                        best[state] = min(best.get(state, found), found)
        return best

    best = inserted({"": (0, "")})
    for (role, _), fault in zip(turns, faults):
        after = {}

        def offer(state, cost, audit):
            after[state] = min(after.get(state, (cost, audit)), (cost, audit))

        more = 3 if fault == "truncated" else 0
        for state, (cost, audit) in best.items():
            offer(state, cost + 4, audit + "D")
            if fault not in ("blank", "duplicate"):
                if role[:1] and role[:1] in follows[state]:
                    offer(role[:1], cost + more, audit + "K")
                for new in "ua":
                    if new in follows[state]:
                        offer(new, cost + 3 + more, audit + "R")
        best = inserted(after)
    return min(best[state] for state in ("", "a") if state in best)


def plain(turns):
    """gaps, counts, cost, audit and hash of one conversation's (turn, role, text)."""
    turns = [(n, " " if role is None else role, " " if text is None else text) for n, role, text in turns]
    turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in turns:
        left = text.strip(" \t\n\v\f\r")
        if not left:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("none" if left[-1] in ".!?" else "truncated")
        seen.add((role, text))
    numbers = [n for n, _, _ in turns if n is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [role[:1] for _, role, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest([x[1:] for x in turns], faults)
    out, at = [], 0
    for letter in audit:
        role, text = turns[at][1:] if letter != "I" else ("", "")
        at += letter != "I"
        if letter in "RI":
            role = "assistant" if out and out[-1].startswith("u") else "user"
        if letter != "D":
            out.append(f"{role}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def expected(rows):
    known = {}
    for conv, *turn in rows:
        known.setdefault(conv, []).append(turn)
    return sorted(((conv, *plain(turns)) for conv, turns in known.items()), key=str)


def found_in(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted((tuple(row) for row in conversations.repair(frame).collect()), key=str)


def wild(pick, conversations_, longest):
    rows = []
    for conv in range(conversations_):
        for turn in range(pick.randint(1, longest)):
            rows.append((
                conv,
                pick.choice([turn, turn, turn, turn + 5, None]),
                pick.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "support"]),
                pick.choice(["Yes.", "No!", "Why?", "cut", "cut", "", " \n", None, f"{turn}.", f"{turn}. \t", "é。"]),
            ))
    return rows


def test_like_brute_force(spark):
    rows = wild(random.Random(1), 400, 12)
    assert found_in(spark, rows) == expected(rows)


def test_long_conversations_in_segments(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", 64)
    pick = random.Random(2)
    rows = wild(pick, 30, 8) + [(100, *x[1:]) for x in wild(pick, 60, 12)]
    rows += [(101, 5, "user", "again.")] * 500 + [(None, 1, "user", "x."), (None, 2, "assistant", "y")]
    marked = conversations._marked(
        conversations._turns(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text")
    )
    assert conversations.segments(marked).count() > 31
    assert found_in(spark, rows) == expected(rows)


def test_grammar_says_the_same_as_single_symbols():
    pick, grammar = random.Random(3), conversations.Grammar()
    letters = sorted(conversations.LETTERS.values())
    for n in range(40):
        known = letters + [chr(0xE000 + k) for k in range(n)]
        grammar.add(pick.choice(known[-20:]) + pick.choice(known))
    for n, pair in enumerate(grammar.rules):
        def spelt(symbol):
            if symbol in letters:
                return symbol
            return "".join(spelt(x) for x in grammar.rules[ord(symbol) - 0xE000])

        whole = spelt(pair[0]) + spelt(pair[1])
        if len(whole) < 3_000:
            rule = conversations._solved(grammar.matrices, [chr(0xE000 + n)])
            assert rule == conversations._solved(grammar.matrices, [whole])


def test_grammar_is_the_frequent_pairs(spark):
    ua = conversations.LETTERS["u", "none"] + conversations.LETTERS["a", "none"]
    frame = spark.createDataFrame([(ua * n,) for n in range(2, 40)], "symbols string")
    grammar = conversations.re_pair(frame)
    assert grammar.rules[0] == ua and grammar.rules[1] == ""
    assert len(grammar.rules) <= conversations.ROUNDS * conversations.RULES
    short = frame.select(grammar.written(frame["symbols"]).alias("x")).collect()
    assert max(len(row.x) for row in short) <= 8


def test_awkward_tables(spark):
    assert found_in(spark, []) == []
    rows = [(1, None, None, None), (2, -(1 << 63), "user", "a."), (2, (1 << 63) - 1, "assistant", "b."),
            (3, 1, "user", "long " * 100_000 + "."), (3, 2, "assistant", "\x85"), (3, 3, "user", "x ")]
    found = found_in(spark, rows)
    assert found[1][1] is None  # no long holds the number of gaps
    assert [x[2:] for x in found] == [x[2:] for x in expected(rows)]
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", *(f"1 as {x}" for x in ("conv", "digest", "symbols", "part", "cost", "audit", "kind", "fault"))
    )
    assert conversations.repair(wide).count() == 3


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if x is None else str(x) for x in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        if kind == 4:
            role = "user"
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


@pytest.mark.parametrize("more", [[], wild(random.Random(4), 50, 9)])
def test_query(spark, tmp_path, more):
    given = [tuple(row) for row in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()]
    rows = [(x[0], x[1], x[2], x[3]) for x in given] if not more else more + [(900, 13, "user", "x.")] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found = sorted((tuple(x) for x in queries.op12_grammar_repair(spark, str(tmp_path)).collect()), key=str)
    left = damaged(rows)
    wanted = expected(left)
    gone = {x[0] for x in rows} - {x[0] for x in left}
    wanted += [(conv, 0, 0, 0, 0, 0, 0, "", EMPTY) for conv in gone]
    assert found == sorted(wanted, key=str)
