"""Conversation repair against plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from paperfold.llm import turns

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def cheapest(symbols):
    """(cost, audit) by carrying the best of each state over every row."""

    def inserted(best):
        best = dict(best)
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                now = (cost + 2, audit + "I")
                best[NEXT[state]] = min(best.get(NEXT[state], now), now)
        return best

    best = {0: (0, "")}
    for symbol in symbols:
        found = {}
        for state, (cost, audit) in inserted(best).items():
            role, late = symbol.lower(), symbol.isupper()
            moves = [(state, 3, "D")]
            if symbol != turns.MUST_GO:
                kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role, state))
                moves += [(kept, late, "K")] if kept else []
                moves.append((NEXT[state], 2 + late, "R"))
            for to, more, letter in moves:
                now = (cost + more, audit + letter)
                found[to] = min(found.get(to, now), now)
        best = found
    return min(x for state, x in inserted(best).items() if state in (0, 3))


def runs_of(symbols):
    runs = turns.Runs()
    for symbol in symbols:
        runs.add(symbol, 1)
    return runs


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_least_cost_and_least_audit(monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(600):
        symbols = "".join(rng.choice(turns.SYMBOLS) * rng.choice([1, 1, 2, 5]) for _ in range(rng.randint(0, 6)))
        assert turns.repair(runs_of(symbols)) == cheapest(symbols), symbols


def test_powers_equal_steps():
    for symbol in turns.SYMBOLS:
        after = turns.ending()
        for n in range(1, 40):
            after = turns.before(symbol, 1, after)
            assert turns.before(symbol, n, turns.ending()) == after


def test_long_runs_stay_small():
    runs = turns.Runs()
    for _ in range(3):
        runs.add("x", 10**6)
    assert len(runs) == 1 and turns.before("x", 10**15, turns.ending())[0] == 3 * 10**15
    cost, audit = turns.repair(runs_of("x" * 5000))
    assert (cost, audit) == (15000, "D" * 5000)


def plain(rows):
    """The contract in plain Python: conv_id -> result."""
    out = {}
    for conv_id in {r[0] for r in rows}:
        kept = []
        for turn, role, text in [r[1:4] for r in rows if r[0] == conv_id]:
            key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
            code = zlib.crc32(key.encode()) % 20
            role, text = (" " if x is None else x for x in (role, text))
            if code == 0:
                continue
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            kept += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        symbols, counts, seen = [], {"b": 0, "d": 0, "t": 0}, set()
        for _, role, text in kept:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "b" if not re.search(r"[^\x20\x09-\x0D]", text) else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols.append("x" if fault in ("b", "d") else kind.upper() if fault else kind)
        initials = [r[1][:1] for r in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = cheapest(symbols)
        said, rest, system = [], iter(kept), 0
        for letter in audit:
            row = None if letter == "I" else next(rest)
            if letter == "D":
                continue
            role = ("user", "assistant")[(len(said) - system) % 2] if letter != "K" else row[1]
            system += letter == "K" and not said and role[:1] == "s"
            said.append(f"{role}:{row[2] if row else ''}")
        numbers = [r[0] for r in kept if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv_id] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind string, part int, copies string, audit string, `odd.name` int"


def test_table_equals_plain_python(spark):
    rng = random.Random(3)
    texts = [None, "", " \t", "Hello.", "Hello", "So?\n ", "é!", "a.b", "x" * 50_000, " "]
    roles = ["user", "assistant", "system", None, "", "tool", "User", "superuser", "användare"]
    rows = [
        (rng.choice([None, *range(30)]), rng.choice([None, *range(-2, 9)]), rng.choice(roles[: rng.choice([2, 3, 9])]), rng.choice(texts))
        for _ in range(400)
    ]
    rows += rows[:40] + [(99, 1, "user", "Same.")] * 300 + [(100, None, None, None)]
    df = spark.createDataFrame([(*r, "k", 1, "c", "a", 2) for r in rows], SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in turns.repair_damaged(df).collect()}
    assert got == plain(rows)
    assert turns.repair_damaged(df.limit(0)).collect() == []


def test_conversation_that_loses_all_rows(spark):
    lost = next((c, t) for c in range(200) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*lost, "user", "Hello.")], "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r) for r in turns.repair_damaged(df).collect()] == [(lost[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
