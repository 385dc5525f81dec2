"""Conversation repair against a plain dynamic program over whole conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyboard.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos int, symbol string"
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """gaps, faults, illegal, cost, audit, turns of one conversation: (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else (
            "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
        faults.append(fault)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    # state -> (cost, audit, turns) with every number of inserts, row by row.
    following = lambda state: "a" if state == "u" else "u"

    def inserted(best):
        out = dict(best)
        for state, (cost, audit, made) in best.items():
            for _ in range(2):
                role = following(state)
                cost, audit = cost + 3, audit + "I"
                made = [*made, ("user" if role == "u" else "assistant", "")]
                state = role
                if state not in out or (cost, audit) < out[state][:2]:
                    out[state] = cost, audit, made
        return out

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}

        def offer(state, cost, audit, made, after=after):
            if state not in after or (cost, audit) < after[state][:2]:
                after[state] = cost, audit, made

        for state, (cost, audit, made) in inserted(best).items():
            offer(state, cost + 4, audit + "D", made)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            first = role[:1]
            if (first == "s" and state == "") or (first in ("u", "a") and first == following(state)):
                offer(first, cost + more, audit + "K", [*made, (role, text)])
            to = following(state)
            offer(to, cost + more + 3, audit + "R", [*made, ("user" if to == "u" else "assistant", text)])
        best = after
    ended = inserted(best)
    cost, audit, made = min((ended[s] for s in ("", "a") if s in ended), key=lambda x: x[:2])
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return gaps, *count, illegal, cost, audit, made


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "Why? \t", "open end", "", " \n ", "Yes.", ".", "é?\x0b", "é", None]
    roles = ["user", "assistant"] * 5 + ["system", "tool", "usher", "", None]
    found = []
    for conv in [*range(120), None]:
        turns = list(range(rng.randint(1, 9))) + [None] * (rng.random() < 0.1)
        for turn in turns:
            if rng.random() < 0.1:
                continue
            role = rng.choice(roles) if rng.random() < 0.4 else ["user", "assistant"][(turn or 0) % 2]
            found.append((conv, turn, role, rng.choice(texts)))
    found += [(500, t, ["user", "assistant"][t % 2], f"Line {t}.") for t in range(8)] * 2
    found += [(501, t, "system", None) for t in range(6)]
    found += [(502, t, rng.choice(roles), rng.choice(texts)) for t in range(150)]
    found += [(503, 3, "user", "Same."), (503, 3, "user", "Other."), (503, 3, "assistant", "Same.")]
    found += [(504, 2**62, "user", "Far."), (504, -(2**62), "assistant", "x" * 70_000 + ".")]
    found += [(505, 7, "user", "Again.")] * 40
    return found


@pytest.mark.parametrize("length", [1024, 3])
def test_repairs(spark, rows, length):
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    found = {}
    for r in cr.repair(cr.damaged(table), table, length).collect():
        assert r.conv_id not in found
        found[r.conv_id] = tuple(r)[1:]
    groups = defaultdict(list)
    for conv, *rest in plain_damage(rows):
        groups[conv].append(tuple(rest))
    assert set(found) == {r[0] for r in rows}
    for conv in found:
        *facts, made = plain_repair(groups[conv])
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()
        assert found[conv] == (*facts, digest), conv


def test_the_repaired_turns(spark, rows):
    lines = cr.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    audits = cr.repaired_audits(lines, 16).select("conv", "audit")
    found = defaultdict(list)
    for r in cr.repaired_turns(lines, audits).orderBy("conv", "place").collect():
        assert r.place == len(found[r.conv.conv_id])
        found[r.conv.conv_id].append((r.role, r.text))
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, own in groups.items():
        made = plain_repair(own)[-1]
        assert found[conv] == made
        initials = "".join(role[:1] for role, _ in made)
        assert initials.removeprefix("s").replace("ua", "") == "" and initials != "s"


def test_no_conversations(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert cr.repair(cr.damaged(table), table).count() == 0
    lost = spark.createDataFrame([(1, 1, "user", "x", "", 0, "")], SCHEMA)
    row = cr.repair(lost.where("false"), lost).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_pairs_are_shared(spark):
    base = spark.createDataFrame([("uaua" * 8,), ("suaua" * 6,), ("d",), ("uA" * 9,)], "symbols string")
    grammar = cr.re_pair(base)
    full = {chr(cr.FIRST_RULE + i): pair for i, pair in enumerate(grammar.rules)}

    def opened(text):
        while any(c in full for c in text):
            text = "".join(full.get(c, c) for c in text)
        return text

    packed = grammar.packed.collect()
    assert all(opened(r.packed) == r.symbols for r in packed)
    assert sum(len(r.packed) for r in packed) < 20
    known = cr.matrices(grammar.rules)
    for r in packed:
        plain = known[r.symbols[0]]
        for symbol in r.symbols[1:]:
            plain = cr.product(plain, known[symbol])
        short = known[r.packed[0]]
        for symbol in r.packed[1:]:
            short = cr.product(short, known[symbol])
        assert {k: (c, str(a)) for k, (c, a) in plain.items()} == {k: (c, str(a)) for k, (c, a) in short.items()}
