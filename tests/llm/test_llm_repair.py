"""Conversation repair against exhaustive search, cut conversations against whole ones."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from contestry.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, name string, chunk string"


def cheapest(rows):
    """Least (cost, audit) over all edit sequences; rows are (initial, must go, truncated)."""

    @cache
    def rest(k, state, inserted):
        best = [(0, "")] if k == len(rows) and state in repair.ENDS else []
        if inserted < 3:
            best.append(plus(2, "I", rest(k, repair.follows(state), inserted + 1)))
        if k < len(rows):
            initial, must_go, cut = rows[k]
            best.append(plus(3, "D", rest(k + 1, state, 0)))
            if not must_go:
                target = repair.follows(state)
                best.append(plus(2 + cut, "R", rest(k + 1, target, 0)))
                if initial == "s" and state == repair.NOTHING:
                    best.append(plus(cut, "K", rest(k + 1, repair.SYSTEM, 0)))
                if initial == repair.NAMES[target][0]:
                    best.append(plus(cut, "K", rest(k + 1, target, 0)))
        return min((b for b in best if b), default=None)

    def plus(cost, letter, found):
        return found and (cost + found[0], letter + found[1])

    return rest(0, repair.NOTHING, 0)


@pytest.mark.parametrize("modulus", [repair.MODULUS, 3])
def test_program_equals_exhaustive_search(modulus):
    r = random.Random(5)
    for _ in range(400):
        rows = tuple((r.choice("suuaax "), r.random() < 0.2, int(r.random() < 0.3)) for _ in range(r.randrange(9)))
        program = repair.Repair(modulus=modulus)
        for initial, must_go, cut in rows:
            program.row(initial, must_go, bool(cut))
        ends = program.finish()
        assert min(ends[s] for s in repair.ENDS if s in ends) == cheapest(rows), rows


@pytest.mark.parametrize("modulus", [repair.MODULUS, 5])
def test_audits_compare_as_strings(modulus):
    r = random.Random(2)
    edits = repair.Edits(modulus)
    nodes = [0]
    for _ in range(300):
        nodes.append(edits.add(r.choice(nodes), r.choice("DK")))
    for _ in range(4000):
        a, b = r.choice(nodes), r.choice(nodes)
        assert edits.less(a, b) == (edits.text(a) < edits.text(b))


def plain(rows):
    """Result of each conversation, written row by row."""
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = set()
    for conv, kept in found.items():
        kept.sort(key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2]))
        seen, faults = set(), []
        for _, role, text in kept:
            shown = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
            seen.add((role, text))
        program = repair.Repair()
        for (_, role, _), fault in zip(kept, faults, strict=True):
            program.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        ends = program.finish()
        cost, audit = min(ends[s] for s in repair.ENDS if s in ends)
        lines, rest, state = [], iter(kept), "a"
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else next(rest)
            if edit == "D":
                continue
            role = role if edit == "K" else "assistant" if state == "u" else "user"
            state = role[0]
            lines.append(f"{role}:{text}")
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        legal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.add((conv, gaps, *counts, legal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def found_by(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    return {tuple(r) for r in repair.repaired(repair.damaged(df)).collect()}


def test_conversations_equal_plain_version(spark):
    r = random.Random(9)
    texts = ["Good.", "cut off", "", " \t", "Same?", "no end ", "é!", "Long " * 30000 + "."]
    rows = [
        (c, r.choice([None, *range(6)]), r.choice(["system", "user", "assistant", "tool", "", None]), r.choice([*texts, None]))
        for c in [None, *range(60)]
        for _ in range(r.randrange(1, 8))
    ]
    rows += rows[:20]
    assert found_by(spark, rows) == plain(rows)


def test_long_conversation_cut_at_range_borders(spark):
    r = random.Random(4)
    rows = [
        (7, t, r.choice(["user", "assistant"]), r.choice(["Fine.", f"Turn {t}.", "cut", ""])) for t in range(400) for _ in range(r.randrange(3))
    ]
    rows += [(8, None, "user", "Equal row.")] * 300 + [(9, 1, "user", "Hi."), (9, 2, "assistant", "Yes.")]
    assert found_by(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found_by(spark, []) == set()
