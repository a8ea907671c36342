"""Conversation repair against enumeration of all edits, and long conversations against the plain agenda."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from caseweave.llm import repair, turns

SCHEMA = "conv_id long, turn long, role string, text string, blank int, cid string"


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)


def best_of_all(rows):
    """(cost, audit) by trying every edit of every row and up to two insertions in every gap."""
    gaps = [(c, "I" * len(c)) for n in range(3) for c in map("".join, itertools.product("ua", repeat=n))]
    found = []
    for per_row in itertools.product(*[repair.edits(role, fault) for role, fault in rows]):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            initials = inserted[0][0] + "".join((e[2] or "") + g[0] for e, g in zip(per_row, inserted[1:]))
            if re.fullmatch("(s?(ua)+)?", initials):
                audit = inserted[0][1] + "".join(e[0] + g[1] for e, g in zip(per_row, inserted[1:]))
                found.append((sum(e[1] for e in per_row) + 5 * audit.count("I"), audit))
    return min(found)


def test_agenda_finds_the_lightest_of_all_edits():
    rng = random.Random(3)
    cases = [[], [("user", "")], [("assistant", "")], [("system", ""), ("user", "")], [("user", "truncated")], [("system", "truncated"), ("user", ""), ("assistant", "")]]
    cases += [[(rng.choice(["user", "assistant", "system", "tool", " "]), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(1, 3))] for _ in range(25)]
    for rows in cases:
        ((_, got),) = repair.lightest([repair.edits(*r) for r in rows], repair.EMPTY, repair.GOALS).items()
        assert got == best_of_all(rows), rows


def plain(rows, damage=True):
    """Every conversation by itself, with its rows in one list."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            own += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            faults.append(repair.fault(role, text, (role, text) in seen))
            seen.add((role, text))
        ((_, (cost, audit)),) = repair.lightest([repair.edits(r, f) for (_, r, _), f in zip(own, faults)], 0, (0, 3)).items()
        lines = "\n".join(repair.written([r[1:] for r in own], audit, 0))
        numbers = [t for t, *_ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def random_rows(rng, convs, length, spread):
    rows = []
    for conv in convs:
        turn = 0
        for k in range(rng.randint(*length)):
            turn += rng.choice([1, 1, 1, spread])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]) if rng.random() < 0.3 else ("user", "assistant")[k % 2]
            rows.append((conv, None if rng.random() < 0.03 else turn, role, rng.choice(["Yes.", "No!", "well", "", None, " \n", "Is it?", f"n{k}.", f"n{k}. ", "é…"])))
    return rows


def test_conversations_are_those_of_plain_loops(spark):
    rows = random_rows(random.Random(1), [*range(60), None], (1, 9), 2)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damaged(make(spark, rows))).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_of_many_units(spark, seed):
    rows = random_rows(random.Random(seed), [1, 2, None, 4, 5, 6], (20, 60), 40)
    rows += [(7, k, "user", "same.") for k in range(300)] + [(8, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(300)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damaged(make(spark, rows))).collect()}
    assert got == plain(rows)
    tables = repair.undamaged(make(spark, rows))
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(tables).collect()}
    assert got == plain(rows, damage=False)
    lines = [r.text for r in repair.repaired(tables).filter("cid = 8 and not nul").orderBy("unit").collect()]
    assert "\n".join(lines) == "\n".join(f"{('user', 'assistant')[k % 2]}:{k}." for k in range(300))


def test_dropped_conversations_and_no_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = repair.repair(repair.damaged(make(spark, [(gone, 0, "user", "x")]))).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair(repair.damaged(make(spark, []))).count() == 0


def test_units_follow_turns(spark):
    units = turns.with_units(make(spark, [(1, 0, "user", "a"), (1, 63, "user", "a"), (1, 64, "user", "a"), (1, -1, "user", "a"), (1, None, "user", "a")]))
    assert sorted(r.unit for r in units.collect()) == [turns.NO_TURN, -1, 0, 0, 1]
