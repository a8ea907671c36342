"""Repair of conversation structure as a lightest derivation.

A repaired conversation has the role initials ``(s?(ua)+)?``: perhaps a system turn, then users and
assistants by turns, or nothing at all. Items say "the first i rows are dealt with and what is written
so far leads to state q"; an edit of a row, or an insertion, deduces one item from another and from the
axiom that the edit is possible. A derivation weighs (cost, audit), audit being the initials of its
edits in order. Both parts only grow, and two audits of one item with equal costs never begin with one
another (they differ in insertions, and these cost), so the deductions are monotone and superior: items
popped from an agenda by least weight are final (Knuth), and the search ends when the goal is popped.

| edit | letter | cost |
|---|---|---|
| keep | K | 0 |
| give the role user or assistant | R | 1 |
| delete; the only edit of a blank or repeated row | D | 2 |
| insert an empty user or assistant turn, anywhere | I | 5 |
| a truncated row that is not deleted | | + 5 |

Long conversations are cut into units of 64 turn numbers (``turns.py``). For each unit the agenda gives
the lightest derivation from every state to every other; these compose, so a conversation is put
together from its units, and rows are repaired unit by unit again. Whether a row repeats one of an
earlier unit is found by grouping. Only the digest of a conversation reads its repaired text in sequence.

Nulls and odd rows: a null role or text is one space, so such a text is blank and such a role can only
be replaced; rows without a turn come first; rows with equal turns go by role and text; a null conv_id
is a conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm import turns as T
from caseweave.llm.graph import keep_counted
from caseweave.storage import keep

EMPTY, SYSTEM, USER, ANSWERED = range(4)  # what is written so far: nothing, s, .. u, .. ua
STATES = range(4)
NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ANSWERED, (ANSWERED, "u"): USER}
GOALS = (EMPTY, ANSWERED)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
WITHIN = 10  # a derivation in any state can be led to any other's future for so much at most
SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (cid, nul, unit, turn, role, text, gone) with the planned damage; dropped rows are ``gone`` and empty."""
    rows = T.with_units(conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")))
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(shown(F.when(~F.col("nul"), F.col("cid"))), F.lit(":"), shown(F.col("turn"))).cast("binary")) % 20
    text = F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.withColumn("fate", fate).select(*T.KEY, "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, for ``repair``."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return T.with_units(rows).withColumn("gone", F.lit(False))


# --- one unit --------------------------------------------------------------------------------------


def fault(role: str, text: str, repeated: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated or none."""
    shown = text.strip(SPACE)
    if not shown:
        return "blank"
    if repeated:
        return "duplicate"
    return "" if shown[-1] in ".!?" else "truncated"


def edits(role: str, found: str) -> list[tuple[str, int, str | None]]:
    """(letter, cost, initial written) of every edit of a row."""
    out = [("D", DELETE, None)]
    if found not in ("blank", "duplicate"):
        more = TRUNCATED if found == "truncated" else 0
        out += [("K", KEEP + more, role[:1]), ("R", REROLE + more, "u"), ("R", REROLE + more, "a")]
    return out


INSERTIONS = [("I", INSERT, "u"), ("I", INSERT, "a")]


def lightest(rows: list[list[tuple[str, int, str]]], start: int, goals: tuple[int, ...], every: bool = False) -> dict[int, tuple[int, str]]:
    """The lightest (cost, audit) from ``start`` before the first row to a goal state after the last; to each goal with ``every``."""
    n = len(rows)
    agenda = [(0, "", 0, start)]
    final: set[tuple[int, int]] = set()
    reached: dict[int, tuple[int, str]] = {}
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == n and q in goals:
            reached[q] = (cost, audit)
            if not every or len(reached) == len(goals):
                break
        for step, options in ((1, rows[i] if i < n else ()), (0, INSERTIONS)):
            for letter, more, initial in options:
                to = q if initial is None else NEXT.get((q, initial))
                if to is not None and (i + step, to) not in final:
                    heapq.heappush(agenda, (cost + more, audit + letter, i + step, to))
    return reached


def written(rows: list[tuple[str, str]], audit: str, start: int) -> Iterator[str]:
    """The lines that an audit makes of the rows (role, text)."""
    left, q = iter(rows), start
    for letter in audit:
        role, text = next(left) if letter != "I" else ("", "")
        if letter == "D":
            continue
        initial = role[:1] if letter == "K" else "a" if q == USER else "u"
        yield f"{role if letter == 'K' else ROLES[initial]}:{text}"
        q = NEXT[q, initial]


def _measured(rows: list[tuple]) -> tuple[dict, list[list[tuple[str, int, str]]], list[tuple[str, str]]]:
    """Faults, turns and adjacent roles of a unit's rows (turn, role, text, gone, whether an earlier unit has it)."""
    seen: set[tuple[str, str]] = set()
    faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    options, stay, numbers = [], [], []
    for turn, role, text, gone, before in rows:
        if gone:
            continue
        found = fault(role, text, before or (role, text) in seen)
        seen.add((role, text))
        faults[found] += 1
        options.append(edits(role, found))
        stay.append((role, text))
        if turn is not None:
            numbers.append(turn)
    initials = [role[:1] for role, _ in stay]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    found = {k: faults[k] for k in ("blank", "duplicate", "truncated")} | {"illegal": illegal, "n_rows": len(stay)}
    found |= {"low": min(numbers, default=None), "high": max(numbers, default=None), "turns": len(set(numbers))}
    return found | {"opens": initials[0] if stay else None, "closes": initials[-1] if stay else None}, options, stay


def whole(rows: list[tuple]) -> dict:
    """A unit as if it were a conversation."""
    found, options, stay = _measured([(*row, False) for row in rows])
    ((_, (cost, audit)),) = lightest(options, EMPTY, GOALS).items()
    gaps = found["high"] - found["low"] + 1 - found["turns"] if found["turns"] else 0
    digest = hashlib.sha256("\n".join(written(stay, audit, EMPTY)).encode()).hexdigest()
    return {k: found[k] for k in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": digest}


def between_states(rows: list[tuple]) -> dict:
    """A unit as a part: the lightest derivations between all states, four rows of four; a cost of -1 is none."""
    found, options, _ = _measured(rows)
    every = [lightest(options, q, tuple(STATES), every=True) for q in STATES]
    ways = [every[q].get(r, (-1, "")) for q in STATES for r in STATES]
    return found | {"costs": [w[0] for w in ways], "audits": [w[1] for w in ways]}


# --- conversations of several units ----------------------------------------------------------------

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = [(c, pa.int64()) for c in COUNTS] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
_KEYS = [("cid", pa.int64()), ("nul", pa.bool_()), ("unit", pa.int64())]
_WHOLE = pa.schema(_KEYS + RESULT)
WHOLE = f"{T.KEYS}, " + "".join(f"{c} long, " for c in COUNTS) + "audit string, repaired_sha256 string"
_PART = pa.schema(
    _KEYS + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "n_rows", "low", "high", "turns")]
    + [("opens", pa.string()), ("closes", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)
PART = f"{T.KEYS}, blank long, duplicate long, truncated long, illegal long, n_rows long, low long, high long, turns long, opens string, closes string, costs array<long>, audits array<string>"
_CHOSEN = pa.schema([*_KEYS, ("start", pa.int32()), ("part_audit", pa.string()), *RESULT[:-1]])
CHOSEN = f"{T.KEYS}, start int, part_audit string, " + "".join(f"{c} long, " for c in COUNTS) + "audit string"


def joined(parts: Iterator[dict]) -> list[dict]:
    """A conversation from its units in order: state before and audit of each, and on the last the totals.

    Of each state the lightest derivation up to here is known; its audit is compared from where the
    derivations of the states first differ.
    """
    best: dict[int, tuple[int, str]] = {EMPTY: (0, "")}
    back: list[tuple[dict, dict[int, tuple[int, str]]]] = []
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    low = high = closes = None
    for part in parts:
        ways: dict[int, tuple[tuple[int, str], int, str]] = {}
        for k, (cost, audit) in enumerate(zip(part["costs"], part["audits"], strict=True)):
            q, r = divmod(k, 4)
            if cost >= 0 and q in best:
                weight = (best[q][0] + cost, best[q][1] + audit)
                if r not in ways or weight < ways[r][0]:
                    ways[r] = (weight, q, audit)
        least = min(w[0][0] for w in ways.values())
        ways = {r: w for r, w in ways.items() if w[0][0] <= least + WITHIN}
        shared = len(commonprefix([w[0][1] for w in ways.values()]))
        best = {r: (w[0][0], w[0][1][shared:]) for r, w in ways.items()}
        back.append(({k: part[k] for k in T.KEY}, {r: w[1:] for r, w in ways.items()}))
        for k in total:
            total[k] += part[k]
        if part["n_rows"]:
            total["illegal"] += closes is not None and closes + part["opens"] not in ("su", "ua", "au")
            closes = part["closes"]
        if part["turns"]:
            low, high = part["low"] if low is None else min(low, part["low"]), part["high"] if high is None else max(high, part["high"])
    (cost, _), state = min((best[r], r) for r in GOALS if r in best)
    out: list[dict] = []
    for key, ways in reversed(back):
        state, audit = ways[state]
        out.append(key | {"start": state, "part_audit": audit})
    out.reverse()
    gaps = high - low + 1 - total.pop("turns") if high is not None else 0
    out[-1] |= total | {"gaps": gaps, "cost": cost, "audit": "".join(o["part_audit"] for o in out)}
    return out


def _repeated_before(rows: DataFrame) -> DataFrame:
    """The rows with ``before``: an earlier unit of the conversation has the same role and text."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumn("digest", digest)
    again = rows.filter("not gone").groupBy(*T.WHO, "digest").agg(F.min("unit").alias("first"), F.max("unit").alias("last")).filter("first < last").drop("last")
    before = F.coalesce(F.col("unit") > F.col("first"), F.lit(False))
    return rows.join(again, [*T.WHO, "digest"], "left").select(*T.KEY, "turn", "role", "text", "gone", before.alias("before"))


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of conversations of several units: how each unit is repaired, and the repaired text of each unit."""
    parts = keep(T.per_unit(_repeated_before(rows), between_states, _PART, PART), "parts")

    names = [*T.KEY, *[c for c in parts.columns if c not in T.KEY]]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (dict(zip(names, row, strict=True)) for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        return T.batched((row for _, own in groupby(found, key=lambda r: (r["cid"], r["nul"])) for row in joined(own)), _CHOSEN)

    chosen = keep(T.in_unit_order(parts, "costs").mapInArrow(combine, CHOSEN), "chosen")

    def rewrite(unit: pa.Table, how: pa.Table) -> pa.Table:
        stay = sorted(zip(*(unit.column(c).to_pylist() for c in ("turn", "role", "text")), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        key, lines = {k: how.column(k)[0].as_py() for k in T.KEY}, list(written([r[1:] for r in stay], how.column("part_audit")[0].as_py(), how.column("start")[0].as_py()))
        return pa.Table.from_pylist([key | {"text": "\n".join(lines), "n_lines": len(lines)}], schema=pa.schema([*_KEYS, ("text", pa.string()), ("n_lines", pa.int64())]))

    rewritten = rows.filter("not gone").groupBy(*T.KEY).cogroup(chosen.select(*T.KEY, "start", "part_audit").groupBy(*T.KEY)).applyInArrow(rewrite, f"{T.KEYS}, text string, n_lines long")
    return chosen, rewritten


def repaired(rows: DataFrame) -> DataFrame:
    """(cid, nul, unit, text, n_lines): the repaired ``role:text`` lines of every unit; ``rows`` as ``undamaged`` gives them."""
    return _parts(rows)[1]


def _digests(lines: DataFrame) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            who, sha, begun = None, hashlib.sha256(), False
            for batch in batches:
                for cid, nul, n, text in zip(*(batch.column(c) for c in ("cid", "nul", "n_lines", "text")), strict=True):
                    if (cid, nul) != who:
                        if who is not None:
                            yield {"cid": who[0].as_py(), "nul": who[1].as_py(), "repaired_sha256": sha.hexdigest()}
                        who, sha, begun = (cid, nul), hashlib.sha256(), False
                    if n.as_py():
                        sha.update((b"\n" if begun else b"") + text.as_py().encode())
                        begun = True
            if who is not None:
                yield {"cid": who[0].as_py(), "nul": who[1].as_py(), "repaired_sha256": sha.hexdigest()}

        return T.batched(each(), pa.schema([*_KEYS[:2], ("repaired_sha256", pa.string())]))

    return T.in_unit_order(lines).mapInArrow(digest, "cid long, nul boolean, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, its gaps, faults and illegal neighbours, the cost and audit of its
    lightest repair, and a digest of the repaired rows. ``rows`` as ``damaged`` or ``undamaged`` give them."""
    units = keep(T.per_unit(rows, whole, _WHOLE, WHOLE), "units")
    several, n = keep_counted(T.of_several_units(units), "several")
    columns = [*T.WHO, *COUNTS, "audit", "repaired_sha256"]
    found = units.join(several, T.WHO, "left_anti").select(*columns)
    if n:
        chosen, lines = _parts(rows.join(several, T.WHO, "left_semi"))
        digests = _digests(lines)
        found = found.unionByName(chosen.filter("cost is not null").join(digests, T.WHO).select(*columns))
    conv_id: Column = F.when(~F.col("nul"), F.col("cid")).alias("conv_id")
    return found.select(conv_id, *columns[2:])
