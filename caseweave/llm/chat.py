"""Chat formatting by incremental rendering of a template that is only called, never looked into.

A template is a function from turns (role, text) to one string. For each turn the prefix up to it is
rendered: where the longer output goes on from the shorter one, the difference is the turn's span. If
it does not, the template has rewritten history (``rewrites`` counts the turns at which it did). A
second rendering with one private character in place of the turn's text shows where in its span the
text stands; the spans of assistant texts are the loss mask. After a rewrite every turn is looked for in
the last output by such a probe; a text that the template has dropped or changed has no span (``lost``).

Control strings inside texts are escaped: one backslash more behind the first character of whatever is
a control string but for backslashes there. So no text holds a control string, and taking one backslash
away gives the text back. A template's control strings have their first character nowhere else.

Long conversations are cut into units of 64 turn numbers (``turns.py``). A template says of how many
turns before it a turn's output may depend on (``context``); a unit is rendered behind that many turns
of the units before, whose output is then taken off. The claim is tested at every turn (``rewrites``
counts those where it fails too). A template that needs all history (``context=None``) is given whole
conversations. Within a unit the prefixes are bounded, so work grows with the number of turns.

Nulls and odd rows: a null text or role is empty; rows without a turn come first, rows with equal turns
go by role and text, repeated rows are turns of their own; a null conv_id is a conversation; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm import turns as T
from caseweave.storage import keep

PROBE = "\ue000"  # a private character that stands for a text
Turn = tuple[str, str]


class Template(NamedTuple):
    render: Callable[[list[Turn]], str]
    controls: tuple[str, ...]
    read: Callable[[str], Iterator[Turn]] | None = None  # the turns of an output, texts as they stand there
    context: int | None = 0


# --- escaping --------------------------------------------------------------------------------------


class Escape:
    def __init__(self, controls: tuple[str, ...]):
        if any(c[0] in other[1:] for c in controls for other in controls) or any("\\" in c for c in controls):
            raise ValueError("control strings must not hold another's first character, or a backslash")
        leads = "|".join(f"{re.escape(lead)}(?=\\\\*(?:{'|'.join(re.escape(c[1:]) for c in controls if c[0] == lead)}))" for lead in sorted({c[0] for c in controls}))
        self.plain = re.compile(f"({leads})")
        self.escaped = re.compile(f"({leads})\\\\")

    def escape(self, text: str) -> str:
        return self.plain.sub(r"\1\\", text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(r"\1", text)

    def role(self, role: str) -> str:
        """Roles also lose their line breaks, which may stand between a role and its text."""
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def unrole(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role))


# --- templates -------------------------------------------------------------------------------------


def _instruct(turns: list[Turn]) -> str:
    """Instructions in brackets, answers closed, other roles by name."""
    shown = {"user": "[INST] {1} [/INST]", "assistant": "{1}</s>"}
    return "".join(shown.get(role, "<s>{0}\n{1}</s>").format(role, text) for role, text in turns)


_INSTRUCT = re.compile(r"\[INST\] (.*?) \[/INST\]|<s>(.*?)\n(.*?)</s>|(.*?)</s>", re.DOTALL)


def _read_instruct(output: str) -> Iterator[Turn]:
    for user, role, other, answer in (m.groups() for m in _INSTRUCT.finditer(output)):
        yield ("user", user) if user is not None else ("assistant", answer) if answer is not None else (role, other)


INSTRUCT = Template(_instruct, ("<s>", "</s>", "[INST]", "[/INST]"), _read_instruct)


def _headed(turns: list[Turn]) -> str:
    """A mark before everything, then every turn under its role."""
    return "<begin>" + "".join(f"<turn>{role}\n{text}<end>\n" for role, text in turns)


_HEADED = re.compile(r"<turn>(.*?)\n(.*?)<end>", re.DOTALL)
HEADED = Template(_headed, ("<begin>", "<turn>", "<end>"), lambda output: (m.groups() for m in _HEADED.finditer(output)), context=1)


def _forgetful(turns: list[Turn]) -> str:
    """As under ``HEADED``, but thoughts are shown of the last turn only: earlier output changes."""
    last = len(turns) - 1
    return _headed([(role, text if n == last else re.sub(r"\(thinks:.*?\)", "", text, flags=re.DOTALL)) for n, (role, text) in enumerate(turns)])


FORGETFUL = Template(_forgetful, HEADED.controls, HEADED.read, context=None)


# --- rendering -------------------------------------------------------------------------------------


class Rendered(NamedTuple):
    text: str
    ends: list[int | None]  # of each turn's span; None: it has none in the output
    texts: list[tuple[int, int] | None]  # where each turn's text stands
    rewrites: int


def _probed(output: str, probe: str, size: int) -> tuple[int, int] | None:
    """Where the text of ``size`` characters stands in ``output``, if ``probe`` is that with another text."""
    at = probe.find(PROBE)
    if at < 0 or probe.count(PROBE) != 1:
        return None
    end = len(output) - (len(probe) - at - 1)
    return (at, end) if end - at == size and output[:at] == probe[:at] and output[end:] == probe[at + 1 :] else None


def render(template: Template, turns: list[Turn], before: list[Turn] | None = None) -> Rendered:
    """The output for ``turns`` (already escaped) behind those of ``before``, which are taken off."""
    window, k = list(before or []), template.context
    last = template.render(window)
    skip = last if window else ""
    ends: list[int | None] = []
    texts: list[tuple[int, int] | None] = []
    rewrites, rewritten = 0, False
    for role, text in turns:
        # no text may hold the private character while it is looked for
        clear = [(r, t.replace(PROBE, "?")) if PROBE in t or PROBE in r else (r, t) for r, t in window] if PROBE in last or PROBE in text else window
        probe = template.render([*clear, (role.replace(PROBE, "?"), PROBE)])
        near = window[len(window) - k :] if k is not None and len(window) > k else None
        short = template.render(near) if near is not None else ""
        window.append((role, text))
        output = template.render(window)
        if output.startswith(last):
            if near is not None and template.render([*near, (role, text)]) != short + output[len(last) :]:
                rewrites += 1
        else:
            rewrites, rewritten = rewrites + 1, True
        base = output.replace(PROBE, "?") if clear is not window else output
        texts.append(_probed(base, probe, len(text)))
        ends.append(len(output))
        last = output
    if not last.startswith(skip):
        rewrites, rewritten, skip = rewrites + 1, True, ""
    if rewritten:
        plain = [(r.replace(PROBE, "?"), t.replace(PROBE, "?")) for r, t in window]
        base, n = template.render(plain), len(window) - len(turns)
        probes = [template.render([*plain[: n + i], (plain[n + i][0], PROBE), *plain[n + i + 1 :]]) for i in range(len(turns))]
        texts = [_probed(base, p, len(t)) for p, (_, t) in zip(probes, turns, strict=True)]
        ends = [None] * len(turns)
    cut = len(skip)
    return Rendered(last[cut:], [None if e is None else e - cut for e in ends], [None if t is None else (t[0] - cut, t[1] - cut) for t in texts], rewrites)


# --- tables ----------------------------------------------------------------------------------------

_KEYS = [("cid", pa.int64()), ("nul", pa.bool_()), ("unit", pa.int64())]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FORMATTED = pa.schema([*_KEYS, ("text", pa.string()), ("cut", pa.bool_()), ("turn_ends", pa.list_(pa.int64())), ("loss_mask", _SPANS), ("rewrites", pa.int64()), ("lost", pa.int64())])
FORMATTED = f"{T.KEYS}, text string, cut boolean, turn_ends array<long>, loss_mask array<struct<start: long, end: long>>, rewrites long, lost long"


def _rows(conversations: DataFrame, context: int | None) -> DataFrame:
    """Rows (key, turn, role, text, given, cut) by unit; ``given`` rows are context, ``cut`` says that the conversation has other units."""
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = T.with_units(conversations.select("conv_id", "turn", empty("role"), empty("text")))
    if context is None:
        return rows.withColumn("unit", F.lit(0).cast("long")).withColumns({"given": F.lit(False), "cut": F.lit(False)})
    ends = rows.groupBy(*T.WHO).agg(F.min("unit").alias("low"), F.max("unit").alias("high"))
    several = keep(ends.filter("low < high").select(*T.WHO, F.lit(True).alias("cut")), "several")
    rows = rows.join(several, T.WHO, "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    own = rows.select(*T.KEY, "turn", "role", "text", F.lit(False).alias("given"), "cut")
    if not context:
        return own
    order = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "role", "text")
    last = lambda rows: F.slice(rows, F.greatest(F.lit(1), F.size(rows) - context + 1), context)
    units = rows.filter("cut").groupBy(*T.KEY).agg(F.sort_array(F.collect_list(order)).alias("own")).withColumn("own", last(F.col("own")))
    before = Window.partitionBy(*T.WHO).orderBy("unit").rowsBetween(-context, -1)
    given = units.withColumn("own", F.flatten(F.collect_list("own").over(before))).select(*T.KEY, F.explode(last(F.col("own"))).alias("one"))
    return own.unionByName(given.select(*T.KEY, "one.turn", "one.role", "one.text", F.lit(True).alias("given"), F.lit(True).alias("cut")))


def format_conversations(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(cid, nul, unit, text, cut, turn_ends, loss_mask, rewrites, lost): the output for every unit, where its
    turns end and where its assistant texts stand in it. A conversation's output is that of its units in order."""
    escape = Escape(template.controls)

    def formatted(rows: list[tuple]) -> dict:
        turns = [(escape.role(role), escape.escape(text)) for _, role, text, *_ in rows]
        given = sum(row[3] for row in rows)
        out = render(template, turns[given:], turns[:given])
        answers = [span for span, row in zip(out.texts, rows[given:], strict=True) if row[1] == "assistant"]
        mask = [{"start": s[0], "end": s[1]} for s in answers if s is not None]
        return {"text": out.text, "cut": rows[0][4], "turn_ends": out.ends, "loss_mask": mask, "rewrites": out.rewrites, "lost": out.texts.count(None)}

    return keep(T.per_unit(_rows(conversations, template.context), formatted, _FORMATTED, FORMATTED), "formatted")


def read_back(text: str, mask: list[dict], template: Template, escape: Escape) -> tuple[list[Turn], list[str]]:
    """The turns of an output, and the texts under its loss mask, as they were before escaping."""
    turns = [(escape.unrole(role), escape.unescape(body)) for role, body in template.read(text)]
    return turns, [escape.unescape(text[span["start"] : span["end"]]) for span in mask]


_READ = pa.schema([*_KEYS, ("cut", pa.bool_()), ("n_turns", pa.int64()), ("turns", pa.string()), ("loss", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.int64()), ("lost", pa.int64())])
READ = f"{T.KEYS}, cut boolean, n_turns long, turns string, loss string, formatted_chars long, rewrites long, lost long"
_REPORT = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.int64()), ("lost", pa.int64())]
)
REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long, lost long"


def _summed(parts: Iterator[dict]) -> dict:
    """One conversation from what was read of its units, in order."""
    turns, loss, out, chars = hashlib.sha256(), hashlib.sha256(), dict.fromkeys(("n_turns", "formatted_chars", "rewrites", "lost"), 0), 0
    for part in parts:
        turns.update(part["turns"].encode())
        loss.update(part["loss"].encode())
        chars += len(part["loss"])
        for k in out:
            out[k] += part[k]
        conv_id = None if part["nul"] else part["cid"]
    return out | {"conv_id": conv_id, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest()}


def report(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, read back from the output: its turns and what is under its loss mask.

    A conversation of one unit is summed up where it is read. The units of others are read by many
    tasks; only their digests, which go through a text from its beginning, see one after another.
    """
    escape = Escape(template.controls)

    def reads(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                turns, loss = read_back(row["text"], row["loss_mask"], template, escape)
                found = {"n_turns": len(turns), "turns": "".join(f"{r}\n{t}\n" for r, t in turns), "loss": "".join(loss), "formatted_chars": len(row["text"])}
                yield {k: row[k] for k in (*T.KEY, "cut", "rewrites", "lost")} | found

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return T.batched((_summed([row]) for row in reads(batches)), _REPORT)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return T.batched(reads(batches), _READ, 200)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        return T.batched((_summed(own) for _, own in groupby(rows, key=lambda r: (r["cid"], r["nul"]))), _REPORT)

    parts = T.in_unit_order(formatted.filter("cut").mapInArrow(part, READ), "turns")
    return formatted.filter("not cut").mapInArrow(single, REPORT).unionByName(parts.mapInArrow(together, REPORT))
