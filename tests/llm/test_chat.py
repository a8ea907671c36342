"""Chat formatting: round trips, loss masks, escaping, rewriting templates, long conversations."""

import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st

from caseweave.llm import chat, queries
from tests.llm.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, unit int, cut string"
NASTY = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]", "[", "<", "a <s", "\\", "", "<s>\n</s>", "", None, "plain.", "é🙂\n", "<begin><turn>x\n<end>", "(thinks: no)"]


def make(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


def plain(rows):
    """What the contract says of each conversation, straight from its rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2] is not None, r[2] or ""))
        own = sorted(((t, r or "", x or "") for t, r, x in own), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "to\nol\\n", "", "<s>"]), st.one_of(st.sampled_from([t for t in NASTY if t]), st.text("<>/\\s[]INT \nendturbgi", max_size=30))), max_size=6), st.sampled_from([chat.INSTRUCT, chat.HEADED]))
def test_any_turns_come_back(turns, template):
    escape = chat.Escape(template.controls)
    for role, text in turns:
        assert escape.unescape(escape.escape(text)) == text and escape.unrole(escape.role(role)) == role
        assert not any(c in escape.escape(text) for c in template.controls)
    escaped = [(escape.role(r), escape.escape(t)) for r, t in turns]
    out = chat.render(template, escaped)
    assert out.text == template.render(escaped) and out.rewrites == 0 and (out.ends[-1:] or [len(out.text)]) == [len(out.text)]
    assert [out.text[s:e] for s, e in out.texts] == [t for _, t in escaped]
    mask = [{"start": s, "end": e} for (s, e), (r, _) in zip(out.texts, turns) if r == "assistant"]
    assert chat.read_back(out.text, mask, template, escape) == (turns, [t for r, t in turns if r == "assistant"])


def test_rewritten_history_is_found_and_its_texts_are_located():
    turns = [("user", "a"), ("assistant", "(thinks: hm) yes"), ("user", "b"), ("assistant", "(thinks: so) no")]
    out = chat.render(chat.FORGETFUL, turns)
    assert out.rewrites == 1 and out.ends == [None] * 4
    assert [out.text[slice(*s)] if s else None for s in out.texts] == ["a", None, "b", "(thinks: so) no"]
    assert chat.render(chat.FORGETFUL, turns[:2]).rewrites == 0


def test_a_template_that_looks_further_back_than_it_says_is_found():
    counted = chat.Template(lambda turns: "".join(f"<{n}>{t}" for n, (_, t) in enumerate(turns)), ("<",), context=1)
    assert chat.render(counted, [("user", c) for c in "abcd"]).rewrites == 2


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(c, None if rng.random() < 0.05 else k * step, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(NASTY)) for c, step in [(1, 1), (2, 40), (None, 1), (4, 70), (5, 1)] for k in range(rng.randint(1, 30))]
    return rows + [(6, k, ("user", "assistant")[k % 2], f"{k} </s>") for k in range(500)] + [(6, 3, "assistant", "3 </s>")]


@pytest.mark.parametrize("template", [chat.INSTRUCT, chat.HEADED])
def test_conversations_are_read_back(spark, template):
    rows = rows_of(4)
    got = {r.conv_id: r for r in chat.report(chat.format_conversations(make(spark, rows), template), template).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == plain(rows)
    assert not any(r.rewrites or r.lost for r in got.values())
    escape = chat.Escape(template.controls)
    whole = template.render([(r, escape.escape(t)) for _, _, r, t in sorted(rows[-501:], key=lambda r: r[1])])
    parts = chat.format_conversations(make(spark, rows), template).filter("cid = 6").orderBy("unit").collect()
    assert len(parts) == 8 and "".join(p.text for p in parts) == whole and got[6].formatted_chars == len(whole)


def test_templates_that_need_all_history_get_whole_conversations(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"(thinks: {k}) said {k}") for k in range(80)]
    (row,) = chat.report(chat.format_conversations(make(spark, rows), chat.FORGETFUL), chat.FORGETFUL).collect()
    assert row.n_turns == 80 and row.rewrites == 79 and row.lost == 79


def test_registered_conversations_and_no_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(["user", "assistant"])]
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op11_chat_formatting(spark, SF).collect()}
    assert got == plain(rows) and len(got) == len({r[0] for r in rows})
    assert chat.report(chat.format_conversations(make(spark, []))).count() == 0
