"""Alignment of two tokenizers against the tokenizers' own libraries and plain loops."""

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from caseweave.llm import alignment
from tests.llm.conftest import ODD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """What the contract says, token by token."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = alignment._byte_letters()
    per_doc = []
    for text in texts:
        want = (" " + (text or "")).encode()
        ta = a.encode(" " + (text or ""), add_special_tokens=False)
        tb = b.encode(text or "")
        bytes_a = [bytes(shown[c] for c in t) for t in ta.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in tb)]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            per_doc.append(None)
            continue
        spans = []
        for ids, parts in ((ta.ids, bytes_a), (tb, bytes_b)):
            at, out = 0, []
            for i, p in zip(ids, parts):
                out.append((i, at, at + len(p)))
                at += len(p)
            spans.append(out)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in spans))
            low = cut
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        per_doc.append((len(spans[0]), len(spans[1]), len(cuts), links, ";".join(groups)))
    counts = collections.Counter(pair for d in per_doc if d for pair in set(d[3]))
    best = collections.defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    rows = []
    for d in per_doc:
        if d is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            rows.append((*d[:3], len(d[3]), sum(counts[p] == best[p[0]] for p in d[3]), sum(counts[p] for p in d[3]), hashlib.sha256(d[4].encode()).hexdigest()))
    return rows, counts, best


TEXTS = [
    "The cat sat on the mat.", "The cat sat on the mat.", "", None, " ", "  two  spaces ", "naïve café 漢字 🙂🙂", "mark ▁ inside", "line\nbreak\r\n\ttab",
    "<|endoftext|> and </s> and <unk>", "é combining", "a b　c", "12345 67890", "x" * 300, "The the THE", "ends in space ", "\x00nul", "�",
]


@pytest.mark.parametrize("fan", [256, 2])
def test_documents_are_those_of_plain_loops(spark, documents, table, fan):
    texts = TEXTS + [r.text for r in table("documents").filter("n_chars < 3000").orderBy("doc_id").limit(60).collect()]
    want, counts, best = plain(texts)
    docs = documents(list(enumerate(texts))).repartition(5)
    runs = alignment.write_runs(docs, A, B)
    settled = alignment.settle(runs, B, fan=fan)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.report(runs, settled).collect()}
    assert [got[i] for i in range(len(texts))] == want
    pairs = {(r.a, r.b): (r.n_docs, r.best) for r in alignment.pair_counts(settled, B).collect()}
    assert pairs == {p: (n, n == best[p[0]]) for p, n in counts.items()}


def test_several_runs_in_a_task(documents):
    texts = [f"word{i % 7} and the thing {i}" for i in range(200)]
    want, *_ = plain(texts)
    runs = alignment.write_runs(documents(list(enumerate(texts))).repartition(3), A, B, most_docs=16)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.report(runs, alignment.settle(runs, B)).collect()}
    assert runs.filter("part = -1").count() >= 3 and [got[i] for i in range(len(texts))] == want


def test_groups_are_written_in_order(documents):
    rows = alignment.groups(documents([(1, "The cat"), (2, None)]), A, B).collect()
    assert {r.doc_id: bool(r.groups) for r in rows} == {1: True, 2: False}


def test_odd_rows_and_no_rows(spark, odd, documents):
    got = alignment.aligned_documents(odd, A, B)
    assert got.count() == len(ODD)
    assert got.filter("doc_id = 7").distinct().count() == 1
    assert documents([]).count() == 0 and alignment.aligned_documents(documents([]), A, B).count() == 0


def test_packed_numbers_come_back():
    import numpy as np

    for numbers in ([], [0], [0, 0, 0], [5, 2**40, 0, 255], list(range(1000))):
        numbers = np.array(numbers, np.uint64)
        assert (alignment.unpack(alignment.pack(numbers)) == numbers).all()
        rising = np.sort(numbers)
        assert (alignment.unpack_rising(alignment.pack_rising(rising)) == rising).all()
