"""Quality rules as a ledger of failure bits.

``measure`` reads each text once and counts what rules look at. ``ledger`` turns the counts into one
bit per rule and stores both. Policies are versioned sets of rules: applying one, or asking what a
rule does to it, is bit arithmetic over the ledger, and no text is read again.

Nulls and odd rows: a null text counts as empty (all counts 0); empty tables give empty results;
repeated rows are measured each by themselves; a null doc_id is passed through. Columns besides the
identifier and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm import words as W

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: One bit per rule, in this order. New rules go to the end, so that stored ledgers stay readable.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("many_symbols", "10 * n_symbols > 2 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "word_chars > 25 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
]
BIT = {name: 1 << place for place, (name, _) in enumerate(RULES)}

#: The rules that each version of the policy rejects by.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "lines-1": ("few_words", "repeated_words", "repeated_lines"),
    "full-1": tuple(BIT),
}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spaces, lines = W.alphabet(W.SPACES), W.alphabet(b"\n")
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for batch in W.pieces(batches):
        data, offsets = W.text_bytes(batch.column("text"))
        n = len(batch)
        words = W.find_words(data, offsets, spaces)
        n_words = np.bincount(words.doc, minlength=n)
        first_byte = ((data & 0xC0) != 0x80) & ~spaces.separator[data]  # one per character of a word
        # lines that have a word
        found = W.find_words(data, offsets, lines)
        begins = np.searchsorted(words.start, found.start)
        has_word = np.searchsorted(words.start, found.end) > begins
        owner = found.doc[has_word]
        own = W.mix(found.hash[has_word] + W.mix(owner.astype(W.U64)))
        n_lines = np.bincount(owner, minlength=n)
        _, firsts = np.unique(own, return_index=True)
        n_dup_lines = n_lines - np.bincount(owner[firsts], minlength=n)
        # words in windows that their text has twice or more
        at, gram = W.windows(words, WINDOW)
        gram = W.mix(gram + W.mix(words.doc[at].astype(W.U64)))
        _, which, count = np.unique(gram, return_inverse=True, return_counts=True)
        begin = at[count[which] > 1]
        change = np.zeros(len(words.doc) + 1, np.int64)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + WINDOW, -1)
        repeated = np.cumsum(change)[:-1] > 0
        n_repeat = np.bincount(words.doc[repeated], minlength=n)
        counts = [n_words, W.counts_by_doc(first_byte, offsets), W.counts_by_doc(symbol[data], offsets), n_lines, n_dup_lines, n_repeat]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts)], names=[batch.schema.names[0], *MEASURES])


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document with what the rules need; the identifier keeps its type."""
    rows = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(_measured, f"`{id_column}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and failure bits of every document: what is worth storing."""
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES]
    return measure(docs, id_column, text_column).withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def fails(policy: str) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(policy))) != 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents it fails, and documents that only it rejects.

    Documents are first counted by failure bits, at most one row per combination of rules, so that
    all that is shuffled is bounded by the rules and not by the documents.
    """
    kinds = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[policy]))
    return (
        kinds.select("bits", "n", F.explode(names).alias("r"))
        .filter(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
        .groupBy("r.rule")
        .agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))
    )


def rules_report(docs: DataFrame, policy: str = "full-1") -> DataFrame:
    """Per document: the counts, ``base_failed``, the ledger's bits and the verdict of the policy."""
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        fails("base-1").alias("base_failed"), (~fails("base-1") & ~fails(policy)).alias("kept"),
        "n_lines", "failures", F.lit(policy).alias("policy"),
    )
