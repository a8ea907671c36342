"""Conversations as units of bounded length, for operators on turns.

A unit holds the rows of ``UNIT_TURNS`` turn numbers of one conversation; nearly every conversation is
one unit. Rows are dealt out and sorted by unit, so a conversation with very many rows is many tasks'
work. An operator first works out every unit as if it were the whole conversation; the conversations
that have several units are then put together from what is known of each of them.

Rows of a null conv_id are one conversation. Rows are in order of turn (null first), role and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm import words as W

UNIT_TURNS = 64
KEY = ["cid", "nul", "unit"]  # a conversation that may have no id, and its unit
WHO = KEY[:2]
NO_TURN = -(1 << 62)
KEYS = "cid long, nul boolean, unit long"


def with_units(conversations: DataFrame) -> DataFrame:
    """(cid, nul, unit, turn, role, text) of the rows (conv_id, turn, role, text)."""
    turn = F.col("turn").cast("long")
    return conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("cid"),
        F.col("conv_id").isNull().alias("nul"),
        F.coalesce(F.floor(turn / UNIT_TURNS), F.lit(NO_TURN)).cast("long").alias("unit"),
        turn.alias("turn"), "role", "text",
    )


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a unit together and in order."""
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "turn", "role", "text")


def each_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Neighbouring rows with the same first columns, a slice of text at a time."""
    rows = (row for batch in W.pieces(batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, group in groupby(rows, key=lambda row: row[:keys]):
        yield key, [row[keys:] for row in group]


def batched(rows: Iterator[dict], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def per_unit(rows: DataFrame, work: Callable[[list[tuple]], dict], schema: pa.Schema, ddl: str) -> DataFrame:
    """One row per unit: its key and what ``work`` makes of its (turn, role, text, ...) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((dict(zip(KEY, key, strict=True)) | work(group) for key, group in each_group(batches, 3)), schema)

    return dealt(rows).mapInArrow(run, ddl)


def of_several_units(units: DataFrame) -> DataFrame:
    """(cid, nul) of the conversations with several units."""
    return units.groupBy(*WHO).agg(F.count("*").alias("n")).filter("n > 1").select(*WHO)


def in_unit_order(parts: DataFrame, column: str = "text") -> DataFrame:
    """A conversation's parts (cid, nul, unit, text, ...) together and in order, for what must be read in sequence."""
    return parts.select(*KEY, column, *[c for c in parts.columns if c not in (*KEY, column)]).repartition(*WHO).sortWithinPartitions(*KEY)
