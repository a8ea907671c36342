"""Mixing sources to target weights, by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). The cells' weights are raked: scaled to the
target shares of one marginal after the other until all three hold. Targets that contradict each
other (a value that only occurs with another one has a different goal) cannot all hold: after
``SWEEPS`` the last marginal, topic, holds, source and lang are off, and by how much is logged. The
weight of a cell per token it has, times a common factor, is the probability with which its documents are sampled. With given
targets the factor is the largest that leaves every probability at most 1, so that the expected
sample holds all targets; a share of all tokens can be asked for instead, and then probabilities
are capped at 1. Whether a document is in is decided by a hash of its id, so the same sample comes
out of every run and after every lost executor.

Without given targets, a value's target share is its present share to the power ``FLATTEN``, which
lifts small sources and lowers a hot one. The rarer a value, the more it is lifted, so here the
rarest cells do not set the rate of all others: the most lifted cells that make up ``RARE`` of all
weight at most are taken whole, as are cells lifted more than ``MOST_LIFT`` times, and fall short of
their targets. So a document's probability is at least its cell's lift divided by ``MOST_LIFT``.

All steps after the first aggregation work on the table of cells. Everything is built-in functions.

Nulls and odd rows: null or missing values of a marginal are the value ""; a null or empty text has
one token; values without a target keep their present share; a target of 0 takes a value out; rows
that repeat an id are in or out together; a null id is hashed like any value; empty tables give
empty results. Other columns pass through ``mix`` unchanged.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.graph import keep_counted
from caseweave.storage import keep

log = logging.getLogger(__name__)

MARGINALS = ("source", "lang", "topic")
FLATTEN = 0.9
SWEEPS = 40
CLOSE = 1e-6  # relative difference between marginal and target at which raking ends
CHARS_PER_TOKEN = 4
RARE = 1e-3  # share of all weight that the cells may have that do not set the rate
MOST_LIFT = 2.0  # weight per token, against the average, above which a cell does not set the rate
STEPS = 100  # in which the logarithm of a lift is told apart when weights are summed by lift


def tokens_of(text: Column) -> Column:
    """An estimate of the tokens of a text, at least 1."""
    return F.greatest(F.lit(1.0), F.coalesce(F.length(text), F.lit(0)) / CHARS_PER_TOKEN)


def topic_of(text: Column) -> Column:
    """The kind of a text by marks in it: notices, listings, contacts, other prose."""
    low = F.lower(text)
    return (
        F.when(F.contains(low, F.lit("licensed under")) | F.contains(low, F.lit("rights reserved")), "notice")
        .when(F.contains(text, F.lit(" | ")), "listing")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit(" +")), "contact")
        .otherwise("prose")
    )


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """Cells (marginals, tokens) with ``weight`` whose marginal shares are those of ``targets``.

    A target is a table (value, share); its shares are taken relative to their sum. What is still off
    after the last sweep is logged as a warning.
    """
    wanted, total = {}, cells.agg(F.sum("tokens")).scalar()
    for m in MARGINALS:
        own = cells.groupBy(m).agg(F.sum("tokens").alias("has"))
        both = own.join(targets[m].select(F.col("value").alias(m), "share"), m, "left").withColumn("share", F.coalesce("share", F.col("has") / total))
        both = keep(both.select(m, "share"), f"share-{m}")
        wanted[m] = keep(both.select(m, (F.col("share") / both.agg(F.sum("share")).scalar() * total).alias("goal")), f"goal-{m}")
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(sweeps):
        off = F.lit(0.0)
        for m in MARGINALS:
            sums = cells.groupBy(m).agg(F.sum("weight").alias("is")).join(wanted[m], m)
            ratio = F.when(F.col("is") > 0, F.col("goal") / F.col("is")).otherwise(0.0)
            sums = sums.select(m, ratio.alias("ratio"), F.when(F.col("goal") > 0, F.abs(F.col("is") / F.col("goal") - 1)).otherwise(0.0).alias(f"off_{m}"))
            cells = cells.join(sums, m).withColumn("weight", F.col("weight") * F.col("ratio")).drop("ratio")
            off = F.greatest(off, F.col(f"off_{m}"))
        cells = keep(cells.select(*MARGINALS, "tokens", "weight", off.alias("off")), "raked")
        worst = cells.agg(F.max("off")).first()[0]
        cells = cells.drop("off")
        if worst is None or worst < CLOSE:
            break
    else:
        off = deviations(cells, wanted)
        if max(off.values()) >= CLOSE:
            log.warning("raking ended after %d sweeps; largest relative distance from a target: %s", sweeps, ", ".join(f"{m} {x:.2g}" for m, x in off.items()))
    return cells


def deviations(cells: DataFrame, wanted: dict[str, DataFrame]) -> dict[str, float]:
    """The largest relative distance of a value's weight from its goal, by marginal."""
    found = {}
    for m in MARGINALS:
        sums = cells.groupBy(m).agg(F.sum("weight").alias("is")).join(wanted[m].filter("goal > 0"), m)
        found[m] = sums.agg(F.max(F.abs(F.col("is") / F.col("goal") - 1))).first()[0] or 0.0
    return found


def flattened(cells: DataFrame, power: float = FLATTEN) -> dict[str, DataFrame]:
    """Targets that are the present shares to a power."""
    return {m: cells.groupBy(F.col(m).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("share")) for m in MARGINALS}


def leading_lift(cells: DataFrame) -> float | None:
    """The lift that is to become probability 1: the largest, or ``MOST_LIFT`` at most, after the
    most lifted cells have been left out that make up ``RARE`` of the weight at most."""
    ratio = F.col("weight") / F.col("tokens")
    steps = cells.filter(ratio > 0).groupBy(F.floor(F.log(ratio) * STEPS).alias("step")).agg(F.max(ratio).alias("lift"), F.sum("weight").alias("weight"))
    found = sorted(steps.collect(), reverse=True)
    total, above = sum(r["weight"] for r in found), 0.0
    for row in found:
        above += row["weight"]
        if above > RARE * total:
            return min(row["lift"], MOST_LIFT)
    return None


def probabilities(cells: DataFrame, share: float | None = None, hold: bool = True) -> DataFrame:
    """Raked cells with ``probability``: weight per token times a factor, at most 1.

    Without ``share`` the factor is the largest that needs no cap; or, if not all targets need to
    ``hold``, the one that makes the leading lift a probability of 1. With it, the factor is raised
    until the expected tokens are that share of all; what capped cells lack the others make up.
    """
    ratio = F.col("weight") / F.col("tokens")
    if share is None and not hold:
        return cells.withColumn("probability", F.least(F.lit(1.0), ratio / F.lit(leading_lift(cells) or 1.0)))
    if share is None:
        largest = cells.agg(F.max(ratio)).first()[0]
        return cells.withColumn("probability", F.least(F.lit(1.0), ratio / F.lit(largest or 1.0)))
    factor = share
    for _ in range(12):
        seen = cells.agg(F.sum("tokens").alias("all"), F.sum(F.least(F.lit(1.0), ratio * factor) * F.col("tokens")).alias("got"), F.sum(F.when(ratio > 0, F.col("tokens"))).alias("most")).first()
        if not seen["all"] or not seen["got"]:
            break
        goal = min(share * seen["all"], seen["most"])
        if abs(seen["got"] / goal - 1) < 1e-4:
            break
        factor *= goal / seen["got"]
    return cells.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(factor)))


def _names(columns: list[str]) -> dict[str, str]:
    """Working names that clash with no column of the documents."""
    mark = f"_{uuid.uuid4().hex[:8]}"
    return {m: m + mark for m in (*MARGINALS, "tokens", "weight", "probability", "sampled")}


def calibrate(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float | None = None, topic: Column | None = None, power: float = FLATTEN) -> tuple[DataFrame, dict[str, str]]:
    """All documents with marginals, tokens, weight per token, probability and the decision, under the returned names."""
    name = _names(docs.columns)
    text = F.col("text")
    dealt = docs.select(
        "*", F.coalesce(F.col("source").cast("string"), F.lit("")).alias(name["source"]), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias(name["lang"]),
        F.coalesce(topic_of(text) if topic is None else topic, F.lit("")).alias(name["topic"]), tokens_of(text).alias(name["tokens"]),
    )
    cells = dealt.groupBy(*(F.col(name[m]).alias(m) for m in MARGINALS)).agg(F.sum(name["tokens"]).alias("tokens"))
    cells, _ = keep_counted(cells, "cells")
    raked = keep(probabilities(rake(cells, targets or flattened(cells, power)), share, hold=bool(targets)), "probabilities")
    rates = raked.select(*(F.col(m).alias(name[m]) for m in MARGINALS), (F.col("weight") / F.col("tokens")).alias(name["weight"]), F.col("probability").alias(name["probability"]))
    number = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(4)), 11) / F.lit(float(1 << 53))
    return dealt.join(rates, [name[m] for m in MARGINALS]).withColumn(name["sampled"], number < F.col(name["probability"])), name


def report(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float | None = None) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, weight, probability, sampled."""
    dealt, name = calibrate(docs.select("doc_id", "text", "source", "lang"), targets, share)
    return dealt.select("doc_id", *(F.col(new).alias(old) for old, new in name.items()))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float | None = None, power: float = FLATTEN) -> DataFrame:
    """The sampled documents, with the columns they came with."""
    dealt, name = calibrate(docs, targets, share, power=power)
    return dealt.filter(name["sampled"]).select(*docs.columns)
