"""Top-k reports: rank, keep, then put names on the few rows that are left."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseweave.schema import Tables


def ordered(df: DataFrame, order: Sequence[Column | str], k: int | None) -> DataFrame:
    """Sorted, and cut to k rows when k is given."""
    out = df.orderBy(*order)
    return out if k is None else out.limit(k)


def with_names(
    tables: Tables, df: DataFrame, names: Mapping[str, str], how: str = "inner"
) -> DataFrame:
    """Add the concept name of each id column: ``names`` maps id column -> name column."""
    for id_column, name_column in names.items():
        concept = tables.concept.select(F.col("concept_id").alias(id_column), F.col("concept_name").alias(name_column))
        df = df.join(concept, id_column, how)
    return df


def top_sets(
    tables: Tables, counts: DataFrame, names: Mapping[str, str], k: int | None, how: str = "inner"
) -> DataFrame:
    """The k sets with the most patients, by name: name columns + person_count.

    Ties go to the lower ids. Names are joined after the cut, and the order is restored then.
    """
    order = [F.desc("n"), *names]
    best = counts if k is None else counts.orderBy(*order).limit(k)
    named = ordered(with_names(tables, best, names, how), order, k)
    return named.select(*names.values(), F.col("n").alias("person_count"))


def most_common_value(counts: DataFrame, break_ties: bool) -> DataFrame:
    """From (item, value, n): the most common value per item and the item's total.

    Without ``break_ties`` all values that share the first place are kept.
    """
    by_count = [F.desc("n"), "value"] if break_ties else [F.desc("n")]
    per_item = Window.partitionBy("item")
    return (
        counts.withColumn("place", F.rank().over(per_item.orderBy(*by_count)))
        .withColumn("total", F.sum("n").over(per_item))
        .filter("place = 1")
        .drop("place")
    )


HEAD_PARTS = 64


def head_per_group(df: DataFrame, group: str, order: Sequence[Column | str], rows: int, parts: int = HEAD_PARTS) -> DataFrame:
    """The first rows of every group, by merging the heads of its parts.

    Rows of a group are dealt to ``parts`` parts; each gives its first rows, which its tasks limit before
    they shuffle; a group is then put in order from ``parts`` times ``rows`` rows, however large it is.
    """

    def first(df: DataFrame, keys: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("place", place).filter(F.col("place") <= rows).drop("place")

    part = F.pmod(F.xxhash64(*[c for c in df.columns if c != group]), F.lit(parts))
    return first(first(df.withColumn("part", part), [group, "part"]).drop("part"), [group])
