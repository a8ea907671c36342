"""Concept lookups and concept sets.

``slots`` is a DataFrame (instance_id, slot, vocabulary_id, concept_code): one row per place of
a filled-in criterion. All instances are resolved together in one job. The vocabulary side of a
join is broadcast by Spark when its size is below ``spark.sql.autoBroadcastJoinThreshold`` and
shuffled when it is not; nothing here forces a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseweave.schema import Tables

# Vocabularies used to find a code by its name, in lookup order.
NAME_VOCABULARIES = [("Drug", "RxNorm"), ("Drug", "ATC"), ("Drug", "SPL"), ("Condition", "SNOMED"), ("Condition", "ICD10CM")]

VARIANTS = ("map_inner", "map_coalesce_raw", "map_coalesce_valid", "map_coalesce_self", "map_only")


def valid_concepts(tables: Tables, domain: str) -> DataFrame:
    """Ids of the standard concepts of a domain that are not withdrawn."""
    return tables.concept.filter(
        (F.col("domain_id") == domain) & (F.col("standard_concept") == "S") & F.col("invalid_reason").isNull()
    ).select("concept_id")


def resolve_concepts(tables: Tables, slots: DataFrame, variant: str) -> DataFrame:
    """Concept ids that each slot stands for: (instance_id, slot, concept_id), distinct.

    map_inner           follow 'Maps to', keep targets known to ``concept``, take all descendants
    map_coalesce_raw    valid source; valid mapping or else the source itself; all descendants
    map_coalesce_valid  the same, descendants limited to valid standard conditions
    map_coalesce_self   the same, with the mapped concept itself added before the limit
    map_only            follow 'Maps to' and stop there
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown concept set variant: {variant}")
    key = ["instance_id", "slot"]
    checked = variant.startswith("map_coalesce")

    source = tables.concept.filter(F.col("invalid_reason").isNull()) if checked else tables.concept
    seeds = slots.join(source, ["vocabulary_id", "concept_code"]).select(*key, F.col("concept_id").alias("source_id"))

    links = tables.concept_relationship.filter("relationship_id = 'Maps to'")
    if checked:
        links = links.filter("invalid_reason IS NULL")
    links = links.select(F.col("concept_id_1").alias("source_id"), F.col("concept_id_2").alias("target_id"))

    if checked:
        mapped = seeds.join(links, "source_id", "left").select(*key, F.coalesce("target_id", "source_id").alias("concept_id"))
    else:
        mapped = seeds.join(links, "source_id").select(*key, F.col("target_id").alias("concept_id"))
    if variant == "map_only":
        return mapped.distinct()
    if variant == "map_inner":
        mapped = mapped.join(tables.concept.select("concept_id"), "concept_id", "left_semi")

    below = mapped.join(tables.concept_ancestor, F.col("concept_id") == F.col("ancestor_concept_id")).select(
        *key, F.col("descendant_concept_id").alias("concept_id")
    )
    found = below.unionByName(mapped.select(*below.columns)) if variant == "map_coalesce_self" else below
    if variant in ("map_coalesce_valid", "map_coalesce_self"):
        found = found.join(valid_concepts(tables, "Condition"), "concept_id", "left_semi")
    return found.select(*key, "concept_id").distinct()


def labels(tables: Tables, domain: str, alias: str, valid_only: bool = False) -> DataFrame:
    """(concept_id, label) of the standard concepts of a demographic domain."""
    rows = tables.concept.filter((F.col("domain_id") == domain) & (F.col("standard_concept") == "S"))
    if valid_only:
        rows = rows.filter("invalid_reason IS NULL")
    return rows.select("concept_id", F.col("concept_name").alias(alias))


def trait_concepts(tables: Tables, instances: DataFrame, domain: str) -> DataFrame:
    """(instance_id, concept_id): the standard concept of a domain with exactly the wanted name."""
    wanted = labels(tables, domain, "value")
    return instances.select("instance_id", "value").join(wanted, "value").select("instance_id", "concept_id").distinct()


def trait_concepts_with_synonyms(tables: Tables, instances: DataFrame, domain: str) -> DataFrame:
    """As above for valid concepts, in any case, by name or by synonym."""
    wanted = instances.select("instance_id", F.lower("value").alias("lowered"))
    known = labels(tables, domain, "concept_name", valid_only=True)
    by_name = known.select("concept_id", F.lower("concept_name").alias("lowered"))
    by_synonym = tables.concept_synonym.join(known, "concept_id", "left_semi").select(
        "concept_id", F.lower("concept_synonym_name").alias("lowered")
    )
    return wanted.join(by_name.unionByName(by_synonym), "lowered").select("instance_id", "concept_id").distinct()


def codes_by_name(tables: Tables, names: DataFrame) -> DataFrame:
    """All codes of each name: names (name) -> (name, vocabulary_rank, vocabulary_id, concept_code).

    Only standard concepts of the five lookup vocabularies count; upper and lower case are the same.
    """
    rank = F.lit(None).cast("int")
    for i, (domain, vocabulary) in reversed(list(enumerate(NAME_VOCABULARIES))):
        rank = F.when((F.col("domain_id") == domain) & (F.col("vocabulary_id") == vocabulary), i).otherwise(rank)
    known = (
        tables.concept.filter("standard_concept = 'S'")
        .withColumn("vocabulary_rank", rank)
        .filter("vocabulary_rank IS NOT NULL")
        .select(F.lower("concept_name").alias("lowered"), "vocabulary_rank", "vocabulary_id", "concept_code")
    )
    return (
        names.withColumn("lowered", F.lower("name"))
        .join(known, "lowered")
        .select("name", "vocabulary_rank", "vocabulary_id", "concept_code")
    )


def first_code(tables: Tables, names: DataFrame) -> DataFrame:
    """One code per name: the first by vocabulary order, then by code. (name, vocabulary_id, concept_code)"""
    best = F.min(F.struct("vocabulary_rank", "concept_code", "vocabulary_id"))
    return (
        codes_by_name(tables, names)
        .groupBy("name")
        .agg(best.alias("best"))
        .select("name", F.col("best.vocabulary_id").alias("vocabulary_id"), F.col("best.concept_code").alias("concept_code"))
    )
