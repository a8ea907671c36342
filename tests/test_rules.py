"""Edge rules on hand-made patients: boundaries, missing dates, empty overlaps, unknown labels, concept sets."""

import pytest

from caseweave.operators.concepts import codes_by_name, first_code, resolve_concepts
from caseweave.operators.demographics import count_by
from caseweave.plans import discovery
from caseweave.plans.cohorts import COHORTS, evaluate, slot_rows
from conftest import concept, day, numbers, self_links

A, B, C, D = 10, 11, 12, 13


@pytest.fixture
def vocabulary():
    links, ancestors = self_links([A, B, C, D])
    return dict(
        concept=[concept(A, "a"), concept(B, "b"), concept(C, "c"), concept(D, "d")],
        concept_relationship=links,
        concept_ancestor=ancestors,
    )


@pytest.fixture
def drugs():
    links, ancestors = self_links([A, B, C, D])
    names = [concept(i, n, "Drug", "RxNorm") for i, n in ((A, "a"), (B, "b"), (C, "c"), (D, "d"))]
    return dict(concept=names, concept_relationship=links, concept_ancestor=ancestors)


def exposure(n, person, item, start, end=None):
    return (n, person, item, start if start is None else day(start), None if end is None else day(end))


def test_gap_boundaries(tiny, vocabulary, instances):
    """29, 30 and 31 days: within and at least are closed, more than is open."""
    events = []
    for person, gap in ((1, 29), (2, 30), (3, 31), (4, 0)):
        events += [(person, A, day(100)), (person, B, day(100 + gap))]
    tables = tiny(condition_occurrence=events, **vocabulary)
    ask = instances([(1, ["10", "11"], None)])
    assert numbers(evaluate(tables, COHORTS["F0012"], ask)) == {1: 3}  # within: 29, 30, same day
    assert numbers(evaluate(tables, COHORTS["F0023"], ask)) == {1: 2}  # at least: 30, 31
    assert numbers(evaluate(tables, COHORTS["F0022"], ask)) == {1: 3}  # strictly after: not the same day
    assert numbers(evaluate(tables, COHORTS["F0023"], ask, days=31)) == {1: 1}


def test_more_than_is_open_for_drugs(tiny, drugs, instances):
    rows = []
    for person, gap in ((1, 29), (2, 30), (3, 31)):
        rows += [exposure(2 * person, person, A, 100), exposure(2 * person + 1, person, B, 100 + gap)]
    tables = tiny(drug_exposure=rows, **drugs)
    later_first = instances([(1, ["11", "10"], None), (2, ["10", "11"], None)], "RxNorm")
    assert numbers(evaluate(tables, COHORTS["F0028"], later_first)) == {1: 1, 2: 0}
    assert numbers(evaluate(tables, COHORTS["F0029"], later_first)) == {1: 0, 2: 3}


def test_span_is_not_pairwise(tiny, drugs, instances):
    """Neighbours are 20 days apart, but the three span 40."""
    rows = [exposure(1, 1, A, 0), exposure(2, 1, B, 20), exposure(3, 1, C, 40)]
    rows += [exposure(4, 2, A, 0), exposure(5, 2, B, 20), exposure(6, 2, C, 30)]
    tables = tiny(drug_exposure=rows, **drugs)
    ask = instances([(1, ["10", "11", "12"], None)], "RxNorm")
    assert numbers(evaluate(tables, COHORTS["F0009"], ask)) == {1: 1}
    found = discovery.drug_triples_within_30_days(tables, 10).collect()
    assert [tuple(r) for r in found] == [("a", "b", "c", 1)]


def test_missing_start_never_matches(tiny, drugs, instances):
    rows = [exposure(1, 1, A, None), exposure(2, 1, B, 5)]
    tables = tiny(drug_exposure=rows, **drugs)
    ask = instances([(1, ["10", "11"], None)], "RxNorm")
    assert numbers(evaluate(tables, COHORTS["F0003"], ask)) == {1: 0}
    assert numbers(evaluate(tables, COHORTS["F0004"], ask)) == {1: 1}


def test_missing_end(tiny, drugs, instances):
    """One day in overlap queries, open in ranges, no match in year spans."""
    rows = [exposure(1, 1, A, 0), exposure(2, 1, B, 0, 10), exposure(3, 1, C, 10, 20), exposure(4, 1, D, 5, 9)]
    tables = tiny(drug_exposure=rows, **drugs)
    open_ended = discovery.drug_triples_overlapping(tables, None).collect()
    assert {tuple(r)[1:4] for r in open_ended} == {("a", "b", "c"), ("a", "b", "d")}
    assert discovery.drug_quads_overlapping(tables, None).count() == 0
    ask = instances([(1, ["10"], "2020"), (2, ["11"], "2020"), (3, ["11"], "2021")], "RxNorm")
    assert numbers(evaluate(tables, COHORTS["F0031"], ask)) == {1: 0, 2: 1, 3: 0}


def test_empty_intersection_overlaps_nothing(tiny, drugs):
    """a and b do not meet; c spans both, yet there is no common period."""
    rows = [exposure(1, 1, A, 0, 5), exposure(2, 1, B, 10, 15), exposure(3, 1, C, 0, 20)]
    tables = tiny(drug_exposure=rows, **drugs)
    assert discovery.drug_triples_overlapping(tables, None).count() == 0


def test_short_overlap(tiny, drugs, instances):
    """The length of the common period counts, not the distance of the starts."""
    def person(p, ends, n):
        return [exposure(n + i, p, item, start, end) for i, (item, start, end) in enumerate(zip((A, B, C, D), (0, 1, 2, 50), ends))]

    rows = person(1, (200, 200, 200, 200), 0) + person(2, (200, 200, 81, 200), 10) + person(3, (200, 200, 80, 200), 20)
    rows += person(4, (200, 49, 200, 200), 30)
    tables = tiny(drug_exposure=rows, **drugs)
    ask = instances([(1, ["10", "11", "12", "13"], None)], "RxNorm")
    assert numbers(evaluate(tables, COHORTS["F0006"], ask)) == {1: 1}
    assert numbers(evaluate(tables, COHORTS["F0006"], ask, days=31)) == {1: 2}


def test_separate_or_together(tiny, vocabulary):
    eras = [(1, A, day(0), day(10)), (1, B, day(10), day(20)), (2, A, day(0), day(9)), (2, B, day(10), day(20)),
            (3, A, day(0), day(9)), (3, A, day(12), day(13)), (3, B, day(10), day(20))]
    tables = tiny(condition_era=eras, **vocabulary)
    assert [tuple(r) for r in discovery.condition_pairs_separate(tables, 10).collect()] == [("a", "b", 1)]


def test_zero_rows_stay(tiny, vocabulary, instances):
    tables = tiny(condition_occurrence=[(1, A, day(0))], **vocabulary)
    ask = instances([(1, ["10"], None), (2, ["11"], None), (3, ["no such code"], None)])
    assert numbers(evaluate(tables, COHORTS["F0053"], ask)) == {1: 1, 2: 0, 3: 0}


def test_unknown_patients(tiny, drugs, instances):
    """One criterion asks for a row in person, its sibling does not."""
    tables = tiny(drug_exposure=[exposure(1, 7, A, 0)], condition_occurrence=[], **drugs)
    ask = instances([(1, ["10"], None)], "RxNorm")
    assert numbers(evaluate(tables, COHORTS["F0052"], ask)) == {1: 0}
    assert numbers(evaluate(tables, COHORTS["F0005"], ask.selectExpr("instance_id", "array(codes[0], codes[0]) AS codes", "value"))) == {1: 1}


def test_real_unknown_is_its_own_group(tiny):
    people = [(1, 1980, None, 1, None, None), (2, 1980, 5, None, None, None), (3, 1980, 6, 1, None, None)]
    concepts = [concept(5, "Unknown", "Gender"), concept(6, "F", "Gender"), concept(1, "r", "Race")]
    tables = tiny(person=people, concept=concepts)
    rows = sorted(tuple(r) for r in count_by(tables, ["gender"]).collect())
    assert rows == [("F", 1), ("Unknown", 1), ("Unknown", 1)]
    races = {r["race"]: r["number_of_patients"] for r in count_by(tables, ["race"], unknown=False).collect()}
    assert races == {"r": 2, None: 1}


def test_states_are_compared_loosely(tiny, vocabulary, instances):
    people = [(1, 1980, None, None, None, 1), (2, 1980, None, None, None, 2), (3, 1980, None, None, None, 3), (4, 1980, None, None, None, 4)]
    places = [(1, " ohio "), (2, "OHIO"), (3, "  "), (4, "unknown")]
    events = [(p, A, day(0)) for p in (1, 2, 3, 4)]
    tables = tiny(person=people, location=places, condition_occurrence=events, **vocabulary)
    ask = instances([(1, ["10"], "Ohio"), (2, ["10"], " "), (3, ["10"], "UNKNOWN")])
    assert numbers(evaluate(tables, COHORTS["F0026"], ask)) == {1: 2, 2: 0, 3: 0}
    assert numbers(evaluate(tables, COHORTS["F0054"], ask)) == {1: 0, 2: 0, 3: 0}


def test_race_by_synonym(tiny, vocabulary, instances):
    people = [(1, 1980, None, 90, None, None), (2, 1980, None, 91, None, None)]
    vocabulary["concept"] += [concept(90, "Race one", "Race"), concept(91, "Race two", "Race")]
    tables = tiny(person=people, concept_synonym=[(90, "First")], condition_occurrence=[(1, A, day(0)), (2, A, day(0))], **vocabulary)
    ask = instances([(1, ["10"], "FIRST"), (2, ["10"], "race TWO"), (3, ["10"], "third")])
    assert numbers(evaluate(tables, COHORTS["F0025"], ask)) == {1: 1, 2: 1, 3: 0}


def test_ages(tiny, vocabulary, instances):
    people = [(1, 1980, None, None, None, None), (2, 2025, None, None, None, None)]
    tables = tiny(person=people, condition_occurrence=[(1, A, day(0)), (1, A, day(1)), (2, A, day(0))], **vocabulary)
    assert numbers(evaluate(tables, COHORTS["F0024"], instances([(1, ["10"], "40"), (2, ["10"], "39")]))) == {1: 1, 2: 0}
    rows = [tuple(r) for r in discovery.condition_common_age(tables, 10).collect()]
    assert rows == [("a", 40, 2, 2)]  # records are counted; the age below 0 is not


def test_directly_followed(tiny, drugs):
    """Order by day, then id; a repeat of the same drug breaks the pair but is none itself."""
    rows = [exposure(3, 1, A, 0), exposure(1, 1, B, 0), exposure(2, 1, C, 5), exposure(4, 1, C, 6), exposure(5, 1, D, 7)]
    tables = tiny(drug_exposure=rows, **drugs)
    found = {(r["drug_a_name"], r["drug_b_name"]) for r in discovery.drug_directly_followed_by_drug(tables, 10).collect()}
    assert found == {("b", "a"), ("a", "c"), ("c", "d")}


def test_concept_set_variants(tiny, instances):
    """One source code, five readings of it."""
    concepts = [
        concept(1, "source", code="s", standard=None),
        concept(2, "target"), concept(3, "child"), concept(4, "withdrawn child", invalid="D"),
        concept(5, "bad source", code="bad", invalid="D"), concept(6, "no link", code="alone"),
    ]
    links = [(1, 2, "Maps to", None), (1, 3, "Is a", None), (5, 2, "Maps to", None), (1, 99, "Maps to", None), (1, 3, "Maps to", "D")]
    below = [(2, 3), (2, 4), (6, 3), (99, 3)]  # no self rows
    tables = tiny(concept=concepts, concept_relationship=links, concept_ancestor=below)
    slots = slot_rows(instances([(1, ["s"], None), (2, ["bad"], None), (3, ["alone"], None)]))

    def sets(variant):
        out = {1: set(), 2: set(), 3: set()}
        for r in resolve_concepts(tables, slots, variant).collect():
            out[r["instance_id"]].add(r["concept_id"])
        return out

    assert sets("map_inner") == {1: {3, 4}, 2: {3, 4}, 3: set()}
    assert sets("map_coalesce_raw") == {1: {3, 4}, 2: set(), 3: {3}}
    assert sets("map_coalesce_valid") == {1: {3}, 2: set(), 3: {3}}
    assert sets("map_coalesce_self") == {1: {2, 3}, 2: set(), 3: {3, 6}}
    assert sets("map_only") == {1: {2, 3, 99}, 2: {2}, 3: set()}
    with pytest.raises(ValueError):
        resolve_concepts(tables, slots, "other")


def test_one_name_with_two_codes(tiny, spark):
    concepts = [
        concept(1, "Same", "Drug", "ATC", "x"), concept(2, "same", "Drug", "RxNorm", "z"), concept(3, "SAME", "Drug", "RxNorm", "y"),
        concept(4, "same", "Condition", "SNOMED", "a"), concept(5, "same", "Drug", "SPL", "b", standard=None),
    ]
    tables = tiny(concept=concepts)
    names = spark.createDataFrame([("sAmE",), ("other",)], "name string")
    assert codes_by_name(tables, names).count() == 4
    assert [tuple(r) for r in first_code(tables, names).collect()] == [("sAmE", "RxNorm", "y")]


def test_separate_without_a_patient(tiny, vocabulary):
    """Eras of nobody count for nobody."""
    eras = [(None, A, day(0), day(10)), (None, B, day(40), day(50)), (2, A, day(0), day(9)), (2, B, day(10), day(20))]
    found = discovery.condition_pairs_separate(tiny(condition_era=eras, **vocabulary), 10).collect()
    assert [tuple(r) for r in found] == [("a", "b", 1)]
