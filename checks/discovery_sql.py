"""DuckDB counterparts of the discovery queries: plain joins, no pruning, no rewrites."""

from __future__ import annotations

from checks.starviews import STAR_SQL

# Valid events under short names. e = events with a start date, s = start, f = end (start if missing).
EVENTS_SQL = """
vd AS (SELECT concept_id FROM concept WHERE domain_id = 'Drug' AND standard_concept = 'S' AND invalid_reason IS NULL),
vc AS (SELECT concept_id FROM concept WHERE domain_id = 'Condition' AND standard_concept = 'S' AND invalid_reason IS NULL),
drug AS (SELECT person_id AS p, drug_concept_id AS i, drug_exposure_start_date AS s,
                COALESCE(drug_exposure_end_date, drug_exposure_start_date) AS f
         FROM drug_exposure WHERE drug_concept_id IN (SELECT concept_id FROM vd)),
cond AS (SELECT person_id AS p, condition_concept_id AS i, condition_start_date AS s
         FROM condition_occurrence WHERE condition_concept_id IN (SELECT concept_id FROM vc)),
dera AS (SELECT person_id AS p, drug_concept_id AS i, drug_era_start_date AS s, drug_era_end_date AS f
         FROM drug_era WHERE drug_concept_id IN (SELECT concept_id FROM vd)),
cera AS (SELECT person_id AS p, condition_concept_id AS i, condition_era_start_date AS s, condition_era_end_date AS f
         FROM condition_era WHERE condition_concept_id IN (SELECT concept_id FROM vc))
"""
K = 10


def with_star(body: str, more: str = "") -> str:
    extra = f", {more}" if more else ""
    return f"WITH {STAR_SQL}, {EVENTS_SQL}{extra}\n{body}"


def _top(counts: str, names: dict[str, str], n: str = "person_count", more: str = "") -> str:
    """Best K rows of ``counts`` (id columns and n), with names."""
    ids = ", ".join(names)
    select = ", ".join(f"c{j}.concept_name AS {name}" for j, name in enumerate(names.values()))
    joins = " ".join(f"JOIN concept c{j} ON c{j}.concept_id = best.{col}" for j, col in enumerate(names))
    best = f"best AS (SELECT {ids}, n FROM ({counts}) q ORDER BY n DESC, {ids} LIMIT {K})"
    parts = ", ".join(x for x in (more, best) if x)
    return with_star(f"SELECT {select}, CAST(best.n AS BIGINT) AS {n} FROM best {joins}", parts)


def _names(size: int, what: str) -> dict[str, str]:
    return {f"i{j}": f"{what}{j}_name" for j in range(1, size + 1)}


def _join(table: str, size: int, on=lambda j: []) -> str:
    """FROM clause of a self-join: e1 .. e<size> on the person, items in rising order."""
    out = f"FROM {table} e1"
    for j in range(2, size + 1):
        tests = [f"e{j}.p = e1.p", f"e{j}.i > e{j - 1}.i", *on(j)]
        out += f" JOIN {table} e{j} ON " + " AND ".join(tests)
    return out


def _items(size: int, alias: bool = True) -> str:
    return ", ".join(f"e{j}.i" + (f" AS i{j}" if alias else "") for j in range(1, size + 1))


def _distinct_persons(table: str, size: int, on, where: str = "") -> str:
    return (
        f"SELECT {_items(size)}, COUNT(DISTINCT e1.p) AS n {_join(table, size, on)} {where} GROUP BY {_items(size, False)}"
    )


def _near(days: int):
    return lambda j: [f"e{j}.s BETWEEN e{m}.s - {days} AND e{m}.s + {days}" for m in range(1, j)]


def _span(size: int, days: int) -> str:
    starts = ", ".join(f"e{j}.s" for j in range(1, size + 1))
    return f"WHERE GREATEST({starts}) - LEAST({starts}) <= {days}"


def _overlap(j: int) -> list[str]:
    return [f"e{j}.s <= e{m}.f AND e{j}.f >= e{m}.s" for m in range(1, j)]


def _sets(table: str, size: int, what: str) -> str:
    base = f"basket AS (SELECT DISTINCT p, i FROM {table})"
    counts = f"SELECT {_items(size)}, COUNT(*) AS n {_join('basket', size)} GROUP BY {_items(size, False)}"
    return _top(counts, _names(size, what), more=base)


def _separate(table: str, size: int, what: str) -> str:
    ids = ", ".join(f"i{j}" for j in range(1, size + 1))
    same = " AND ".join(["m.p = h.p"] + [f"m.i{j} = h.i{j}" for j in range(1, size + 1)])
    starts = ", ".join(f"e{j}.s" for j in range(1, size + 1))
    ends = ", ".join(f"e{j}.f" for j in range(1, size + 1))
    more = (
        f"basket AS (SELECT DISTINCT p, i FROM {table}), "
        f"have AS (SELECT e1.p AS p, {_items(size)} {_join('basket', size)}), "
        f"meet AS (SELECT DISTINCT e1.p AS p, {_items(size)} {_join(table, size, _overlap)} "
        f"WHERE GREATEST({starts}) <= LEAST({ends}))"
    )
    counts = f"SELECT {ids}, COUNT(*) AS n FROM have h WHERE NOT EXISTS (SELECT 1 FROM meet m WHERE {same}) GROUP BY {ids}"
    return _top(counts, _names(size, what), more=more)


def _followed(table: str, test: str, names: dict[str, str]) -> str:
    counts = (
        f"SELECT e1.i AS a, e2.i AS b, COUNT(DISTINCT e1.p) AS n FROM {table} e1 JOIN {table} e2 "
        f"ON e2.p = e1.p AND e2.i <> e1.i AND {test} GROUP BY e1.i, e2.i"
    )
    return _top(counts, names)


def _drug_after(test: str) -> str:
    counts = (
        f"SELECT c.i AS a, d.i AS b, COUNT(DISTINCT c.p) AS n FROM cond c JOIN drug d ON d.p = c.p AND {test} GROUP BY c.i, d.i"
    )
    return _top(counts, {"a": "condition_name", "b": "drug_name"})


def _common(counts: str, value: str, ties: bool = True) -> str:
    order = "n DESC" + (", v" if ties else "")
    more = (
        f"counts AS ({counts}), ranked AS (SELECT i, v, n, RANK() OVER (PARTITION BY i ORDER BY {order}) AS r, "
        "SUM(n) OVER (PARTITION BY i) AS total FROM counts), "
        f"best AS (SELECT * FROM ranked WHERE r = 1 ORDER BY total DESC, i, v LIMIT {K})"
    )
    return with_star(
        f"SELECT c.concept_name AS condition_name, v AS {value}, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total "
        "FROM best JOIN concept c ON c.concept_id = best.i",
        more,
    )


def _trait(join: str, value: str) -> str:
    return (
        f"SELECT e.i, {value} AS v, COUNT(DISTINCT e.p) AS n FROM cond e JOIN person ON person.person_id = e.p {join} GROUP BY 1, 2"
    )


def _yearly(table: str, name: str) -> str:
    more = (
        f"counts AS (SELECT EXTRACT(YEAR FROM s) AS year, i, COUNT(DISTINCT p) AS n FROM {table} GROUP BY 1, 2), "
        "ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY year ORDER BY n DESC, i) AS r FROM counts), "
        f"best AS (SELECT * FROM ranked ORDER BY year, n DESC, i LIMIT {K})"
    )
    return with_star(
        f"SELECT c.concept_name AS {name}, CAST(year AS BIGINT) AS year, CAST(n AS BIGINT) AS patient_count "
        "FROM best JOIN concept c ON c.concept_id = best.i",
        more,
    )


def _yearly_head(table: str, name: str, head: int) -> str:
    more = (
        f"counts AS (SELECT EXTRACT(YEAR FROM s) AS year, i, COUNT(DISTINCT p) AS n FROM {table} GROUP BY 1, 2), "
        f"best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY year ORDER BY n DESC, i) AS r FROM counts) q WHERE r <= {head})"
    )
    return with_star(
        f"SELECT c.concept_name AS {name}, CAST(year AS BIGINT) AS year, CAST(n AS BIGINT) AS patient_count FROM best JOIN concept c ON c.concept_id = best.i", more
    )


def _quads_in_head(head: int) -> str:
    more = (
        f"top AS (SELECT i FROM (SELECT i, COUNT(DISTINCT p) AS n FROM drug GROUP BY 1) q ORDER BY n DESC, i LIMIT {head}), "
        "few AS (SELECT * FROM drug WHERE i IN (SELECT i FROM top))"
    )
    counts = _distinct_persons("few", 4, _overlap, "WHERE GREATEST(e1.s, e2.s, e3.s, e4.s) <= LEAST(e1.f, e2.f, e3.f, e4.f)")
    return _top(counts, _names(4, "drug"), more=more)


def _era_quads_in_head(head: int) -> str:
    more = (
        f"top AS (SELECT i FROM (SELECT drug_concept_id AS i, COUNT(DISTINCT person_id) AS n FROM drug_era GROUP BY 1) q ORDER BY n DESC, i LIMIT {head}), "
        "basket AS (SELECT DISTINCT person_id AS p, drug_concept_id AS i FROM drug_era JOIN concept ON concept_id = drug_concept_id "
        "WHERE domain_id = 'Drug' AND standard_concept = 'S' AND drug_concept_id IN (SELECT i FROM top))"
    )
    return _top(f"SELECT {_items(4)}, COUNT(*) AS n {_join('basket', 4)} GROUP BY {_items(4, False)}", _names(4, "drug"), more=more)


#: The heads of the queries that have one.
HEAD_SQL = {
    "Q0005_drug_quads_overlapping_in_top_50": lambda: _quads_in_head(50),
    "Q0006_drug_quads_in_top_500": lambda: _era_quads_in_head(500),
    "Q0028_top_20_drugs_of_each_year": lambda: _yearly_head("drug", "drug_name", 20),
    "Q0039_top_20_conditions_of_each_year": lambda: _yearly_head("cond", "condition_name", 20),
}


def discovery_sql() -> dict[str, str]:
    out = {}
    out["Q0001"] = _top(_distinct_persons("drug", 2, _near(30)), _names(2, "drug"))
    out["Q0002"] = _sets("drug", 2, "drug")
    out["Q0003"] = _top(
        _distinct_persons(
            "drug", 4,
            lambda j: [f"e{j - 1}.s <= e{j}.f AND e{j - 1}.f >= e{j}.s", f"e{j}.s BETWEEN e1.s AND e1.s + 30"],
        ),
        _names(4, "drug"),
    )
    out["Q0004"] = _top(_distinct_persons("drug", 4, _overlap), _names(4, "drug"))
    out["Q0005"] = _top(
        _distinct_persons("drug", 4, _overlap, "WHERE GREATEST(e1.s, e2.s, e3.s, e4.s) <= LEAST(e1.f, e2.f, e3.f, e4.f)"),
        _names(4, "drug"),
    )
    # Over a hundred million quads have one patient. The best K have two or more here, so they lie in
    # what two patients have in common; names stand for one concept each in the given tables.
    more = (
        "basket AS (SELECT DISTINCT person_id AS p, drug_concept_id AS i FROM drug_era JOIN concept ON concept_id = drug_concept_id "
        "WHERE domain_id = 'Drug' AND standard_concept = 'S'), "
        "common AS (SELECT a.p AS p, b.p AS q, a.i AS i, COUNT(*) OVER (PARTITION BY a.p, b.p) AS items FROM basket a JOIN basket b ON a.i = b.i AND a.p < b.p), "
        "meet AS MATERIALIZED (SELECT p, q, list(i ORDER BY i) AS l FROM common WHERE items >= 4 GROUP BY 1, 2), "
        "two AS MATERIALIZED (SELECT l, a, unnest(range(a + 1, len(l) + 1)) AS b FROM (SELECT l, unnest(range(1, len(l) + 1)) AS a FROM meet) x), "
        "three AS MATERIALIZED (SELECT l, a, b, unnest(range(b + 1, len(l) + 1)) AS c FROM two), "
        "quad AS MATERIALIZED (SELECT DISTINCT l[a] AS i1, l[b] AS i2, l[c] AS i3, l[d] AS i4 "
        "FROM (SELECT l, a, b, c, unnest(range(c + 1, len(l) + 1)) AS d FROM three) y), "
        "bag AS MATERIALIZED (SELECT p, list(i) AS l FROM basket GROUP BY 1)"
    )
    out["Q0006"] = _top(
        "SELECT i1, i2, i3, i4, COUNT(*) AS n FROM quad JOIN basket ON basket.i = quad.i1 JOIN bag ON bag.p = basket.p "
        "WHERE list_contains(l, i2) AND list_contains(l, i3) AND list_contains(l, i4) GROUP BY 1, 2, 3, 4",
        _names(4, "drug"), more=more,
    )
    out["Q0007"] = _top(_distinct_persons("drug", 3, _near(30), _span(3, 30)), _names(3, "drug"))
    spans = (
        "span AS (SELECT person_id AS p, drug_concept_id AS i, drug_exposure_start_date AS s, "
        "COALESCE(drug_exposure_end_date, DATE '9999-12-31') AS f FROM drug_exposure), "
        f"best AS (SELECT DISTINCT e1.p AS p, {_items(3)}, GREATEST(e1.s, e2.s, e3.s) AS s, LEAST(e1.f, e2.f, e3.f) AS f "
        f"{_join('span', 3)} WHERE GREATEST(e1.s, e2.s, e3.s) <= LEAST(e1.f, e2.f, e3.f) "
        f"ORDER BY p, i1, i2, i3, s, f LIMIT {K})"
    )
    labels = " ".join(f"LEFT JOIN concept c{j} ON c{j}.concept_id = best.i{j}" for j in (1, 2, 3))
    out["Q0008"] = with_star(
        "SELECT p AS person_id, c1.concept_name AS drug1_name, c2.concept_name AS drug2_name, c3.concept_name AS drug3_name, "
        f"CAST(s AS VARCHAR) AS overlap_start, CAST(f AS VARCHAR) AS overlap_end FROM best {labels}",
        spans,
    )
    out["Q0009"] = _separate("dera", 3, "drug")
    out["Q0010"] = _top(_distinct_persons("cond", 2, _near(30)), _names(2, "condition"))
    out["Q0011"] = _sets("cond", 2, "condition")
    out["Q0012"] = _separate("cera", 2, "condition")
    out["Q0013"] = _top(
        f"SELECT i1, i2, i3, i4, COUNT(*) AS n FROM (SELECT DISTINCT e1.p AS p, {_items(4)} "
        f"{_join('cond', 4, _near(1000))} {_span(4, 1000)}) q GROUP BY i1, i2, i3, i4",
        _names(4, "condition"),
    )
    out["Q0014"] = _sets("cond", 4, "condition")
    out["Q0015"] = _separate("cera", 4, "condition")
    out["Q0016"] = _top(_distinct_persons("cond", 3, _near(300), _span(3, 300)), _names(3, "condition"))
    out["Q0017"] = _sets("cond", 3, "condition")
    out["Q0018"] = _separate("cera", 3, "condition")
    out["Q0019"] = _followed("cond", "e2.s > e1.s", {"a": "first_condition", "b": "second_condition"})
    out["Q0020"] = _followed("cond", "e2.s - e1.s >= 30", {"a": "condition_a_name", "b": "condition_b_name"})
    out["Q0021"] = _common(
        "SELECT i, v, COUNT(*) AS n FROM (SELECT e.i, EXTRACT(YEAR FROM e.s) - year_of_birth AS v FROM cond e "
        "JOIN person ON person.person_id = e.p) q WHERE v BETWEEN 0 AND 120 GROUP BY 1, 2",
        "most_common_age", ties=False,
    )
    race = "LEFT JOIN concept r ON r.concept_id = person.race_concept_id"
    out["Q0022"] = _common(_trait(race, "COALESCE(r.concept_name, 'Unknown')"), "most_common_race")
    out["Q0023"] = _common(_trait("JOIN location l ON l.location_id = person.location_id WHERE l.state IS NOT NULL", "l.state"),
                           "most_common_state")
    out["Q0024"] = _common(
        "SELECT i, CAST(EXTRACT(YEAR FROM s) AS BIGINT) AS v, COUNT(DISTINCT p) AS n FROM cond GROUP BY 1, 2", "most_common_year"
    )
    out["Q0025"] = _followed("drug", "e2.s - e1.s >= 30", {"a": "drug_a_name", "b": "drug_b_name"})
    lead = (
        "seq AS (SELECT person_id AS p, drug_concept_id AS a, LEAD(drug_concept_id) OVER (PARTITION BY person_id "
        "ORDER BY drug_exposure_start_date, drug_exposure_id) AS b FROM drug_exposure WHERE drug_concept_id IN (SELECT concept_id FROM vd))"
    )
    out["Q0026"] = _top(
        "SELECT a, b, COUNT(DISTINCT p) AS n FROM seq WHERE b IS NOT NULL AND a <> b GROUP BY a, b",
        {"a": "drug_a_name", "b": "drug_b_name"}, more=lead,
    )
    ethnicity = "LEFT JOIN concept r ON r.concept_id = person.ethnicity_concept_id"
    out["Q0027"] = _common(_trait(ethnicity, "COALESCE(r.concept_name, 'Unknown')"), "most_common_ethnicity")
    out["Q0028"] = _yearly("drug", "drug_name")
    out["Q0029"] = _drug_after("d.s > c.s")
    out["Q0030"] = _drug_after("d.s - c.s > 30")
    gender = "LEFT JOIN concept r ON r.concept_id = person.gender_concept_id AND r.domain_id = 'Gender' AND r.standard_concept = 'S'"
    out["Q0031"] = _common(_trait(gender, "COALESCE(r.concept_name, 'Unknown')"), "most_common_gender")
    out["Q0032"] = with_star(
        f"SELECT year_of_birth AS year, COUNT(*) AS patient_count FROM person GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {K}"
    )
    out["Q0033"] = with_star(
        "SELECT COALESCE(c.concept_name, 'Unknown') AS ethnicity, COUNT(*) AS patient_count FROM person "
        "LEFT JOIN concept c ON c.concept_id = ethnicity_concept_id GROUP BY c.concept_name"
    )
    out["Q0034"] = with_star(
        "SELECT c.concept_name AS race, COUNT(*) AS patient_count FROM person JOIN concept c ON c.concept_id = race_concept_id "
        "WHERE c.domain_id = 'Race' GROUP BY c.concept_name"
    )
    out["Q0035"] = with_star(
        "SELECT COALESCE(c.concept_name, 'Unknown') AS gender, COUNT(*) AS patient_count FROM person LEFT JOIN concept c "
        "ON c.concept_id = gender_concept_id AND c.domain_id = 'Gender' AND c.standard_concept = 'S' AND c.invalid_reason IS NULL "
        "GROUP BY COALESCE(c.concept_name, 'Unknown')"
    )
    for qid, table, name in (("Q0036", "drug", "drug_name"), ("Q0037", "cond", "condition_name")):
        out[qid] = with_star(
            f"SELECT concept_name AS {name}, COUNT(DISTINCT p) AS patient_count FROM {table} JOIN concept ON concept_id = i "
            f"GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {K}"
        )
    out["Q0038"] = with_star(
        "SELECT l.state AS location, COUNT(DISTINCT person_id) AS patient_count FROM person JOIN location l USING (location_id) "
        f"WHERE l.state IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {K}"
    )
    out["Q0039"] = _yearly("cond", "condition_name")
    out["Q0040"] = _yearly("drug", "drug_name")
    return out
