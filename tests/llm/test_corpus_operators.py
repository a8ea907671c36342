"""Operators that look at the whole corpus, against brute force on small tables."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.llm import graph, mixing, neardup, quality, queries, shards, vectors

from .conftest import ODD, SF

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# components


@pytest.mark.parametrize(
    "edges",
    [
        [(i, i + 1) for i in range(60)],
        [(50, i) for i in range(100) if i != 50],
        [(3, 4)],
        [(random.Random(1).randrange(300), i) for i in range(250)],
        [(1, 1)],
        [],
    ],
)
def test_components(spark, edges):
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = Union({n for e in edges for n in e if e[0] != e[1]})
    for a, b in edges:
        if a != b:
            nodes.join(a, b)
    assert found == {n: nodes.find(n) for n in nodes.up}


def test_components_after_more_edges(spark):
    first, more = [(1, 2), (3, 4), (5, 6), (8, 9)], [(4, 5), (2, 10), (20, 21), (3, 3)]
    groups = graph.components(spark.createDataFrame(first, "a long, b long"))
    found = {r.node: r.component for r in graph.merge(groups, spark.createDataFrame(more, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 10: 1, 3: 3, 4: 3, 5: 3, 6: 3, 8: 8, 9: 8, 20: 20, 21: 20}


# near-duplicate documents


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return set(zip(*(words[j:] for j in range(k)), strict=False)) if len(words) >= k else {tuple(words)} if words else set()


def linked(all_rows, k=4):
    sets = [(i, shingles(t, k)) for i, t in all_rows if i is not None]
    nodes = Union({i for i, _ in sets})
    by = {}
    for place, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(place)
    tried = {(a, b) for places in by.values() for a in places for b in places if a < b}
    for a, b in tried:
        (i, s), (j, t) = sets[a], sets[b]
        if 100 * len(s & t) >= 80 * len(s | t):
            nodes.join(i, j)
    return nodes


def check_near(found, all_rows, k=4):
    nodes = linked(all_rows, k)
    wanted = [(i, len(shingles(t, k)), i if i is None else nodes.find(i), i is not None and nodes.find(i) == i) for i, t in all_rows]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in found.collect()), key=order) == sorted(wanted, key=order)


def test_near_documents_are_those_of_brute_force(spark, table):
    rows = [(r.doc_id, r.text) for r in table("documents").select("doc_id", "text").collect()]
    check_near(queries.op5_minhash_near_dedup(spark, SF), rows)


def test_chains_of_copies_and_shared_passages(documents):
    """Copies of copies link only to their neighbours; many documents share a passage but are no copies."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows, passage = [], [word() for _ in range(60)]
    for group in range(6):
        text = [word() for _ in range(120)]
        for step in range(12):
            rows.append((1000 * group + 37 * (12 - step) % 500, " ".join(text)))
            text = text[8:] + [word() for _ in range(8)]
    base = [word() for _ in range(200)]
    for i in range(40):  # copies of one text that often lie just under the limit to each other
        text = list(base)
        for _ in range(6):
            text[rnd.randrange(200)] = word()
        rows.append((20000 + i, " ".join(text)))
    rows += [(30000 + i, " ".join([*passage, *(word() for _ in range(40))])) for i in range(30)]
    check_near(neardup.near_duplicates(documents(rows)), rows)


def test_near_documents_of_odd_rows(odd):
    check_near(neardup.near_duplicates(odd), ODD)
    check_near(neardup.near_duplicates(odd, k=5), ODD, 5)
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


# near-duplicate vectors


def check_vectors(spark, rows, **how):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = []
    for place, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(np.float32(x)) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            unit.append((place, i, x / np.linalg.norm(x)))
    nodes, links = Union({i for i, _ in rows if i is not None}), dict.fromkeys(range(len(rows)), 0)
    for p, i, x in unit:
        for q, j, y in unit:
            if p < q and len(x) == len(y) and x @ y >= 0.9:
                links[p], links[q] = links[p] + 1, links[q] + 1
                nodes.join(i, j)
    wanted = sorted((i is None, i or 0, links[p], i if i is None else nodes.find(i), i is not None and nodes.find(i) == i) for p, (i, _) in enumerate(rows))
    found = vectors.near_vectors(frame, **how).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in found) == wanted


def test_near_vectors_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(60):
        centre = rng.standard_normal(64)
        for _ in range(1 + g % 7 + 60 * (g == 0)):
            rows.append((len(rows), (centre + 0.2 * rng.standard_normal(64)).tolist()))
    rnd = random.Random(2)
    rnd.shuffle(rows)
    rows += [(9000, None), (9001, []), (9002, [0.0] * 64), (9003, [1.0] * 63 + [float("nan")]), (9004, [1.0] * 63 + [None]), (9005, [2.0] * 64), (9006, [1.0] * 64), (9007, [1.0, 2.0]), (9008, [1.0, 2.1]), (9009, [float("inf")] * 64), (None, [1.0] * 64), (9010, [1.0] * 64)]
    check_vectors(spark, rows, miss=1e-7)
    check_vectors(spark, rows, miss=1e-7, block=16)
    check_vectors(spark, rows[:0])


def test_registered_vectors(spark, table):
    rows = [(r.vec_id, list(r.embedding)) for r in table("embeddings").select("vec_id", "embedding").collect()]
    check_vectors(spark, rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, factors = vectors.encode(x)
    upper = vectors._upper(codes, factors, x.astype(np.float32))
    assert (upper >= x @ x.T - 1e-6).mean() > 0.9999
    width = (upper - x @ x.T)[~np.eye(400, dtype=bool)]
    assert 0.1 < width.mean() < 0.6


# shards


def check_shards(found, limit):
    rows = found.toPandas()
    sums = rows.groupby("shard").agg(total=("bytes", "sum"), n=("bytes", "size"), said=("shard_bytes", "first"))
    assert (sums.total == sums.said).all() and ((sums.total <= limit) | (sums.n == 1)).all()
    names = sorted(sums.index)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    return rows


def test_shards_fit_and_are_prefixes(spark, table, documents):
    docs = table("documents")
    rows = check_shards(shards.shard(docs, 20000), 20000)
    assert sorted(rows.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert rows.bytes.sum() == docs.agg(F.sum(F.octet_length("text"))).first()[0]


def test_equal_rows_are_spread_over_shards(documents):
    rows = check_shards(shards.shard(documents([(7, "x" * 1000)] * 50 + ODD), 5000), 5000)
    assert len(rows) == 50 + len(ODD) and rows[rows.doc_id == 7].shard.nunique() >= 10


def test_registered_shards_and_empty_table(spark, odd, tmp_path):
    assert queries.op3_byte_limited_shards(spark, SF).select("shard").distinct().count() == 1
    assert shards.shard(odd.limit(0)).count() == 0
    shards.write_shards(odd.filter("doc_id < 7"), str(tmp_path / "shards"), 10)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 6
    entries = shards.directory(shards.shard(odd, 10)).agg(F.sum("entries"), F.max("depth")).first()
    assert entries[0] <= 2.0 ** entries[1]


# mixing


def test_raked_weights_hold_every_target(spark, table):
    rows = mixing.report(table("documents")).toPandas()
    for m in mixing.MARGINALS:
        goal = rows.groupby(m).tokens.sum() ** mixing.FLATTEN
        got = (rows.tokens * rows.probability).groupby(rows[m]).sum()
        assert np.allclose(got / got.sum(), goal / goal.sum(), rtol=1e-4)
    assert rows.probability.max() == pytest.approx(1) and (rows[rows.probability == 1].sampled).all()


def test_given_targets_and_share(spark, documents):
    docs = documents([(i, "word " * 20) for i in range(4000)]).withColumn("source", F.when(F.col("doc_id") % 4 == 0, "a").otherwise("b")).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y"))
    goal = {
        "source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double"),
        "lang": spark.createDataFrame([("x", 1.0), ("y", 1.0)], "value string, share double"),
        "topic": spark.createDataFrame([("prose", 1.0)], "value string, share double"),
    }
    kept = mixing.mix(docs, goal).toPandas()
    assert list(kept.columns) == docs.columns
    assert abs((kept.source == "a").mean() - 0.5) < 0.05 and abs((kept.lang == "x").mean() - 0.5) < 0.05
    assert abs(mixing.mix(docs, goal, share=0.4).count() / 4000 - 0.4) < 0.05
    assert sorted(mixing.mix(docs, goal).toPandas().doc_id) == sorted(kept.doc_id)


def test_mixing_odd_rows(odd):
    report = mixing.report(odd.withColumn("lang", F.lit(None).cast("string")))
    assert report.count() == len(ODD) and report.filter("lang <> ''").count() == 0
    assert mixing.report(odd.limit(0)).count() == 0 and mixing.mix(odd.limit(0)).columns == odd.columns


def test_mixing_runs_no_python(table):
    plan = mixing.mix(table("documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    plan = shards.shard(table("documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# quality classifier


def test_classifier_on_documents_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    unseen = labels.filter("doc_id % 3 = 0").toPandas()
    found = quality.report(docs, labels.filter("doc_id % 3 <> 0")).toPandas()
    assert len(found) == docs.count()
    both = found.merge(unseen, on="doc_id")
    clean = (both.quality == 1) & (both.toxic == 0)
    assert both[clean].kept.mean() > 0.98
    assert both[both.quality == 0].kept.mean() < 0.06
    assert both[both.toxic == 1].kept.mean() < 0.25


def test_sites_with_few_documents_stay_near_the_whole(spark):
    heads = {t: quality.SILENT for t in quality.TARGETS}
    sure = 4.0
    rows = [("big", "p", sure if i % 2 else -sure, 0.0) for i in range(2000)] + [("good", "p", sure, 0.0) for _ in range(500)] + [("tiny", "p", sure, 0.0)]
    scores = spark.createDataFrame(rows, "host string, path string, sum_quality double, sum_toxic double")
    rate = {r.host: r.rate_quality for r in quality.site_rates(scores, heads).collect()}
    assert abs(rate["big"] - 0.5) < 0.02 and rate["good"] > 0.9 and rate["big"] < rate["tiny"] < rate["good"]


def test_classifier_of_odd_rows_and_without_labels(spark, odd, table):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.report(odd, none).filter("kept").count() == len(ODD)
    kept = quality.keep_good(odd, none)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert quality.report(odd.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 0, None), (4, 1, 0), (4, 0, 1), (7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.report(odd, labels).count() == len(ODD)


# the pipeline


def test_every_stage_acts_on_what_the_last_one_kept(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["good_quality", "near_dedup", "mask_personal_data", "mix_sources", "encode_pieces"]
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(place)))
        docs = spark.read.parquet(str(tmp_path / str(place)))
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if place == 1:
            nodes = linked(list(before.items()), 5)
            assert set(after) == {i for i in before if nodes.find(i) == i}
        if place == 2:
            assert set(after) == set(before) and not any("@mail" in t for t in after.values())
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert sorted(last.doc_id) == sorted(before) and (last.n_pieces == last.ids.map(len)).all()


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    for number, docs in enumerate((odd, odd.limit(0))):
        for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = tmp_path / f"{number}-{place}"
            stage(spark, docs, SF).write.parquet(str(out))
            docs = spark.read.parquet(str(out))


def test_registered_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
