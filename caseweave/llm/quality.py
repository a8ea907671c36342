"""Quality classifier with site priors: hierarchical empirical Bayes.

Evidence of a document: its words (hashed) count with their shrunken log-odds between labelled
classes if they are clearly more frequent in one. A logistic regression over their sum and the bins
of some measures of the text, fitted on held-out labelled documents, makes it a probability. Half of
the labelled sample gives the log-odds, the other half the regression.

Sites: the documents' mean probability is taken per path (host and path column), per host, and over
all. Each level is a beta prior for the next, with a strength found by matching moments, so a site
of few documents stays near its host and a host of few near the whole. The evidence (as a Bayes
factor against the overall rate) is then combined with the posterior rate of the document's path.
There are two such models, quality and toxicity; a document is kept if it is rather good than not
and not rather toxic.

The classifier is fitted on at most ``SAMPLE`` labelled documents, those with the least mixed ids.
Everything else, site rates included, is counted over all documents.

Nulls and odd rows: a null or empty text has the features of an empty text; null host or path are
sites of their own; a null doc_id is scored like any other; a document with several labels counts
with the least of each; without labelled documents of both classes a model says nothing and rejects
nothing. Repeated rows are scored each by themselves; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm import words as W
from caseweave.storage import keep

SAMPLE = 20_000  # labelled documents that the classifier is fitted on, at most
BUCKETS = 1 << 20  # of hashed features
PRIOR = 100.0  # made-up documents at the common rate that shrink a word's log-odds
CLEAR = 6.0  # standard errors that a word's share of one class must differ from what is expected
LEAST = 5  # labelled documents that a word must be in
BINS = 64  # of each measure
MEASURES = 8
TARGETS = ("quality", "toxic")


def _bins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A feature number per text and measure: shares of characters and of repeated words, in steps."""
    n = len(offsets) - 1
    words = W.find_words(data, offsets, W.alphabet(W.SPACES))
    n_words = np.maximum(1, np.bincount(words.doc, minlength=n))
    is_byte = np.zeros((5, 256), bool)
    is_byte[0, list(b"#*$%&|<>")] = True
    is_byte[1, list(b"!?")] = True
    is_byte[2, ord("A") : ord("Z") + 1] = True
    is_byte[3, ord("0") : ord("9") + 1] = True
    is_byte[4, [c for c in range(256) if c not in W.SPACES]] = True
    shares = [W.counts_by_doc(is_byte[k][data], offsets) / n_words for k in range(5)]
    at, gram = W.windows(words, 3)
    gram = W.mix(gram + W.mix(words.doc[at].astype(W.U64)))
    distinct, first = np.unique(gram, return_index=True)
    n_grams = np.bincount(words.doc[at], minlength=n)
    repeated = 1 - np.bincount(words.doc[at][first], minlength=n) / np.maximum(1, n_grams)
    found = W.find_words(data, offsets, W.alphabet(b"\n"))
    _, first_line = np.unique(W.mix(found.hash + W.mix(found.doc.astype(W.U64))), return_index=True)
    n_lines = np.bincount(found.doc, minlength=n)
    repeated_lines = 1 - np.bincount(found.doc[first_line], minlength=n) / np.maximum(1, n_lines)
    steps = [np.minimum(15, 8 * shares[0]), np.minimum(15, 8 * shares[1]), np.minimum(31, 4 * shares[2]), np.minimum(15, 4 * shares[3]), np.minimum(40, 2 * shares[4]), 12 * repeated, 8 * repeated_lines, 3 * np.log10(n_words)]
    return np.stack([np.ceil(s).astype(np.int64) + BINS * k for k, s in enumerate(steps)], axis=1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the slice, bucket) of every word, not yet distinct."""
    words = W.find_words(data, offsets, W.alphabet(W.NOT_ALPHANUMERIC, lower=True))
    return words.doc, (words.hash % W.U64(BUCKETS)).astype(np.int64)


class Head(NamedTuple):
    """One model: words with weights, and the regression over their sum and the measures."""

    places: np.ndarray
    weights: np.ndarray
    curve: np.ndarray  # of the sum, then a constant, then of each bin
    rate: float  # of positive documents in the sample

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.places] = self.weights
        return out

    def odds(self, sums: np.ndarray, bins: np.ndarray) -> np.ndarray:
        return self.curve[0] * sums / 10 + self.curve[1] + self.curve[2 + bins].sum(axis=1)


SILENT = Head(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(2 + MEASURES * BINS), 0.5)


def _sums(data: np.ndarray, offsets: np.ndarray, heads: list[np.ndarray]) -> list[np.ndarray]:
    """Per head, the weights of each text's distinct words, added up."""
    rows, bucket = features(data, offsets)
    some = np.zeros(len(bucket), bool)
    for dense in heads:
        some |= dense[bucket] != 0
    own = np.unique(rows[some] * BUCKETS + bucket[some])
    return [np.bincount(own // BUCKETS, weights=dense[own % BUCKETS], minlength=len(offsets) - 1) for dense in heads]


def _regression(sums: np.ndarray, bins: np.ndarray, label: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression with a ridge (Newton steps) over the sum and the bins that occur."""
    used, place = np.unique(bins, return_inverse=True)
    x = np.zeros((len(sums), 2 + len(used)))
    x[:, 0], x[:, 1] = sums / 10, 1
    x[np.arange(len(sums))[:, None], 2 + place.reshape(bins.shape)] = 1
    w, ridge = np.zeros(x.shape[1]), np.diag([0.01, 0.01, *[penalty] * len(used)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge, x.T @ (label - p) - ridge @ w)
        w += step / max(1.0, float(np.abs(step).max()) / 2)
    out = np.zeros(2 + MEASURES * BINS)
    out[:2], out[2 + used] = w[:2], w[2:]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, Head]:
    """The models of both targets. To the driver come the clear features, at most ``BUCKETS``, and
    the scores of the held-out half of the sample."""
    order = F.xxhash64("doc_id")
    labelled = labels.filter("doc_id is not null").groupBy("doc_id").agg(*(F.min(t).alias(t) for t in TARGETS))
    chosen = labelled.orderBy(order, "doc_id").limit(sample).select("doc_id", *TARGETS, (F.pmod(order, F.lit(2)) == 0).alias("held"))
    chosen = keep(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")  # bounded by ``sample``

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            rows, bucket = features(*W.text_bytes(batch.column("text")))
            own = np.unique(rows * BUCKETS + bucket)
            sides = [pa.array(batch.column(t).take(pa.array(own // BUCKETS))) for t in TARGETS]
            yield pa.RecordBatch.from_arrays([pa.array(own % BUCKETS), *sides], names=["bucket", *TARGETS])

    counted = (
        chosen.filter("not held")
        .select("text", *(F.col(t).cast("int").alias(t) for t in TARGETS))
        .mapInArrow(listed, "bucket long, quality int, toxic int")
        .groupBy("bucket")
        .agg(*(F.count(F.when(F.col(t) == side, 1)).alias(f"{t}_{side}") for t in TARGETS for side in (0, 1)))
    )
    sizes = chosen.filter("not held").agg(*(F.count(F.when(F.col(t) == side, 1)).alias(f"{t}_{side}") for t in TARGETS for side in (0, 1))).first()
    silent = {t for t in TARGETS if not (sizes[f"{t}_0"] and sizes[f"{t}_1"])}

    def odds(t: str) -> tuple[Column, Column]:
        k0, k1, n0, n1 = F.col(f"{t}_0"), F.col(f"{t}_1"), F.lit(float(sizes[f"{t}_0"])), F.lit(float(sizes[f"{t}_1"]))
        prior, expected = PRIOR * (k0 + k1) / (n0 + n1), (k0 + k1) * n1 / (n0 + n1)
        return F.log((k1 + prior) / (n1 + PRIOR)) - F.log((k0 + prior) / (n0 + PRIOR)), (k1 - expected) / F.sqrt(expected * n0 / (n0 + n1))

    heads: dict[str, Head] = {}
    kept = keep(counted, "features")
    for t in TARGETS:
        if t in silent:
            heads[t] = SILENT
            continue
        weight, clear = odds(t)
        often = kept.filter(F.col(f"{t}_0") + F.col(f"{t}_1") >= LEAST)
        rows = often.select("bucket", weight.alias("weight"), clear.alias("clear")).filter(F.abs("clear") >= CLEAR).collect()
        heads[t] = SILENT._replace(places=np.array([r.bucket for r in rows], np.int64), weights=np.array([r.weight for r in rows], np.float32))
    held = _with(chosen.filter("held"), heads, raw=True).drop("text").toPandas()
    for t in TARGETS:
        own = held[held[t].notna()]
        if t not in silent and own[t].nunique() > 1:
            label = (own[t] > 0).to_numpy(float)
            curve = _regression(own[f"sum_{t}"].to_numpy(), np.stack(own["bins"].to_numpy()).astype(np.int64), label)
            heads[t] = heads[t]._replace(curve=curve, rate=float(label.mean()))
        else:
            heads[t] = SILENT
    return heads


def _with(docs: DataFrame, heads: dict[str, Head], raw: bool) -> DataFrame:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = [heads[t].dense() for t in TARGETS]
        for batch in W.pieces(batches):
            data, offsets = W.text_bytes(batch.column("text"))
            sums, bins = _sums(data, offsets, dense), _bins(data, offsets)
            if raw:
                more = [pa.array(list(bins), pa.list_(pa.int64()))]
            else:
                more = []
                sums = [heads[t].odds(s, bins) - np.log(heads[t].rate / (1 - heads[t].rate)) for t, s in zip(TARGETS, sums, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(s, pa.float64()) for s in sums), *more], names=names)

    more = [*(T.StructField(f"sum_{t}", T.DoubleType()) for t in TARGETS), *([T.StructField("bins", T.ArrayType(T.LongType()))] if raw else [])]
    names = [*docs.columns, *(f.name for f in more)]
    return docs.mapInArrow(scored, T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), *more]))


def evidence(docs: DataFrame, heads: dict[str, Head]) -> DataFrame:
    """The documents with a Bayes factor per target (sum_quality, sum_toxic), as log-odds against the overall rate."""
    return _with(docs, heads, raw=False)


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(n: Column, rate: Column, parent: Column) -> Column:
    """Strength of the beta prior that parents are for their children, by moments over the children.

    The spread of the children's rates beyond chance is what they really differ by.
    """
    seen = F.sum(n * (rate - parent) * (rate - parent)) / F.sum(n)
    chance = F.sum(parent * (1 - parent)) / F.sum(n)
    real = F.greatest(seen - chance, F.lit(1e-6))
    mean = F.sum(n * parent) / F.sum(n)
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), mean * (1 - mean) / real - 1))


def site_rates(scores: DataFrame, heads: dict[str, Head]) -> DataFrame:
    """(host, path, rate_quality, rate_toxic): posterior rates of each path. Documents are counted by
    path before the shuffle, so a host with a third of them is a few rows."""
    p = {t: _logistic(F.col(f"sum_{t}") + _logit(F.lit(heads[t].rate))) for t in TARGETS}
    paths = keep(scores.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), *(F.sum(p[t]).alias(t) for t in TARGETS)), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *(F.sum(t).alias(f"host_{t}") for t in TARGETS))
    whole = hosts.agg(F.sum("host_n").alias("n"), *(F.sum(f"host_{t}").alias(t) for t in TARGETS)).first()
    n = whole["n"] or 1.0
    mean = {t: F.lit((whole[t] or 0.0) / n) for t in TARGETS}
    strength = hosts.agg(*(_strength(F.col("host_n"), F.col(f"host_{t}") / F.col("host_n"), mean[t]).alias(t) for t in TARGETS)).first()
    k = {t: F.lit(strength[t] or 1.0) for t in TARGETS}
    hosts = hosts.select("host", *(((F.col(f"host_{t}") + k[t] * mean[t]) / (F.col("host_n") + k[t])).alias(f"prior_{t}") for t in TARGETS))
    joined = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    strength = joined.agg(*(_strength(F.col("n"), F.col(t) / F.col("n"), F.col(f"prior_{t}")).alias(t) for t in TARGETS)).first()
    k = {t: F.lit(strength[t] or 1.0) for t in TARGETS}
    return joined.select("host", "path", *(((F.col(t) + k[t] * F.col(f"prior_{t}")) / (F.col("n") + k[t])).alias(f"rate_{t}") for t in TARGETS))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """The documents with p_quality, p_toxic and kept in a struct ``verdict``; all columns stay."""
    heads = fit(docs, labels, sample)
    scores = evidence(docs.select("text", F.col(host).alias("host"), F.col(path).alias("path")), heads).drop("text")
    rates = keep(site_rates(scores, heads), "rates")
    scored = evidence(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text"), F.col(host).alias("host"), F.col(path).alias("path")), heads)
    joined = scored.join(rates, scored["host"].eqNullSafe(rates["host"]) & scored["path"].eqNullSafe(rates["path"]), "left")
    p = {t: _logistic(F.col(f"sum_{t}") + _logit(F.coalesce(f"rate_{t}", F.lit(heads[t].rate)))) for t in TARGETS}
    good, bad = p["quality"], p["toxic"]
    if heads["quality"] is SILENT:
        good = F.lit(1.0)
    if heads["toxic"] is SILENT:
        bad = F.lit(0.0)
    verdict = F.struct(good.alias("p_quality"), bad.alias("p_toxic"), ((good >= 0.5) & (bad < 0.5)).alias("kept"), F.col("rate_quality").alias("site_quality"))
    return joined.select("doc", verdict.alias("verdict"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, p_quality, p_toxic, the site's rate, kept."""
    return classify(docs.select("doc_id", "text", "source", "lang"), labels).select("doc.doc_id", "verdict.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with the columns they came with."""
    return classify(docs, labels).filter("verdict.kept").select("doc.*")
