"""What the operators must not leave out: rare values, repeated and null ids, special strings."""

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from caseweave.llm import mixing, pii, queries, shards, vectors
from caseweave.storage import keep

from .conftest import ODD


# mixing


def one_rare_row_in_a_large_corpus(spark, n):
    """(source, lang, topic, tokens): cells of n tokens in all, and one token with neither source nor lang."""
    cells = [(f"s{i}", f"l{j}", "prose", n * (i + 1) * (j + 1) / 60.0) for i in range(4) for j in range(3)]
    return spark.createDataFrame([*cells, ("", "", "prose", 1.0)], "source string, lang string, topic string, tokens double")


def test_one_rare_value_does_not_set_the_rate_of_a_large_corpus(spark):
    def kept(cells):
        cells = keep(cells, "cells")
        rows = mixing.probabilities(mixing.rake(cells, mixing.flattened(cells, 0.9), sweeps=2), hold=False).toPandas()
        assert rows.probability.between(0, 1).all()
        return (rows.tokens * rows.probability).sum() / rows.tokens.sum(), rows[rows.source == ""].probability.tolist()

    plain, _ = kept(one_rare_row_in_a_large_corpus(spark, 1e6).filter("source <> ''"))
    share, rare = kept(one_rare_row_in_a_large_corpus(spark, 1e10))
    assert share == pytest.approx(plain, rel=0.01) and rare == [1.0]


def test_no_lift_sets_a_rate_under_a_half(spark):
    cells = spark.createDataFrame([("a", "x", "t", 900.0, 500.0), ("b", "x", "t", 100.0, 500.0)], "source string, lang string, topic string, tokens double, weight double")
    found = {r.source: r.probability for r in mixing.probabilities(cells, hold=False).collect()}
    assert found["b"] == 1.0 and found["a"] == pytest.approx(5 / 9 / mixing.MOST_LIFT)
    held = {r.source: r.probability for r in mixing.probabilities(cells).collect()}
    assert held["b"] == 1.0 and held["a"] == pytest.approx(1 / 9)


def test_contradicting_targets_are_told(spark, caplog):
    cells = spark.createDataFrame([("a", "x", "t", 90.0), ("", "", "t", 10.0)], "source string, lang string, topic string, tokens double")
    goal = lambda **shares: spark.createDataFrame([(v.strip("_"), x) for v, x in shares.items()], "value string, share double")
    rows = mixing.rake(cells, {"source": goal(a=0.5, _=0.5), "lang": goal(x=0.8, _=0.2), "topic": goal(t=1.0)}, sweeps=2).toPandas()
    assert "source 0.6, lang" in caplog.text and rows.weight.sum() == pytest.approx(100)


# shards


def test_written_shards_hold_all_rows_within_the_limit(spark, documents, tmp_path):
    rows = [*ODD, *[(7, "x" * 100)] * 40, *[(None, "y" * 90)] * 40]
    shards.write_shards(documents(rows), str(tmp_path / "shards"), 500)
    written = spark.read.parquet(str(tmp_path / "shards"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in written.collect()), key=key) == sorted(rows, key=key)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    over = written.groupBy(F.regexp_extract(F.input_file_name(), "_shard=([^/]*)", 1)).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).filter("bytes > 500 and n > 1")
    assert over.count() == 0 and set(written.columns) == {*documents(ODD).columns, "_shard"}


# token files


def test_special_strings_are_ids_of_their_own(spark, documents, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    mark = "<|endoftext|>"
    texts = ["x <|endoftext|> y", "x  <|endoftext|>  y", " <|endoftext|>", "a\n <|endoftext|><|endoftext|> b c", "<|endof text|>", *(f" w{i}{mark} v{i}" for i in range(20))]
    monkeypatch.setattr(queries, "table", lambda *_: documents(list(enumerate(texts))))
    found = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in queries.op2_token_files(spark, "").collect()}
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert found[i] == (len(ids), zlib.crc32(ids.tobytes()))
        assert (50256 in ids) == (mark in text)


# the pipeline


def test_copies_without_an_id_go_and_a_clean_text_with_a_shared_id_stays(spark, documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c), (None, "d e f g h i j"), (None, "d e f g h i j"), (None, None), (None, None)]
    found = corpus_pipeline.near_dedup(spark, documents(rows), "")
    assert found.columns == documents(rows).columns
    wanted = [(1, a), (2, b), (3, c), (None, "d e f g h i j"), (None, None), (None, None)]
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter(wanted)


def test_the_last_stage_decodes_what_it_encodes(spark, documents):
    rows = [*ODD, (9, "x▁y  é")]
    found = corpus_pipeline.encode_pieces(spark, documents(rows), "").toPandas()
    assert len(found) == len(rows) and found.round_trip.all()


# vectors


def test_tables_miss_no_more_than_stated_in_few_dimensions():
    rng = np.random.default_rng(3)
    bits, tables = vectors.shape_of_tables(1_500_000)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, 20000, 16)))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    keys = [np.stack(next(vectors._described(bits, tables)([pd.DataFrame({"v": list(x), "dim": 16})]))["keys"]) for x in (a, b)]
    assert (keys[0] != keys[1]).all(1).mean() < 2 * vectors.MISS


# personal data


def test_parts_of_an_address_may_begin_with_many_zeros():
    text = "at 00000000000000000000001.2.3.4 or 256.1.1.1 or 1.2.3." + "9" * 5000 + " or 0.0.0." + "0" * 5000
    spans = pii.base_spans(text)
    assert [s for s in spans if s[0] == "ip"] == [("ip", 3, 32), ("ip", text.index("0.0.0."), len(text))]
    assert all(pii._votes(text, *s) for s in spans)


def test_encoding_and_decoding_are_not_in_one_task(spark):
    """Two Python workers of one task hold the model and their batches at the same time."""
    docs = spark.createDataFrame([(1, "A text.", "web", "en", 7), (None, None, None, None, None)], "doc_id long, text string, source string, lang string, n_chars long")
    out = corpus_pipeline.encode_pieces(spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r["round_trip"], r["n_pieces"] > 0) for r in out.collect()) == [(True, False), (True, True)]


def test_decoding_does_not_carry_texts(spark):
    """Whole texts beside the ids took the memory of an executor; what is compared is a digest."""
    docs = spark.createDataFrame([(1, "a▁b c", "s", "en", 5), (2, None, "s", "en", 0)], "doc_id long, text string, source string, lang string, n_chars long")
    out = corpus_pipeline.encode_pieces(spark, docs, "")
    read = out._jdf.queryExecution().analyzed().collectLeaves().head().output().mkString(",")
    assert "ids#" in read and "digest#" in read and "text#" not in read
    assert {r["doc_id"]: r["round_trip"] for r in out.collect()} == {1: True, 2: True}
