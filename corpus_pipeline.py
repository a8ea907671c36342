"""The corpus pipeline: five stages over ``documents``, each by one operator.

Every stage takes what the one before it kept, written as Parquet and read again, and its decisions
take effect: low-quality and toxic documents go, one document of each group of near copies stays,
personal data is masked in the texts, sources are sampled to their target weights, and what is left
becomes SentencePiece ids, which are decoded again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import mixing, neardup, pii, quality, sentencepiece
from caseweave.llm.graph import marked
from caseweave.storage import keep, shared_folder

SHINGLE_WORDS = 5  # near copies share 80 of 100 shingles of five words
FLATTEN = 0.95  # target shares are present shares to this power: mild, so that most documents stay
MODEL = "piece_bpe_32k.model"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the row with the least id of each group of near copies stays.

    Rows are numbered in a table written once, so repeated ids are rows of their own and rows without
    an id are in groups, in which one with an id comes first. Rows without words belong to no group
    and stay.
    """
    place = f"place_{uuid.uuid4().hex[:8]}"
    rows = keep(docs.withColumn(place, F.monotonically_increasing_id()), "numbered")
    found = neardup.near_duplicates(rows.select(F.col(place).alias("doc_id"), "text"), k=SHINGLE_WORDS)
    found = keep(found.select(F.col("doc_id").alias(place), "component_id"), "found")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", place)).alias("first")
    stays = found.join(rows.select(place, "doc_id"), place).groupBy("component_id").agg(first).select(F.col(f"first.{place}"))
    gone = keep(found.select(place).join(stays, place, "left_anti"), "gone")
    return marked(rows, F.col(place), gone, f"{place}_gone").filter(~F.col(f"{place}_gone")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: spans of personal data are replaced by their kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents are sampled so that sources, languages and topics have their target weights."""
    return mixing.mix(docs, power=FLATTEN)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: (doc_id, source, lang, n_chars, n_pieces, ids, round_trip) of the masked texts.

    The ids are decoded again; round_trip says whether that gives the text, by the SHA-256 of both, so that decoding does
    not carry the texts along. The ids are written in between, so that a task has one Python worker at a time and not one
    for each direction.
    """
    path = public_tokenizers.path(MODEL)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    wanted = digest(F.replace(F.coalesce("text", F.lit("")), F.lit(sentencepiece.MARK), F.lit(" ")))
    encoded = sentencepiece.encode(docs.select("doc_id", "text", "source", "lang", "n_chars", wanted.alias("digest")), path)
    both = sentencepiece.decode(keep(encoded.drop("text"), "encoded"), path)
    round_trip = digest(F.col("decoded")) == F.col("digest")
    return both.select("doc_id", "source", "lang", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "ids", round_trip.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", near_dedup),
    ("PII", mask_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL has neither the trained models nor the hashes of the stages; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            out.write.parquet(f"{folder}/{place}")
            out = spark.read.parquet(f"{folder}/{place}")
        docs = out
    return docs
