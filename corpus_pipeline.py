"""A corpus pipeline of five of the corpus operators; each stage's result is written and read again as the next one's input."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, exact_dedup, jaccard, mixing, quality
from pulsegrid.llm.common import cut, documents, drop_cut, n_words, release, scope


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labelled documents among them.

    Null text is scored like empty text; without labels of both kinds every score is 0.5 and no document is accepted; an input
    column `score` is carried like any other.
    """
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    kept = quality.scored(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text")), model)
    return kept.filter(F.col("score") >= quality.THRESHOLD).select("row.*")


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z the one with the largest id; null text counts as empty."""
    return exact_dedup.keep_one(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard of 0.8 or more over five-word shingles the one with the smallest id.

    Documents without words or without id stay.
    """
    return jaccard.keep_one(docs, k=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them; those that it takes no word of (empty ones too) go.

    `position`, the training time from 0 to 1, is a further column (in place of an input column of that name): files read again
    don't keep the order of their rows.
    """
    sized = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), n_words(docs["text"]).alias("size"))
    placed = mixing.stream(mixing.mix(sized))
    return placed.select(*[F.col("row.doc")[c].alias(c) for c in docs.columns if c != "position"], "position")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (at its training position, where there is one), with digests of the ids and of what they decode to; null text has none."""
    return bpe.encode(docs, carry=[c for c in ["position"] if c in docs.columns])


#: Scratch tables of the stages that have ended.
_spent: list[str] = []


def staged(work):
    """A stage's function.  When it begins its predecessor's result is written, so the scratch tables behind that go, but for what docs itself reads."""

    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_spent, docs)
        with scope(_spent):
            return work(spark, docs, sf_dir)

    return stage


STAGES = [(name, staged(work)) for name, work in (("quality", good), ("exact dedup", unique), ("near dedup", distinct), ("mixing", mixture), ("tokens", tokens))]

#: Learned scores, hash orders and token ranks are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's input goes when its result is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
            if before is not None:
                drop_cut(before)
            before = docs
    return docs
