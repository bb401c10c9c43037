"""A training corpus from raw documents: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, ngram_join, quality_rules, secret_scan, sentencepiece_bpe
from tallyforge.llm.common import Tables, bounded, drop, durable, table
from tallyforge.llm.queries import PIECES


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps."""
    rows = quality_rules.ledger(docs.select(F.struct("*").alias("row"), "text"), keep=("row",))
    return quality_rules.apply_policy(rows).where("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at 0.8: the one with the smallest doc_id.

    Documents without doc_id cannot be compared and stay. Rows with the same doc_id stay or go together;
    of those with the same text, too, the one with the smallest other columns stays.
    """
    with Tables() as used:
        groups = ngram_join.similar_components(docs, n=5, percent=80, tables=used).where("doc_id is not null")
        ids = groups.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
        # All ids but those of a single row that stays: few beside the documents.
        special = durable(ids.where("n > 1 OR NOT first"))
    known = docs.where("doc_id is not null")
    single = known.join(bounded(special.select("doc_id")), "doc_id", "left_anti")
    again = bounded(special.where("first").select("doc_id"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    several = known.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(
        F.min(F.struct(*others)).alias("o")).select("doc_id", "text", "o.*")
    return single.select(*docs.columns).unionByName(several.select(*docs.columns)).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; owner-specific secrets in their texts are replaced."""
    return secret_scan.redact(docs, owner="source", repository=F.concat_ws("/", "source", "lang"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the ids of its text."""
    return sentencepiece_bpe.encode(docs, PIECES, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", encoding),
]

#: Tokenising by a given vocabulary cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        kept = durable(stage(spark, docs, sf_dir))
        if i:
            drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
