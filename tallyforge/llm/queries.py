"""The operators as queries over the shared tables, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    decontaminate,
    language_id,
    ngram_join,
    periodic_runs,
    pii,
    quality_rules,
    secret_scan,
    sentencepiece_bpe,
    suffix_dedup,
    token_counts,
    url_filter,
    whitening,
)
from .common import table, words

#: Where the vocabulary files of public tokenizers are; the same place on every machine.
TOKENIZERS = "/opt/tokenizers"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: Only the test tables are named by this key; real data needs a secret one.
PII_KEY = b"surrogates of the shared tables"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Digests and sizes follow from the turns; each turn costs its escaped text and 14 template characters.
CHAT_SQL = r"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' FROM range(2) r(i)),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         length(regexp_replace(role, '\\|###|</turn>|: ', '\\\0', 'g'))
         + length(regexp_replace(text, '\\|###|</turn>|: ', '\\\0', 'g')) + 15 AS size FROM t),
r AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1 AS final FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR final THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR final) AS n_examples
FROM r GROUP BY conv_id"""


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(docs.where(~out))
    return language_id.predict(docs.select("doc_id", out.alias("held_out"), "text"), model, keep=("doc_id", "held_out"))


@query("op7_quality_rules", quality_rules.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))


@query("op1_pii_surrogates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), RANKS, fields=("source", "text"))


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), PIECES)


@query("op5_suffix_array_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


@query("op8_benchmark_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_secret_scan", secret_scan.sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"), owner="source", repository=F.concat_ws("/", "source", "lang"))


@query("op10_chat_formatting", CHAT_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.expand(turns))


def recurring(docs: DataFrame) -> DataFrame:
    """The documents; in one of ten, by id, the words from a point on repeat with a period that the id gives.

    A null doc_id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    w, g = F.col("_words"), F.expr("_hash div 10")
    start = F.col("_start")
    period = 1 + F.expr("(_n - _start) div (3 + (_hash div 10) % 8)")
    moved = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get(
        w, F.when(i < start, i).otherwise(start + (i - start) % period).cast("int")))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    rows = docs.select("doc_id", "text", h.alias("_hash"), F.when(chosen, words(F.col("text"))).alias("_words"))
    rows = rows.withColumn("_n", F.size("_words").cast("long")).withColumn("_start", F.when(F.col("_n") > 0, g % F.col("_n")))
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(recurring(table(spark, sf_dir, "documents")))


#: The rules for the shared table of pages.
RULES = tuple(url_filter.Rule(*r) for r in (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")))


@query("op12_url_filter")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(spark, sf_dir, "pages"), RULES)
    return found.select("row.page_id", "host", "path", "rule", "verdict", "score")


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
