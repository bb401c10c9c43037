"""URL filters: rules by host and path, and a classifier of segmented hosts for all other pages.

Names in hosts are run together (``weatherreport``). A unigram model of the words on the pages splits them:
of all ways to cut a name, Viterbi search takes the most probable one. Multinomial naive Bayes over the
words of host and path then judges the pages that no rule decides; it learns from those that a rule decides.

Nothing is looked up in a whole vocabulary: the substrings of the distinct names are joined to the word
counts, and distinct hosts and path forms are scored, not pages, so a frequent host is one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, durable

#: Letters of the longest word that a name is split into; host labels have 63 at most, longer ones are cut there.
LONGEST, LABEL = 24, 63
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
#: Scores closer to 0 than this are ties.
TIE = 1e-9


class Rule(NamedTuple):
    verdict: str
    pattern: str  # host, a slash, the start of the path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host and path; both empty for a url that is null or has no ``://``."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(whole, pattern, 1), UPPER, LOWER)
    return host, F.regexp_extract(whole, pattern, 2)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (host and path given) that fits, as a struct of pattern and verdict; null if none does."""
    found = F.lit(None).cast("struct<pattern:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        name, slash, rest = r.pattern.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _pieces(text: Column) -> Column:
    """Maximal runs of a-z and of digits."""
    return F.regexp_extract_all(text, F.lit("[a-z]+|[0-9]+"), F.lit(0))


def word_counts(pages: DataFrame, html: str) -> DataFrame:
    """``word, n`` of the lower-case ASCII words outside the tags of all pages, up to ``LONGEST`` letters."""
    seen = F.translate(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "<[^>]*>", " "), UPPER, LOWER)
    one = pages.select(F.explode(F.split(F.regexp_replace(seen, "[^a-z]+", " "), " ")).alias("word"))
    return one.where(F.length("word").between(1, LONGEST)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable cut of a name into words; of equal ones that with the longest last word, and so on.

    A string that is no word counts as one that occurs 1 / 10 ** length times.
    """
    best, back = [0.0], [0]
    log_total = math.log(max(total, 1))
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(name[start:end], 0)
            cost = math.log(n) if n else -math.log(10) * (end - start)
            options.append((round(best[start] + cost - log_total, 9), -start))
        score, start = max(options)
        best.append(score)
        back.append(-start)
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name, words`` of distinct names of letters, split by the counts of words."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    start = F.explode(F.expr("sequence(1, length(name))")).alias("s")
    subs = names.select("name", start).select("name", "s", F.explode(
        F.expr(f"sequence(1, least({LONGEST}, length(name) - s + 1))")).alias("len"))
    subs = subs.select("name", F.expr("substring(name, s, len)").alias("word")).distinct()
    known = subs.join(counts, "word").groupBy("name").agg(F.map_from_entries(F.collect_set(F.struct("word", "n"))).alias("known"))
    rows = names.join(known, "name", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [viterbi(n, dict(k or ()), total) for n, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(split, pa.list_(pa.string()))], ["name", "words"])

    return rows.select("name", "known").mapInArrow(run, "name string, words array<string>")


def host_tokens(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``host, tokens``: the words of every piece of a host; a number is one token whatever its digits."""
    each = hosts.select("host", F.posexplode(_pieces(F.col("host"))).alias("pos", "piece"))
    each = each.withColumn("piece", F.substring("piece", 1, LABEL))
    names = each.where("piece rlike '^[a-z]'").select(F.col("piece").alias("name")).distinct()
    split = segmented(durable(names), counts)
    words = each.join(split, each["piece"] == split["name"], "left").select(
        "host", "pos", F.coalesce("words", F.array(F.lit("0"))).alias("words"))
    ordered = words.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("w"))
    return ordered.select("host", F.transform(F.flatten("w.words"), lambda w: F.concat(F.lit("h:"), w)).alias("tokens"))


def path_tokens(path: Column) -> Column:
    """Tokens of a path: its lower-case pieces of letters; a number is one token whatever its digits."""
    return F.transform(_pieces(F.translate(path, UPPER, LOWER)), lambda w: F.concat(
        F.lit("p:"), F.when(w.rlike("^[0-9]"), "0").otherwise(F.substring(w, 1, LABEL))))


def weights(rows: DataFrame) -> DataFrame:
    """``token, weight`` from rows of ``tokens, verdict, n``: the log of the odds of block, with add-one smoothing."""
    by_token = durable(rows.select(F.explode("tokens").alias("token"), "verdict", "n").groupBy("token").agg(*[
        F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)).cast("double").alias(v) for v in (ALLOW, BLOCK)]))
    size, *seen = by_token.agg(F.count(F.lit(1)), F.sum(ALLOW), F.sum(BLOCK)).first()
    allow, block = ((F.col(v) + 1) / F.lit((n or 0) + size + 1) for v, n in zip((ALLOW, BLOCK), seen))
    return by_token.select("token", F.log(block / allow).alias("weight"))


def _scores(rows: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """``key, score`` of rows ``key, tokens``; tokens never seen in a decided page have no weight."""
    each = rows.select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    return each.join(model, "token").groupBy(key).agg(F.sum(F.col("n") * F.col("weight")).alias("score"))


def judge(pages: DataFrame, rules: Iterable[Rule], url: str = "url", html: str = "html", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``row`` (struct of ``keep``), ``host, path, rule, verdict`` and ``score`` of every row.

    A rule's verdict stands. Other pages are blocked if block is the more probable by naive Bayes: ``score``, the
    log of the odds, is above 0; it is null where a rule decides. Without decided pages, or in a tie, a page is
    allowed. Null urls and such without ``://`` have empty host and path, no rule, and a score of the
    frequencies of verdicts alone. Null html has no words. Rows are judged one by one, so repeated rows repeat;
    other columns are ignored; an empty table gives no rows.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.struct(*keep).alias("row"), host.alias("host"), path.alias("path"))
    rows = durable(rows.withColumn("by", rule_of(F.col("host"), F.col("path"), list(rules))).withColumn(
        "form", path_tokens(F.col("path"))).select("row", "host", "path", "by", F.array_join("form", "/").alias("form")))
    hosts = durable(host_tokens(rows.select("host").distinct(), durable(word_counts(pages, html))))
    forms = durable(rows.select("form").distinct()).withColumn("tokens", F.filter(F.split("form", "/"), lambda t: t != ""))

    decided = rows.where("by is not null")
    votes = durable(decided.groupBy("host", "form", F.col("by.verdict").alias("verdict")).agg(F.count(F.lit(1)).alias("n")))
    by_host = votes.groupBy("host", "verdict").agg(F.sum("n").alias("n")).join(hosts, "host").select("tokens", "verdict", "n")
    by_form = votes.groupBy("form", "verdict").agg(F.sum("n").alias("n")).join(forms, "form").select("tokens", "verdict", "n")
    model = bounded(durable(weights(by_host.unionByName(by_form))))
    seen = votes.agg(*[F.sum(F.when(F.col("verdict") == v, F.col("n"))) for v in (ALLOW, BLOCK)]).first()
    prior = math.log((seen[1] or 0) + 1) - math.log((seen[0] or 0) + 1)

    of_host = bounded(durable(_scores(hosts, "host", model).withColumnRenamed("score", "host_score")))
    of_form = bounded(durable(_scores(forms, "form", model).withColumnRenamed("score", "form_score")))
    scored = rows.join(of_host, "host", "left").join(of_form, "form", "left")
    score = F.when(F.col("by").isNull(), F.round(F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("form_score", F.lit(0.0)), 9))
    return scored.select(
        "row", "host", "path", F.col("by.pattern").alias("rule"),
        F.coalesce("by.verdict", F.when(score > TIE, BLOCK).otherwise(ALLOW)).alias("verdict"), score.alias("score"))
