"""Quality rules as a ledger of failure bits, with versioned policies and ablations (built-in functions only).

Every rule is evaluated once per document. Its verdict is one bit of ``fail_bits``; the measured
values stay beside it. A policy is a named bit mask: applying one, comparing two or leaving a rule
out are bitwise operations on the ledger and read no text again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_free, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``failed`` is an expression over the measurement columns; ``bit`` never changes once given."""

    name: str
    bit: int
    failed: Callable[[], Column]


#: The rules in order of their bits. Comparisons are whole-number arithmetic, so any engine agrees.
RULES = (
    Rule("few_words", 0, lambda: F.col("n_words") < 50),
    Rule("repeated_phrases", 1, lambda: F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
    Rule("symbols", 2, lambda: F.col("n_symbols") * 100 > F.col("word_chars") * 10),
    Rule("repeated_lines", 3, lambda: F.col("n_dup_lines") * 100 > F.col("n_lines") * 50),
    Rule("short_words", 4, lambda: F.col("word_chars") < F.col("n_words") * 2),
    Rule("long_words", 5, lambda: F.col("word_chars") > F.col("n_words") * 40),
)


def mask_of(*names: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


#: Policies by version: the rules whose failure rejects a document.
POLICIES: Mapping[str, int] = {
    "base": mask_of("few_words", "repeated_phrases"),
    "v1": mask_of("few_words", "repeated_phrases", "symbols"),
    "v2": mask_of(*(r.name for r in RULES)),
}
CURRENT = "v2"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression, so that no optimiser step computes it per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(w: Column) -> Column:
    """Words inside a window of three words that occurs twice or more in the array ``w``.

    The windows are sorted with their positions, so the cost is n log n. Documents without any
    repeated window, found by a set, skip the sort.
    """

    def windows(v: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(v) - 2),
            lambda i: F.concat_ws(" ", F.element_at(v, i), F.element_at(v, i + 1), F.element_at(v, i + 2)),
        )

    def covered(win: Column) -> Column:
        pairs = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            n = F.size(s)
            same = F.filter(
                F.sequence(F.lit(1), n),
                lambda j: ((j > 1) & (F.get(s, j - 2)["x"] == F.get(s, j - 1)["x"]))
                | ((j < n) & (F.get(s, j)["x"] == F.get(s, j - 1)["x"])),
            )
            return F.array_sort(F.transform(same, lambda j: F.get(s, j - 1)["i"]))

        def length(p: Column) -> Column:
            """Positions are ascending; each window adds up to three words not covered before."""
            gaps = F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, k - 1))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return let(let(pairs, repeated), length)

    def count(v: Column) -> Column:
        found = let(windows(v), lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long"))
                    .otherwise(covered(win)))
        return F.when(F.size(v) < 4, F.lit(0).cast("long")).otherwise(found)

    return count(w)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and one struct ``_m`` of measurements, taken in one pass over the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(blank_free(x)) > 0)
    symbols = F.length(body) - F.length(F.translate(body, SYMBOLS, ""))

    def gather(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(blank_free(F.col(text))).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    return docs.withColumn("_m", let(words(F.col(text)), gather))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: the ``keep`` columns, the measurements and ``fail_bits``.

    Null and empty texts have zero words and fail ``few_words``. Rows are never merged, so repeated
    rows and ids give repeated ledger rows. Columns of ``docs`` that are not in ``keep`` are ignored,
    whatever their names.
    """
    taken = docs.select(F.struct(*keep).alias("_keep"), F.col(text).alias("_text"))
    rows = measure(taken, "_text").select("_keep", "_m.*")
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.failed(), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("fail_bits", bits)
    return rows.select("_keep.*", *[c for c in rows.columns if c != "_keep"])


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """``base_failed`` and ``kept`` of a ledger under a policy; a document failing a base rule is never kept."""
    base, mask = POLICIES["base"], POLICIES[version] | POLICIES["base"]
    return rows.withColumns({
        "base_failed": F.col("fail_bits").bitwiseAND(F.lit(base)) != 0,
        "kept": F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0,
        "policy": F.lit(version),
    })


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents failing it, rejected by it alone, and kept if it were left out.

    The ledger is first counted by its bits (at most 2 ** rules rows); all else is bitwise work on those.
    """
    mask = POLICIES[version]
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("one")) for r in RULES if mask >> r.bit & 1
    ])).alias("r")
    return (
        counts.select("bits", "n", rule).groupBy(F.col("r.rule").alias("rule")).agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.one")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.one"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.one"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


SQL = """WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
g AS (
  SELECT doc_id, t, w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
         list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS win
  FROM w),
pos AS (SELECT doc_id, unnest(range(1, len(win) + 1)) AS i, unnest(win) AS x FROM g),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM pos) WHERE n > 1),
cover AS (
  SELECT doc_id, CAST(sum(least(3, i - coalesce(before, i - 3))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hits) GROUP BY doc_id),
m AS (
  SELECT g.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
  FROM g LEFT JOIN cover ON g.doc_id = cover.doc_id),
b AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (n_repeat_words * 100 > n_words * 50)::INT
    + 4 * (n_symbols * 100 > word_chars * 10)::INT + 8 * (n_dup_lines * 100 > n_lines * 50)::INT
    + 16 * (word_chars < n_words * 2)::INT + 32 * (word_chars > n_words * 40)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, fail_bits,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, 'v2' AS policy FROM b"""
