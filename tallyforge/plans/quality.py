"""Reconciliation checks: violations as rows, graded against a register."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import join_null_safe, ordered_lag, top_by_group
from ..session import cut_lineage

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"
SAMPLES = 8


@dataclass
class Check:
    """``subjects``: one row ``n`` per scope; ``violations``: scope, subject, detail.

    ``scope`` columns (an election id, or none) keep many data sets in one job.
    ``allow`` says whether registered discrepancies turn a failure into a warning.
    """

    check_id: str
    category: str
    title: str
    subjects: DataFrame
    violations: DataFrame
    allow: bool = True


@dataclass
class RowCheck(Check):
    """A predicate over ``rows``; ``grade`` evaluates all predicates over the same rows in one scan."""

    rows: DataFrame = None
    subject: Column = None
    detail: Column = None
    ok: Column = None
    per_row: int = 1


def row_check(
    check_id: str, category: str, title: str, rows: DataFrame, subject: Column, ok: Column, detail: Column,
    scope: Sequence[str] = (), per_row: int = 1, allow: bool = True,
) -> RowCheck:
    """A predicate that must hold on every row; null counts as broken."""
    subject, detail, ok = subject.cast("string"), detail.cast("string"), F.coalesce(ok, F.lit(False))
    bad = rows.where(~ok).select(*scope, subject.alias("subject"), detail.alias("detail"))
    return RowCheck(
        check_id, category, title, count_subjects(rows, scope, per_row), bad, allow, rows, subject, detail, ok, per_row)


def count_subjects(rows: DataFrame, scope: Sequence[str] = (), per_row: int = 1) -> DataFrame:
    return rows.groupBy(*scope).agg((F.count(F.lit(1)) * per_row).alias("n"))


META = ["check_id", "category", "title", "allow"]


def _meta(c: Check) -> list[Column]:
    return [F.lit(getattr(c, m)).alias(m) for m in META]


def _outcome(c: Check, subject: Column, detail: Column, n: Column, bad: Column) -> Column:
    return F.struct(
        *_meta(c), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"),
        n.cast("bigint").alias("n"), bad.cast("bigint").alias("bad"))


def outcomes(checks: Sequence[Check], scope: Sequence[str] = ()) -> DataFrame:
    """Rows (scope, check, subject, detail, n subjects, bad violations) of all checks.

    All row checks over one DataFrame share a scan: a row emits an array with one outcome
    per check. Outcomes that hold carry no subject, so that they add up to a single row per task.
    """
    none = F.lit(None).cast("string")
    by_rows: dict[int, list[RowCheck]] = {}
    parts = []
    for c in checks:
        if isinstance(c, RowCheck):
            by_rows.setdefault(id(c.rows), []).append(c)
        else:
            parts.append(c.subjects.select(*scope, _outcome(c, none, none, F.col("n"), F.lit(0)).alias("__x")))
            parts.append(c.violations.select(
                *scope, _outcome(c, F.col("subject"), F.col("detail"), F.lit(0), F.lit(1)).alias("__x")))
    for same in by_rows.values():
        parts.append(same[0].rows.select(*scope, F.explode(F.array(*[
            _outcome(c, F.when(~c.ok, c.subject), F.when(~c.ok, c.detail), F.lit(c.per_row), (~c.ok).cast("int"))
            for c in same])).alias("__x")))
    if not scope:
        # A check without any row is still reported.
        spark = parts[0].sparkSession
        parts.append(spark.range(1).select(F.explode(F.array(*[_outcome(c, none, none, F.lit(0), F.lit(0)) for c in checks])).alias("__x")))
    return reduce(DataFrame.unionByName, parts).select(*scope, "__x.*")


def grade(
    checks: Sequence[Check], register: DataFrame | None = None, scope: Sequence[str] = (), samples: int = SAMPLES
) -> DataFrame:
    """One row per (scope, check): status, subjects, failures, known, first samples.

    FAIL when a violation is not registered, WARN when all of them are, else PASS. One
    aggregate over the outcomes of all checks leaves a row per check and a row per distinct
    violation; it is written, and counts and first samples are taken from it.
    """
    scope = list(scope)
    keys = [*scope, "check_id", "category", "title"]
    found = cut_lineage(outcomes(checks, scope).groupBy(*scope, *META, "subject", "detail").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    if register is not None:
        known = register.select(
            *[c for c in scope if c in register.columns], "check_id", "subject", F.lit(True).alias("__known")
        ).distinct()
        found = join_null_safe(found, known, [c for c in known.columns if c != "__known"], "left")
    else:
        found = found.withColumn("__known", F.lit(None).cast("boolean"))
    found = found.withColumn("known", F.coalesce("__known", F.lit(False)) & F.col("allow")).drop("__known")
    counts = found.groupBy(*keys).agg(
        F.sum("n").alias("subject_count"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("bad"))).alias("fail_count"),
        F.sum(F.when(F.col("known"), F.col("bad")).otherwise(0)).alias("known_count"))
    wrong = found.where("NOT known AND bad > 0")
    first = top_by_group(wrong, keys, [F.col("subject"), F.col("detail")], samples, ["subject", "detail"], "__no")
    # A violation that occurs several times is named so often.
    named = F.struct("__no", F.array_repeat("subject", F.least("bad", F.lit(samples)).cast("int")).alias("s"))
    listed = F.flatten(F.transform(F.sort_array(F.collect_list(named)), lambda x: x["s"]))
    first = first.groupBy(*keys).agg(F.array_join(F.slice(listed, 1, samples), "; ").alias("samples"))
    fails, knowns = F.col("fail_count"), F.col("known_count")
    return join_null_safe(counts, first, keys, "left").select(
        *keys,
        F.when(fails > 0, FAIL).when(knowns > 0, WARN).otherwise(PASS).alias("status"),
        "subject_count", "fail_count", "known_count", F.coalesce("samples", F.lit("")).alias("samples"),
    )


def verdict(graded: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Overall status per scope: fails on any failing check."""
    return graded.groupBy(*scope).agg(
        F.when(F.bool_or(F.col("status") == FAIL), FAIL)
        .when(F.bool_or(F.col("status") == WARN), WARN)
        .otherwise(PASS)
        .alias("verdict"),
        F.count(F.lit(1)).alias("checks"),
    )


def close(a: Column, b: Column, tol) -> Column:
    """Within ``tol``; two nulls are equal, one null is not."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= F.lit(tol))


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


STRICT, NULL_IS_ZERO, PRINTED = "strict", "null_is_zero", "printed"


def reconcile(
    computed: DataFrame, published: DataFrame, keys: Sequence[str], value: str = "value",
    policy: str = STRICT, shortfall: bool = False, how: str = "full_outer",
) -> DataFrame:
    """Two keyed totals side by side with ``ok``.

    ``strict``: a missing side is a difference. ``null_is_zero``: a missing side counts
    as zero. ``printed``: published keys must match, a published blank or a key
    that was never published requires zero. With ``shortfall`` the published total
    may exceed the computed one by less than 1 (fractions cut off in print).

    Both sides should already be aggregated to one row per key.
    """
    keys = list(keys)
    left = computed.select(*keys, F.col(value).alias("computed"), F.lit(True).alias("in_computed"))
    right = published.select(*keys, F.col(value).alias("published"), F.lit(True).alias("in_published"))
    both = left.join(right, keys, how)
    c, p = F.col("computed"), F.col("published")
    if policy == NULL_IS_ZERO:
        c, p = zero(c), zero(p)
    if shortfall:
        ok = F.coalesce((p - c >= 0) & (p - c < 1), F.lit(False))
    elif policy == PRINTED:
        ok = F.when(p.isNull(), zero(c) == 0).otherwise(F.coalesce(c == p, F.lit(False)))
    else:
        ok = c.eqNullSafe(p)
    return both.select(*keys, "computed", "published", ok.alias("ok"))


def expected_totals(
    computed: DataFrame, expected: DataFrame, keys: Sequence[str], value: str = "value",
    optional: Column | None = None, absent: int | None = None,
) -> DataFrame:
    """Computed totals against a list of expected ones: keys, ``computed``, ``expected``, ``asked``, ``ok``.

    Keys name a scope and a measure; null keys are equal. One aggregate puts both sides together, so any
    number of measures costs one shuffle of partial sums. Computed rows of one key are added up; expected rows
    of one key that differ are never met. A computed total that nobody asked for is ok only where
    ``optional`` (an expression over the keys) holds. ``absent`` stands for a total that was not computed.
    """
    sides = computed.select(*keys, F.col(value).alias("__got"), F.lit(None).cast("bigint").alias("__want"), F.lit(False).alias("__asked"))
    sides = sides.unionByName(expected.select(
        *keys, F.lit(None).cast("bigint").alias("__got"), F.col(value).alias("__want"), F.lit(True).alias("__asked")))
    rows = sides.groupBy(*keys).agg(
        F.sum("__got").alias("computed"), F.min("__want").alias("expected"), F.max("__want").alias("__high"), F.max("__asked").alias("asked"),
        (F.count_if("__asked") - F.count("__want")).alias("__blank"))
    got = F.col("computed") if absent is None else F.coalesce("computed", F.lit(absent))
    single = F.col("expected").eqNullSafe(F.col("__high")) & ((F.col("__blank") == 0) | F.col("expected").isNull())
    met = F.when(F.col("asked"), single & got.eqNullSafe(F.col("expected"))).otherwise(F.lit(False) if optional is None else optional)
    return rows.select(*keys, "computed", "expected", "asked", F.coalesce(met, F.lit(False)).alias("ok"))


def contiguous(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Per key: are the numbers exactly 1..n? Aggregates only, no sorted group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(number).alias("low"), F.max(number).alias("high"),
        F.count_distinct(number).alias("distinct_n"),
    ).withColumn(
        "ok",
        F.coalesce((F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("distinct_n") == F.col("n")), F.lit(False)),
    )


def ascending(df: DataFrame, keys: Sequence[str], number: str, ordinal: str) -> DataFrame:
    """Per key: does ``number`` start at 1 and never fall in file order?"""
    lagged = ordered_lag(df, keys, [ordinal], number, "__before")
    return lagged.groupBy(*keys).agg(
        F.min(number).alias("low"), F.count_if(F.col(number) < F.col("__before")).alias("falls")
    ).withColumn("ok", F.coalesce((F.col("low") == 1) & (F.col("falls") == 0), F.lit(False)))


def schema_difference(df: DataFrame, expected: Sequence[str]) -> tuple[list[str], list[str]]:
    """(extra, missing) column names; metadata only."""
    have, want = set(df.columns), set(expected)
    return sorted(have - want), sorted(want - have)


def set_difference(found: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with ``side`` ``extra`` or ``missing``."""
    a, b = found.select(*keys).distinct(), expected.select(*keys).distinct()
    extra = join_null_safe(a, b, keys, "left_anti").withColumn("side", F.lit("extra"))
    return extra.unionByName(join_null_safe(b, a, keys, "left_anti").withColumn("side", F.lit("missing")))
