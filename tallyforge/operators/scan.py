"""Ordered windows that stay parallel when one key, null included, holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(pos)`` sends a whole key to one task. Rows per
key are counted first (map-side combined, only keys are read). Where every key fits a
task, that is all: one plain window, one shuffle. The rows of keys that do not fit are
range partitioned by (key, order), which needs nothing from the caller and splits a key
of equal or null values too; the number of ranges follows from the number of rows. The
ranges are written once, so that all that is read from them agrees on their edges. The
window runs inside (key, range); what crosses an edge is one summary row per key and
range, carried over the earlier ranges. The result equals the plain window always; rows
that are equal in key and order never lie in two ranges.

``Limits`` bounds both the large keys and the ranges, so the summaries (large keys +
ranges rows) are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut_lineage


class Limits(NamedTuple):
    """``rows`` of one key that a single task may sort; ranges have half of them.

    A cluster reading 10^13 rows has at most 2.5 million keys of 2^22 rows, and in
    practice a handful. Beyond ``ranges`` ranges they grow instead.
    """

    rows: int = 1 << 22
    ranges: int = 20_000


LIMITS = Limits()


def _keys(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where null equals null, keeping the left key columns once."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns]
    )
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def _before(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)


def _scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], limits: Limits, nothing: Column,
    carried: Callable[[DataFrame], DataFrame], windowed: Callable[[DataFrame, WindowSpec], DataFrame],
) -> DataFrame:
    """``windowed`` over all rows; ``__carry`` is what ``carried`` says of the earlier ranges.

    ``carried`` makes (keys, ``__range``, ``__carry``) from the rows of large keys,
    ``nothing`` is the carry where a key has no earlier range.
    """
    large = cut_lineage(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") >= limits.rows))
    rows = large.agg(F.sum("__rows")).first()[0]
    whole = Window.partitionBy(*keys).orderBy(*order)
    if not rows:
        return windowed(df.withColumn("__carry", nothing), whole)
    names = F.broadcast(large.select(*keys))
    ranges = max(2, min(limits.ranges, -(-2 * rows // limits.rows)))
    cut = cut_lineage(
        join_null_safe(df, names, keys, "left_semi").repartitionByRange(ranges, *keys, *order)
        .withColumn("__range", F.spark_partition_id()))
    inside = join_null_safe(cut, F.broadcast(carried(cut)), [*keys, "__range"], "left").withColumn(
        "__carry", F.coalesce("__carry", nothing))
    large_rows = windowed(inside, Window.partitionBy(*keys, "__range").orderBy(*order))
    small = join_null_safe(df, names, keys, "left_anti").withColumn("__carry", nothing)
    return windowed(small, whole).unionByName(large_rows)


def ordered_rank(df, keys, order, out: str = "rank_no", limits: Limits = LIMITS) -> DataFrame:
    """``row_number`` over ``keys`` ordered by the column names in ``order``."""
    keys, order = _keys(keys), _keys(order)

    def carried(cut):
        sizes = cut.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__size"))
        return sizes.select(*keys, "__range", F.sum("__size").over(_before(keys)).alias("__carry"))

    def windowed(rows, w):
        return rows.withColumn(out, F.col("__carry") + F.row_number().over(w)).select(*df.columns, out)

    return _scan(df, keys, order, limits, F.lit(0).cast("bigint"), carried, windowed)


def ordered_lag(df, keys, order, value: str, out: str, limits: Limits = LIMITS) -> DataFrame:
    """``lag(value)`` over ``keys`` ordered by ``order``."""
    keys, order = _keys(keys), _keys(order)

    def carried(cut):
        tails = cut.groupBy(*keys, "__range").agg(
            F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__tail"))
        before = F.lag("__tail").over(Window.partitionBy(*keys).orderBy("__range"))
        return tails.select(*keys, "__range", before["v"].alias("__carry"))

    def windowed(rows, w):
        first = F.row_number().over(w) == 1
        return rows.withColumn("__lag", F.when(first, F.col("__carry")).otherwise(F.lag(value).over(w))).select(
            *[c for c in df.columns if c != out], F.col("__lag").alias(out))

    return _scan(df, keys, order, limits, F.lit(None).cast(df.schema[value].dataType), carried, windowed)


def ordered_running_sum(df, keys, order, value: str | Column, out: str, limits: Limits = LIMITS) -> DataFrame:
    """Inclusive running sum of ``value``; null counts as zero."""
    keys, order = _keys(keys), _keys(order)
    valued = df.withColumn("__v", F.col(value) if isinstance(value, str) else value)

    def carried(cut):
        sums = cut.groupBy(*keys, "__range").agg(F.sum("__v").alias("__sum"))
        return sums.select(*keys, "__range", F.sum("__sum").over(_before(keys)).alias("__carry"))

    def windowed(rows, w):
        run = F.sum("__v").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("__sum", F.col("__carry") + F.coalesce(run, F.lit(0))).select(
            *[c for c in df.columns if c != out], F.col("__sum").alias(out))

    nothing = F.lit(0).cast(valued.select(F.sum("__v")).schema[0].dataType)
    return _scan(valued, keys, order, limits, nothing, carried, windowed)


def carry_forward(
    df, keys, order, label: str | Column, out: str, reset: Column | None = None, limits: Limits = LIMITS
) -> DataFrame:
    """Last non-null ``label`` so far; a row where ``reset`` holds clears it."""
    keys, order = _keys(keys), _keys(order)
    lab = F.col(label) if isinstance(label, str) else label
    clear = F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False)
    marked = df.withColumn(
        "__mark", F.when(lab.isNotNull() | clear, F.struct(F.when(~clear, lab).alias("label"))))

    def carried(cut):
        tails = cut.groupBy(*keys, "__range").agg(
            F.max_by("__mark", F.when(F.col("__mark").isNotNull(), F.struct(*order))).alias("__tail"))
        return tails.select(*keys, "__range", F.last("__tail", True).over(_before(keys)).alias("__carry"))

    def windowed(rows, w):
        seen = F.last("__mark", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("__seen", seen).select(
            *[c for c in df.columns if c != out], F.coalesce("__seen", "__carry")["label"].alias(out))

    return _scan(marked, keys, order, limits, F.lit(None).cast(marked.schema["__mark"].dataType), carried, windowed)


def islands(
    df, keys, order, value: str, tol: float | int, out: str = "island_no", limits: Limits = LIMITS
) -> DataFrame:
    """Number runs of ``value`` whose neighbours are at most ``tol`` apart (from 1 per key).

    ``order`` must start with ``value``. The window counts the breaks inside a range; the
    summary rows decide the break at each edge.
    """
    keys, order = _keys(keys), _keys(order)

    def with_breaks(rows, w):
        gap = rows.withColumn("__prev", F.lag(value).over(w))
        broken = F.when(F.col(value) - F.col("__prev") > F.lit(tol), 1).otherwise(0)
        return gap.withColumn("__breaks", F.sum(broken).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def carried(cut):
        summary = with_breaks(cut, Window.partitionBy(*keys, "__range").orderBy(*order)).groupBy(*keys, "__range").agg(
            F.min(value).alias("__first"), F.max(value).alias("__last"), F.max("__breaks").alias("__inner"))
        last = F.lag("__last").over(Window.partitionBy(*keys).orderBy("__range"))
        opened = summary.withColumn("__far", F.col("__first") - last).withColumn(
            "__opens", F.when(last.isNull() | (F.col("__far") > F.lit(tol)), 1).otherwise(0))
        earlier = F.coalesce(F.sum(F.col("__opens") + F.col("__inner")).over(_before(keys)), F.lit(0))
        return opened.select(*keys, "__range", (earlier + F.col("__opens")).alias("__carry"))

    def windowed(rows, w):
        return with_breaks(rows, w).withColumn(out, F.col("__carry") + F.col("__breaks")).select(*df.columns, out)

    return _scan(df, keys, order, limits, F.lit(1).cast("bigint"), carried, windowed)


def salted_cut(
    df: DataFrame, keys, order: Sequence[Column], n: int | Column, salt_on: Sequence[str], salts: int = 32
) -> DataFrame:
    """Rows that can still be among the first ``n`` of their group.

    Each salted part of a group keeps its own first ``n``, so a group of any size is
    sorted by many tasks and shrinks to at most ``salts * n`` rows.
    """
    limit = F.lit(n) if isinstance(n, int) else n
    part = Window.partitionBy(*_keys(keys), "__salt").orderBy(*order)
    return (
        df.withColumn("__salt", F.pmod(F.hash(*salt_on), F.lit(salts)))
        .withColumn("__place", F.row_number().over(part))
        .where(F.col("__place") <= limit)
        .drop("__salt", "__place")
    )


def top_by_group(
    df: DataFrame, keys, order: Sequence[Column], n: int | Column, salt_on: Sequence[str], out: str = "rank_no", salts: int = 32
) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, with their rank."""
    keys = _keys(keys)
    limit = F.lit(n) if isinstance(n, int) else n
    kept = salted_cut(df, keys, order, limit, salt_on, salts)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn(out, F.row_number().over(whole)).where(F.col(out) <= limit)
