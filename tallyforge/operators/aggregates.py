"""Grouped totals, shares, modes, means, samples, set differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import join_null_safe, top_by_group

TOTAL = "__TOTAL__"


def totals_with_grand(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], label: str = TOTAL) -> DataFrame:
    """Grouped sums with every roll-up level; rolled-up text keys read ``label``."""
    out = df.rollup(*keys).agg(*aggs, F.grouping_id().alias("__level"))
    n = len(keys)
    cols = [
        F.when(F.col("__level").bitwiseAND(1 << (n - 1 - i)) != 0, label).otherwise(F.col(k)).alias(k)
        for i, k in enumerate(keys)
    ]
    return out.select(*cols, *[c for c in out.columns if c not in keys and c != "__level"])


def share_of(df: DataFrame, keys: Sequence[str], value: str, out: str = "share_pct") -> DataFrame:
    """Percentage of the key's total. The totals are aggregated first and joined back,
    so a large key never sits in one window partition."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    return join_null_safe(df, totals, keys, "inner").withColumn(
        out, F.col(value) / F.nullif(F.col("__total"), F.lit(0)) * 100
    ).drop("__total")


def mode_first_seen(df: DataFrame, keys: Sequence[str], item: str, ordinal: str, weight: Column | None = None) -> DataFrame:
    """The most frequent item; the one seen first on ties."""
    counts = df.groupBy(*keys, item).agg(
        (F.sum(weight) if weight is not None else F.count(F.lit(1))).alias("n"), F.min(ordinal).alias("first_seen")
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("first_seen").alias("f"), F.col(item).alias("i")))
    return counts.groupBy(*keys).agg(best.alias("__b")).select(
        *keys, F.col("__b.i").alias(item), (-F.col("__b.n")).alias("n")
    )


def argmax(df: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """The item with the largest value, first by name on ties; one aggregate."""
    best = F.min(F.struct((-F.col(value)).alias("n"), F.col(item).alias("i")))
    return df.groupBy(*keys).agg(best.alias("__b")).select(
        *keys, F.col("__b.i").alias(item), (-F.col("__b.n")).alias(value)
    )


def seeded_sample(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows per stratum, the same in every run: the smallest md5(seed, key)."""
    hashed = df.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    return top_by_group(hashed, strata, [F.col("__h"), F.col(key)], n, ["__h"], "sample_no").drop("__h")


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of either side with the side(s) they occur on."""
    a = left.select(*keys, F.lit(1).alias("s"))
    b = right.select(*keys, F.lit(2).alias("s"))
    return a.unionByName(b).groupBy(*keys).agg(F.bit_or("s").alias("__s")).select(
        *keys,
        F.when(F.col("__s") == 3, "both").when(F.col("__s") == 1, "left").otherwise("right").alias("side"),
    )
