"""Turning report-shaped rows into keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import join_null_safe, ordered_lag, ordered_rank, ordered_running_sum


def unpivot_groups(
    df: DataFrame, ids: Sequence[str], groups: dict[str, dict[str, str]], name: str = "category"
) -> DataFrame:
    """Wide to long: ``groups`` maps a category to its measure columns.

    Categories with a null or empty name make no rows. Row-local: no shuffle.
    """
    items = [
        F.struct(F.lit(g).alias(name), *[F.col(c).alias(m) for m, c in cols.items()])
        for g, cols in groups.items()
        if g
    ]
    return df.select(*ids, F.explode(F.array(*items)).alias("__g")).select(*ids, "__g.*")


def merge_wrapped(
    df: DataFrame, keys: Sequence[str], order: str, label: str, is_head: Column, out: str = "label",
    part_rows: int | None = None,
) -> DataFrame:
    """Join the label of each head row with the rows that continue it.

    A continuation has a label but no value. Rows before the first head form group 0.
    A printed label wraps a few times; where a group may be of any length, ``part_rows``
    joins it in consecutive parts of that many rows, all of them kept.
    """
    keys = list(keys)
    flagged = df.withColumn("__head", F.when(is_head, 1).otherwise(0))
    rows = ordered_running_sum(flagged, keys, [order], "__head", "group_no")
    by = [*keys, "group_no"]
    if part_rows:
        rows = ordered_rank(rows, by, [order], "__no").withColumn(
            "part_no", F.floor((F.col("__no") - 1) / part_rows) + 1
        )
        by = [*by, "part_no"]
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct(order, label))), lambda x: x[label]), ""
    )
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.min(order).alias("first_row"), joined.alias(out)
    )


def ordinal_in_group(df: DataFrame, keys: Sequence[str], order: str, is_header: Column, out="ordinal") -> DataFrame:
    """Reading-order number of each row below its header; headers are 0."""
    flagged = df.withColumn("__head", F.when(is_header, 1).otherwise(0))
    grouped = ordered_running_sum(flagged, keys, [order], "__head", "header_no")
    ranked = ordered_rank(grouped, [*keys, "header_no"], [order], "__no")
    # Rows above the first header have no header to count from.
    return ranked.withColumn(
        out, F.when(F.col("header_no") == 0, F.col("__no")).otherwise(F.col("__no") - 1)
    ).drop("__head", "__no")


def attach_following(
    df: DataFrame, keys: Sequence[str], order: str, is_value: Column, is_rate: Column, rate: str, out: str
) -> DataFrame:
    """Value rows with the rate of the directly following rate row, if there is one."""
    marked = df.withColumn("__back", -F.col(order)).withColumn(
        "__next", F.when(is_rate, F.struct(F.col(rate).alias("r")))
    )
    led = ordered_lag(marked, keys, ["__back"], "__next", "__follow")
    return led.where(is_value).withColumn(out, F.col("__follow.r")).drop("__back", "__next", "__follow")


def with_overrides(df: DataFrame, register: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Registered values replace the read ones, key by key."""
    named = register.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in columns])
    joined = join_null_safe(df, named, keys, "left")
    return joined.select(
        *[F.coalesce(f"__o_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def unresolved(df: DataFrame, register: DataFrame, keys: Sequence[str], unreadable: Column) -> DataFrame:
    """Rows marked unreadable for which no override is registered: must be empty."""
    return join_null_safe(df.where(unreadable), register.select(*keys).distinct(), keys, "left_anti")


def positional_labels(
    df: DataFrame, keys: Sequence[str], order: str, sections: Sequence[str], labels: Sequence[str], printed: str
) -> DataFrame:
    """Section and label by position, with ``ok`` where the printed label agrees.

    A key must have exactly sections x labels rows; ``complete`` says so. Rows beyond them
    have neither section nor label.
    """
    n = len(labels)
    ranked = ordered_rank(df, keys, [order], "__no")
    counts = df.groupBy(*keys).agg((F.count(F.lit(1)) == n * len(sections)).alias("complete"))
    at = F.col("__no") - 1
    section = F.get(F.array(*[F.lit(s) for s in sections]), F.expr(f"int((__no - 1) div {n})"))
    label = F.when(at < n * len(sections), F.get(F.array(*[F.lit(x) for x in labels]), (at % n).cast("int")))
    return join_null_safe(ranked, counts, keys, "inner").select(
        "*", section.alias("section"), label.alias("label"), label.eqNullSafe(F.col(printed)).alias("ok")
    ).drop("__no")


def classify(df: DataFrame, text: Column, rules: Sequence[tuple[str, Sequence[str]]], out: str = "kind") -> DataFrame:
    """First rule all of whose keywords occur in the text; null when none does."""
    kind = F.lit(None).cast("string")
    for name, words in reversed(list(rules)):
        hit = F.lit(True)
        for w in words:
            hit = hit & text.contains(w)
        kind = F.when(hit, name).otherwise(kind)
    return df.withColumn(out, kind)


def expected_once(found: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected combinations that do not occur exactly once, with their count."""
    counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return join_null_safe(expected.select(*keys), counts, keys, "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    ).where("n <> 1")
