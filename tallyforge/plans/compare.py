"""Comparing allocations: steps, deltas, majority lines, coalitions, sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import join_null_safe

# Chamber sizes whose stable and absolute majorities are laid down.
KNOWN_LINES = {465: (244, 261), 475: (249, 266)}
BASE_CHAMBER = 465

# Governing parties per election, as printed in the results.
DEFAULT_COALITIONS = {
    "r08-02-08": ("自由民主党", "日本維新の会"),
    "r06-10-27": ("自由民主党", "公明党"),
    "r03-10-31": ("自由民主党", "公明党"),
    "h29-10-22": ("自由民主党", "公明党"),
    "h26-12-14": ("自由民主党", "公明党"),
}


def step_deltas(seats: DataFrame, keys: Sequence[str], party="party", step="step_no", value="seats") -> DataFrame:
    """Seat change of every party at every step over the dense (party x step) grid.

    A party absent at a step has zero seats there. The grid comes from the keys' own
    steps and parties, so its size is steps x parties per path.
    """
    keys = list(keys)
    parties = seats.select(*keys, party).distinct()
    steps = seats.groupBy(*keys).agg(F.collect_set(step).alias("__steps"))
    grid = join_null_safe(parties, steps, keys, "inner").select(*keys, party, F.explode("__steps").alias(step))
    dense = join_null_safe(grid, seats.select(*keys, party, step, value), [*keys, party, step], "left").withColumn(
        value, F.coalesce(value, F.lit(0))
    )
    w = Window.partitionBy(*keys, party).orderBy(step)
    return dense.withColumn("delta", F.col(value) - F.lag(value, 1).over(w))


def net_changes(deltas: DataFrame, keys: Sequence[str], party="party") -> DataFrame:
    """Net change over a path, and whether it moved and came back."""
    return deltas.groupBy(*keys, party).agg(
        F.coalesce(F.sum("delta"), F.lit(0)).alias("net"),
        F.coalesce(F.bool_or(F.col("delta") != 0), F.lit(False)).alias("moved"),
    ).withColumn("reverted", F.col("moved") & (F.col("net") == 0))


def side_by_side(left: DataFrame, right: DataFrame, keys: Sequence[str], party="party", value="seats") -> DataFrame:
    """Baseline and proposal per party with a total row (party ``__TOTAL__``)."""
    keys = list(keys)
    both = left.select(*keys, party, F.col(value).alias("before")).join(
        right.select(*keys, party, F.col(value).alias("after")), [*keys, party], "full_outer"
    ).na.fill(0, ["before", "after"])
    rows = both.groupBy(*keys, party).agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    totals = rows.groupBy(*keys).agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    out = rows.unionByName(totals.withColumn(party, F.lit("__TOTAL__")))
    return out.withColumn("delta", F.col("after") - F.col("before"))


def distance(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str], value="seats") -> DataFrame:
    """Sum of absolute seat differences per ``by``."""
    joined = left.select(*keys, F.col(value).alias("__a")).join(
        right.select(*keys, F.col(value).alias("__b")), list(keys), "full_outer"
    )
    gap = F.abs(F.coalesce("__a", F.lit(0)) - F.coalesce("__b", F.lit(0)))
    return joined.groupBy(*by).agg(F.sum(gap).alias("distance"))


def spread(seats: DataFrame, keys: Sequence[str], value="seats") -> DataFrame:
    """Smallest, largest and spread of seats over a sweep. Give zero rows explicitly."""
    return seats.groupBy(*keys).agg(
        F.min(value).alias("min_seats"), F.max(value).alias("max_seats"),
        F.stddev_pop(value).alias("sd_seats"), F.count(F.lit(1)).alias("scenarios"),
    )


def majority_lines(df: DataFrame, members: str) -> DataFrame:
    """Majority, stable and absolute majority lines for each row's number of members.

    Known sizes use the laid-down values; others scale the base chamber's ratio
    and are flagged inexact.
    """
    m = F.col(members).cast("bigint")
    known = F.create_map(
        *[
            part
            for size, (stable, absolute) in KNOWN_LINES.items()
            for part in (
                F.lit(size).cast("bigint"),
                F.struct(
                    F.lit(stable).cast("bigint").alias("stable"), F.lit(absolute).cast("bigint").alias("absolute")
                ),
            )
        ]
    )
    stable0, absolute0 = KNOWN_LINES[BASE_CHAMBER]
    hit = F.try_element_at(known, m)

    def scaled(line):
        # ceil(line * m / chamber) in whole numbers
        raised = F.lit(line).cast("bigint") * m + (BASE_CHAMBER - 1)
        return ((raised - raised % BASE_CHAMBER) / BASE_CHAMBER).cast("bigint")

    def line(name, no, needed, exact):
        return F.struct(
            F.lit(name).alias("line"), F.lit(no).alias("line_no"),
            needed.cast("bigint").alias("needed"), exact.alias("exact"),
        )

    lines = F.array(
        line("majority", 1, F.floor(m / 2) + 1, F.lit(True)),
        line("stable", 2, F.coalesce(hit["stable"], scaled(stable0)), hit.isNotNull()),
        line("absolute", 3, F.coalesce(hit["absolute"], scaled(absolute0)), hit.isNotNull()),
    )
    return df.select("*", F.explode(lines).alias("__l")).select("*", "__l.*").drop("__l")


def coalition_summary(
    seats: DataFrame, coalition: DataFrame, keys: Sequence[str], party="party", value="seats"
) -> DataFrame:
    """Seats and share of a coalition (keys, party) and the strictest line it reaches."""
    keys = list(keys)
    members = seats.groupBy(*keys).agg(F.sum(value).alias("members"))
    held = seats.join(coalition, [*[k for k in keys if k in coalition.columns], party], "left_semi").groupBy(
        *keys
    ).agg(F.sum(value).alias("held"))
    base = join_null_safe(members, held, keys, "left").withColumn("held", F.coalesce("held", F.lit(0)))
    lined = majority_lines(base, "members")
    reached = F.max_by(
        F.when(F.col("held") >= F.col("needed"), F.col("line")),
        F.when(F.col("held") >= F.col("needed"), F.col("line_no")),
    )
    return lined.groupBy(*keys, "members", "held").agg(reached.alias("reached")).withColumn(
        "share", F.when(F.col("members") == 0, F.lit(0.0)).otherwise(F.col("held") / F.col("members") * 100)
    )


def winner_changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items only in ``before`` (lost) or only in ``after`` (gained)."""
    keys = list(keys)
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    lost = a.join(b, keys, "left_anti").withColumn("change", F.lit("lost"))
    return lost.unionByName(b.join(a, keys, "left_anti").withColumn("change", F.lit("gained")))


def headline(seats: DataFrame, keys: Sequence[str], statutory: Column, direct="district_seats", listed="list_seats") -> DataFrame:
    """Legal total, filled seats, vacancies and the strongest party with its share.

    The legal total counts list seats as the larger of those awarded and the
    statutory number.
    """
    totals = seats.groupBy(*keys).agg(
        F.sum(direct).alias("district_total"),
        F.sum(listed).alias("list_total"),
        F.sum("vacancies").alias("vacancies"),
        F.sum("seats").alias("filled"),
        F.min(F.struct((-F.col("seats")).alias("n"), F.col("party").alias("p"))).alias("__top"),
    )
    return totals.select(
        *keys,
        (F.col("district_total") + F.greatest(F.col("list_total") + F.col("vacancies"), statutory)).alias("legal_total"),
        "filled", "vacancies",
        F.col("__top.p").alias("top_party"),
        (-F.col("__top.n")).alias("top_seats"),
        ((-F.col("__top.n")) / F.col("filled") * 100).alias("top_share"),
    )
