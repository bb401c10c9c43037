"""Preference profiles: rejection rates to layers and orderings, and their repair.

A profile is small and bounded: voter groups x targets (a dozen or two of each),
whatever the number of contests. Rates are a long table (voter, target, rate in
percent); orderings a long table (voter, pos from 0, target).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_step


def rounded_rates(raw: DataFrame, step: int = 5, rate: str = "rate") -> DataFrame:
    return raw.withColumn(rate, round_step(F.col(rate), step))


def layers(rates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Voter layers of the nested rejection model: (voter, layer, weight in %, rejects).

    Targets in falling order of rate; a layer's weight is the drop to the next rate and
    it rejects everything rated higher. Layers without weight are left out; a last
    layer rejects all targets when the lowest rate is above zero.
    """
    by = [*keys, "voter"]
    w = Window.partitionBy(*by).orderBy(F.desc("rate"), "target")
    higher = w.rowsBetween(Window.unboundedPreceding, -1)
    drops = rates.select(
        *by, F.row_number().over(w).alias("__no"),
        (F.lag("rate", 1, 100).over(w) - F.col("rate")).alias("weight"),
        F.collect_list("target").over(higher).alias("rejects"),
    )
    tail = rates.groupBy(*by).agg(
        F.count(F.lit(1)).cast("int").alias("__n"), F.min("rate").alias("weight"),
        F.sort_array(F.collect_list(F.struct((-F.col("rate")).alias("r"), "target"))).alias("__all"),
    ).select(
        *by, (F.col("__n") + 1).alias("__no"), "weight", F.transform("__all", lambda x: x["target"]).alias("rejects")
    )
    kept = drops.unionByName(tail).where("weight > 0")
    return kept.select(
        *by, (F.row_number().over(Window.partitionBy(*by).orderBy("__no")) - 1).alias("layer"), "weight", "rejects"
    )


def _ranked(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per voter: itself first, the others by rate, then name."""
    ordered = F.sort_array(F.collect_list(F.when(F.col("target") != F.col("voter"), F.struct("rate", "target"))))
    return rates.groupBy(*keys, "voter").agg(
        ordered.alias("__o"), F.collect_set("target").alias("rated")
    ).select(
        *keys, "voter", "rated",
        F.concat(F.array("voter"), F.transform("__o", lambda x: x["target"])).alias("ordering"),
    )


def base_orderings(rates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(voter, ordering) straight from rates."""
    return _ranked(rates, keys).select(*keys, "voter", "ordering")


def to_arrays(orderings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return orderings.groupBy(*keys, "voter").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"]).alias("ordering")
    )


def to_rows(arrays: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return arrays.select(*keys, "voter", F.posexplode("ordering").alias("pos", "target"))


def insert_at(order: Column, index: Column, item: Column) -> Column:
    """``item`` at a zero-based index; beyond the end it is appended."""
    return F.array_insert(order, (F.least(index, F.size(order)) + 1).cast("int"), item)


def insert_beside(order: Column, item: Column, beside: Column) -> Column:
    """``item`` right after ``beside``; at the end if that is absent; once only."""
    at = F.array_position(order, beside)
    return (
        F.when(F.array_contains(order, item), order)
        .when(at > 0, insert_at(order, at.cast("int"), item))
        .otherwise(F.concat(order, F.array(item)))
    )


def insert_relative(order: Column, item: Column, position: float) -> Column:
    """``item`` at a share of the places after the first, halves to even."""
    at = F.lit(1) + F.bround((F.size(order) - 1) * F.lit(position)).cast("int")
    return insert_at(order, at, item)


def orderings_from_rates(stored: DataFrame, rates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Orderings rebuilt from rates; unrated targets keep their stored index.

    ``stored`` and the result are (voter, ordering). Voters without rates keep theirs.
    """
    by = [*keys, "voter"]
    joined = stored.join(_ranked(rates, keys).withColumnRenamed("ordering", "__ranked"), by, "left")
    unrated = F.filter(
        F.transform("ordering", lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        lambda x: (x["p"] != F.col("voter")) & ~F.array_contains("rated", x["p"]),
    )
    rebuilt = F.aggregate(unrated, F.col("__ranked"), lambda acc, x: insert_at(acc, x["i"], x["p"]))
    return joined.select(
        *by, F.when(F.col("__ranked").isNull(), F.col("ordering")).otherwise(rebuilt).alias("ordering")
    )


def mean_ordering(rates: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Ordering of an unplaced group: itself, then targets by mean rate over all rows."""
    means = rates.groupBy(*keys, "target").agg(F.avg("rate").alias("__m"))
    ordered = F.sort_array(F.collect_list(F.struct("__m", "target")))
    grouped = means.groupBy(*keys).agg(ordered.alias("__o"))
    return grouped.select(
        *keys, F.lit(name).alias("voter"),
        F.concat(F.array(F.lit(name)), F.transform("__o", lambda x: x["target"])).alias("ordering"),
    )


def complete_matrix(rates: DataFrame, copies: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Square matrix: each derived target copies a base column, then a base row."""
    out = rates.select(*keys, "voter", "target", "rate")
    bases: dict[str, list[str]] = {}
    for derived, base in copies.items():
        bases.setdefault(base, []).append(derived)

    def repeat(df: DataFrame, col: str) -> DataFrame:
        names = F.array(F.col(col))
        for base, derived in bases.items():
            names = F.when(F.col(col) == base, F.array(F.lit(base), *[F.lit(d) for d in derived])).otherwise(names)
        return df.withColumn(col, F.explode(names))

    return repeat(repeat(out, "target"), "voter")


def build_profile(
    rates: DataFrame, derived: dict[str, str], unplaced: str, position: float, keys: Sequence[str] = (),
    survey_only: DataFrame | None = None,
) -> DataFrame:
    """All orderings: surveyed voters, derived ones beside their base, the unplaced group.

    ``rates`` are those of voters who are also targets; ``survey_only`` may add rows that
    count for the means alone.
    """
    surveyed = base_orderings(rates, keys)
    extra = None
    for name, base in derived.items():
        part = surveyed.where(F.col("voter") == base).select(
            *keys, F.lit(name).alias("voter"), F.concat(F.array(F.lit(name)), F.col("ordering")).alias("ordering")
        )
        extra = part if extra is None else extra.unionByName(part)
    means = rates if survey_only is None else rates.unionByName(survey_only)
    everyone = surveyed.unionByName(mean_ordering(means, unplaced, keys))
    if extra is not None:
        everyone = everyone.unionByName(extra)
    order = F.col("ordering")
    for name, base in derived.items():
        order = F.when(F.col("voter") == name, order).otherwise(insert_beside(order, F.lit(name), F.lit(base)))
    order = F.when(F.col("voter") == unplaced, order).otherwise(insert_relative(order, F.lit(unplaced), position))
    return everyone.select(*keys, "voter", order.alias("ordering"))


def override_rates(rates: DataFrame, changes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Individual rates replaced, the rest as they are."""
    by = [*keys, "voter", "target"]
    return rates.join(changes.select(*by, F.col("rate").alias("__new")), by, "left").select(
        *by, F.coalesce("__new", "rate").alias("rate")
    )


def profile_problems(arrays: DataFrame, rates: DataFrame) -> DataFrame:
    """Violations: self not first, not a permutation of all voters, matrix not square."""
    universe = arrays.agg(F.sort_array(F.collect_set("voter"))).scalar()
    orders = arrays.select(
        "voter",
        F.when(F.get("ordering", F.lit(0)) != F.col("voter"), "own group is not first")
        .when(F.sort_array("ordering") != universe, "not a permutation of all groups")
        .alias("problem"),
    ).where("problem IS NOT NULL")
    square = rates.agg(F.sort_array(F.collect_set("voter"))).scalar()
    rows = rates.groupBy("voter").agg(F.sort_array(F.collect_list("target")).alias("targets"))
    matrix = rows.where(F.col("targets") != square).select("voter", F.lit("rate matrix is not square").alias("problem"))
    return orders.unionByName(matrix)
